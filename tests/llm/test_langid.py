import zlib

import numpy as np

from kinweave.llm import langid

from .helpers import ODD, docs

LINES = {"en": "the house is on the hill and the sun shines", "de": "das haus steht auf dem hügel und die sonne scheint", "fr": "la maison est sur la colline et le soleil brille"}


def corpus(spark, n=150):
    return docs(spark, [(i, " ".join(np.random.default_rng(i).permutation(t.split())), lang, "s") for i, (lang, t) in enumerate(list(LINES.items()) * (n // 3))])


def test_held_out_rows_are_not_learned_from_and_are_found(spark):
    d = corpus(spark)
    got = langid.identify(d, langid.train(d)).collect()
    lang = {r.doc_id: r.lang for r in d.collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out]
    assert len(held) > 10 and np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in got)
    # without the held-out rows the model is the same
    kept = d.where("crc32(cast(doc_id as string)) % 5 <> 0")
    assert np.array_equal(langid.train(d).weights, langid.train(kept).weights)


def test_scores_are_the_kernel_machine(spark):
    presence = langid.Presence()
    texts = [t for t in LINES.values() for _ in range(3)]
    places = [presence(t) for t in texts]
    labels = [k for k in LINES for _ in range(3)]
    model = langid.fit(places, labels, landmarks=9)
    k = lambda p, q: len(np.intersect1d(p, q)) / np.sqrt(len(p) * len(q))
    kernel = np.array([[k(p, q) for q in places] for p in places])
    y = np.where(np.array(labels)[:, None] == np.array(model.languages)[None, :], 1.0, -1.0)
    values, vectors = np.linalg.eigh(kernel)
    root = vectors / np.sqrt(np.maximum(values, 1e-9)) @ vectors.T
    phi = kernel @ root
    want = phi @ np.linalg.solve(phi.T @ phi + langid.RIDGE * 9 * np.eye(9), phi.T @ y)
    assert np.allclose(model.scores(places), want, atol=2e-2)


def test_places_of_long_texts_do_not_depend_on_chunks(monkeypatch):
    text = "the house is on the hill " * 40
    whole = langid.Presence()(text)
    monkeypatch.setattr(langid, "CHUNK", 37)
    assert np.array_equal(langid.Presence()(text), whole)


def test_odd_rows(spark):
    model = langid.train(corpus(spark))
    got = {r.doc_id: r for r in langid.identify(docs(spark, ODD), model).collect()}
    assert {i for i, r in got.items() if r.lang_pred == "und"} == {1, 2, 3, 10}
    assert all(r.score == 0 for r in got.values() if r.lang_pred == "und")
    assert all(r.lang_pred == "und" for r in langid.identify(docs(spark, ODD), None).collect())
    assert langid.train(docs(spark, ODD).limit(0)) is None
    kept = langid.accepted(docs(spark, ODD), model)
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 4, 5, 6, 6, 7, 8, 9] and kept.columns == docs(spark, ODD).columns


def test_without_a_model_texts_with_letters_stay(spark):
    d = docs(spark, [(i, t, None, s) for i, t, _, s in ODD])
    assert langid.train(d) is None
    kept = langid.accepted(d, langid.train(d))
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 4, 5, 6, 6, 7, 8, 9]


def test_the_sample_is_bounded_where_rows_repeat(spark, monkeypatch):
    seen = []
    whole = langid.fit
    monkeypatch.setattr(langid, "fit", lambda places, labels: seen.append(len(places)) or whole(places, labels))
    rows = [(i, t, lang, "s") for i, (lang, t) in enumerate(list(LINES.items()) * 60)] + [(1, "the same text", "en", "s")] * 500 + [(2, f"text {k}", "en", "s") for k in range(500)]
    langid.train(docs(spark, rows), sample=30)
    assert 10 <= seen[0] <= 2 * 30


def test_too_many_languages_are_an_error(spark, monkeypatch):
    import pytest

    monkeypatch.setattr(langid, "LANGUAGES", 2)
    with pytest.raises(ValueError, match="languages"):
        langid.train(corpus(spark))


def test_fewer_landmarks_than_rows_are_the_nystrom_machine():
    """With landmarks L of rows N: features K_NL K_LL^(-1/2), ridge on all rows, written out with explicit sets."""
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.permutation(t.split())) + f" {k}" for t in LINES.values() for k in range(12)]
    labels = [k for k in LINES for _ in range(12)]
    presence = langid.Presence()
    sets = [set(presence(t).tolist()) for t in texts]
    model = langid.fit([presence(t) for t in texts], labels, landmarks=9)
    chosen = [12 * j + k for k in range(3) for j in sorted(range(3), key=lambda j: sorted(LINES).index(list(LINES)[j]))]
    k = lambda a, b: len(a & b) / np.sqrt(len(a) * len(b))
    nl = np.array([[k(a, sets[j]) for j in chosen] for a in sets])
    values, vectors = np.linalg.eigh(nl[chosen])
    phi = nl @ vectors / np.sqrt(values)
    y = np.where(np.array(labels)[:, None] == np.array(model.languages)[None, :], 1.0, -1.0)
    want = phi @ np.linalg.solve(phi.T @ phi + langid.RIDGE * len(texts) * np.eye(9), phi.T @ y)
    assert np.allclose(model.scores([presence(t) for t in texts]), want, atol=2e-2)


def test_the_score_drops_a_text_without_a_known_language(spark):
    d = corpus(spark)
    model = langid.train(d)
    rows = [(1, "漢字仮名交文章読本", None, "s"), (2, next(iter(LINES.values())), None, "s"), (3, "1234", None, "s"), (4, "漢字 " * 500, "xx", "s")]
    lang, score = langid.predict(model, [r[1] for r in rows])
    least = langid.least_score(model)
    assert score[0] < least <= score[1] and lang[0] != langid.UNKNOWN and lang[2] == langid.UNKNOWN
    assert {r.doc_id for r in langid.accepted(docs(spark, rows), model).collect()} == {i + 1 for i in range(4) if lang[i] != langid.UNKNOWN and score[i] >= least}
    assert 1 not in {r.doc_id for r in langid.accepted(docs(spark, rows), model).collect()}
    one = langid.fit([langid.Presence()("only one language")], ["en"])
    assert langid.least_score(one) == 1.0 and langid.predict(one, ["漢字"])[1] == [1.0]
