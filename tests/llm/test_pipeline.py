import hashlib
from collections import Counter

import corpus_pipeline as P
from kinweave.llm import exact

from .helpers import docs
from .test_bpe import library
from .test_jaccard import brute, family
from .test_mixing import brute_schedule

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_pipeline_is_its_stages_by_brute_force(spark, tmp_path):
    rows = [(i, t, "en", "abc"[i % 3]) for i, t in family(9, bases=6, copies=12)]
    top = max(r[0] for r in rows)
    rows += [(top + 1 + k, t.upper(), "en", "c") for k, (_, t, *_) in enumerate(rows[:10])]
    rows += [(9001, None, None, None), (9002, "12 34", "en", "a"), (9003, "", "en", "a"), (9004, "alone here", "en", None)]
    docs(spark, rows).select(COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    got = P.run(spark, str(tmp_path)).collect()

    kept = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    last = {r[1].lower(): r[0] for r in sorted(kept)}
    kept = [r for r in kept if last[r[1].lower()] == r[0]]
    comp = brute([(i, t) for i, t, *_ in kept], 5, 80)
    kept = [r for r in kept if comp[r[0]][1] == r[0]]
    assert {r.doc_id for r in got} <= {r[0] for r in kept}
    taken = Counter(i for _, _, i, _ in brute_schedule(spark, kept))
    text = {r[0]: r[1] for r in kept}
    want = []
    for i, n in taken.items():
        words = text[i].split()
        want += [(i, text[i])] * (n // len(words))
        if n % len(words):
            want.append((i, " ".join(words[: n % len(words)])))
    assert sorted((r.doc_id, tuple(r.ids), r.decoded_sha256) for r in got) == sorted((i, tuple(library(t)), hashlib.sha256(t.encode()).hexdigest()) for i, t in want)


def test_stages_keep_columns(spark):
    d = docs(spark, [(1, "a b c", "en", "x"), (2, "A b c", "en", "x"), (3, None, None, None)])
    for _, stage in P.STAGES[:-1]:
        assert stage(spark, d, "").columns == d.columns
    assert [r.doc_id for r in exact.survivors(d.where("doc_id < 3")).collect()] == [2]
    empty = d.limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, empty, "").collect() == []


def test_no_stage_loses_a_text_that_shares_its_id(spark):
    words = [" ".join(f"{c}{k}" for k in range(12)) for c in "abcdefg"]
    rows = [(3, words[0]), (5, words[0]), (5, words[1]), (5, words[2]), (None, words[3]), (None, words[4]), (7, words[5]), (7, words[5].upper()), (None, words[6]), (None, words[6])]
    d = docs(spark, [(i, t, "en", "a") for i, t in rows])
    texts = {t.lower() for _, t in rows}
    for name, stage in P.STAGES[:-1]:
        got = stage(spark, d, "").collect()
        # the mix takes a source one and a half times, so every text is there once at least
        assert {r.text.lower() for r in got} == texts, name
    left = [stage(spark, d, "").count() for _, stage in P.STAGES[:3]]
    assert left[0] == len(rows) and left[1] == len(texts)
    assert len(P.STAGES[-1][1](spark, d, "").collect()) == len(rows)

