import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from kinweave.llm import jaccard

from .helpers import ODD, docs


def brute(rows, n, percent):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset([tuple(w)] if 0 < len(w) < n else [tuple(w[k : k + n]) for k in range(len(w) - n + 1)])
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    inverted = defaultdict(list)
    for i in sorted(sets):
        common = Counter(j for t in sets[i] for j in inverted[t])
        for j, k in common.items():
            if 100 * k >= percent * (len(sets[i]) + len(sets[j]) - k):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
        for t in sets[i]:
            inverted[t].append(i)
    return {i: (len(sets[i]), find(i)) for i in sets}


def family(seed, bases=12, copies=25):
    """Copies of a few texts with more and more words changed, a shared passage, short texts."""
    random.seed(seed)
    word = lambda: "".join(random.choices("abcdefgh", k=4))
    passage = [word() for _ in range(40)]
    rows, i = [], 0
    for _ in range(bases):
        base = [word() for _ in range(random.choice([6, 20, 63, 64, 65, 130, 300]))]
        if random.random() < 0.5:
            base[3:3] = passage
        for k in range(copies):
            own = list(base)
            for _ in range(random.randint(0, 1 + len(own) // 60 + k // 8)):
                own[random.randrange(len(own))] = word()
            rows.append((i, " ".join(own[: len(own) - random.randint(0, len(own) // 12)])))
            i += 1
    return rows


@pytest.mark.parametrize(("seed", "n", "percent"), [(1, 4, 85), (2, 5, 80)])
def test_components_are_those_of_brute_force(spark, seed, n, percent):
    rows = family(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_components(docs(spark, [(i, t, "", "") for i, t in rows]), n, percent).collect()}
    assert got == brute(rows, n, percent)


def test_odd_rows(spark):
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in jaccard.near_components(docs(spark, ODD), 4, 85).collect())
    assert got == [(0, 1, 0), (1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 4, 4), (5, 4, 4), (6, 4, 4), (6, 4, 4), (7, 2, 7), (8, 2, 8), (9, 1, 9), (10, 1, 10)]
    assert jaccard.near_components(docs(spark, ODD).limit(0)).collect() == []
    kept = jaccard.one_of_each(docs(spark, ODD), 4, 85)
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 7, 8, 9, 10] and kept.columns == docs(spark, ODD).columns


@pytest.mark.parametrize("percent", [80, 85])
def test_linked_sets_have_the_parts_they_need(percent):
    rng, levels = np.random.default_rng(7), jaccard.Levels(percent)
    for _ in range(1500):
        n = int(rng.integers(1, 200))
        a = rng.integers(0, 2**64, n, dtype=np.uint64)
        b = a[: n - int(rng.integers(0, max(1, n // 8) + 1))]
        b = np.concatenate([b, rng.integers(0, 2**64, int(rng.integers(0, max(1, n // 8) + 1)), dtype=np.uint64)])
        a, b = np.unique(a), np.unique(b)
        if not len(b) or not jaccard._linked(a, b, percent):
            continue
        (p, need), (q, want) = jaccard.parts(a, levels), jaccard.parts(b, levels)
        both = len(np.intersect1d(p, q))
        assert both >= need and both >= want


def test_an_open_block_is_exact():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 30, 12).astype(np.uint64)) for _ in range(40)]
    got = jaccard.open_block(sets, sets, 50)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            assert got[i, j] == jaccard._linked(a, b, 50)


def test_repeated_and_null_ids(spark):
    words = [f"w{i}" for i in range(60)]
    near = lambda k: " ".join([*words[:58], f"x{k}", f"y{k}"])
    rows = [(1, near(1)), (2, near(2)), (2, "a text of its own with seven words"), (1, near(3)), (None, near(4)), (None, "another text that is near to nothing")]
    rows += [(None, "v " + near(k).replace("w", "z")) for k in (5, 6)]
    d = docs(spark, [(i, t, "en", "a") for i, t in rows])
    kept = jaccard.one_of_each(d, 4, 80).collect()
    texts = sorted((r.doc_id or 0, r.text[:8]) for r in kept)
    assert texts == [(0, "another "), (0, "v z0 z1 "), (1, "w0 w1 w2"), (2, "a text o")]
    assert sorted(map(str, kept)) == sorted(map(str, jaccard.one_of_each(d.repartition(3), 4, 80).collect()))


def test_links_come_through_the_matrix(spark, monkeypatch):
    rows = family(4, bases=4, copies=12)
    d = docs(spark, [(i, t, "", "") for i, t in rows])
    found = lambda: {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_components(d, 4, 85).collect()}
    want = brute(rows, 4, 85)
    assert found() == want and any(c != i for i, (_, c) in want.items())
    opened = jaccard._qualifying
    monkeypatch.setattr(jaccard, "_qualifying", lambda posts, classes: opened(posts, classes).limit(0))
    got = found()  # with no group opened, only equal sets are together
    texts = {i: tuple(t.split()) for i, t in rows}
    assert all(c == min(j for j in texts if texts[j] == texts[i]) for i, (_, c) in got.items()) and got != want


def test_sets_that_share_half_a_digest_are_classes_of_their_own(spark, monkeypatch):
    whole = jaccard.set_class
    monkeypatch.setattr(jaccard, "set_class", lambda s: (whole(s)[0] % 5, whole(s)[1]))
    monkeypatch.setattr(jaccard, "arrow_map", lambda df, run, schema: df.sparkSession.createDataFrame(
        [r for t in run([_batch(df)]) for r in zip(*[c.to_pylist() for c in t.columns])], schema))
    rows = family(6, bases=5, copies=8)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_components(docs(spark, [(i, t, "", "") for i, t in rows]), 4, 85).collect()}
    assert got == brute(rows, 4, 85)


def _batch(df):
    return df.toArrow().combine_chunks().to_batches()[0] if df.count() else df.toArrow().to_batches()[0]


def test_spanning_edges_connect_the_same():
    rng = np.random.default_rng(5)
    for _ in range(200):
        n, m = rng.integers(1, 30, 2)
        rows, columns = rng.integers(0, 20, n) * 7 - 50, rng.integers(0, 20, m) * 7 - 50
        links = rng.random((n, m)) < rng.choice([0.02, 0.1, 0.5])
        a, b = jaccard.spanning(links, rows, columns)

        def joined(pairs):
            parent = {x: x for x in [*rows.tolist(), *columns.tolist()]}
            find = lambda x: x if parent[x] == x else find(parent[x])
            for x, y in pairs:
                parent[max(find(x), find(y))] = min(find(x), find(y))
            return {x: find(x) for x in parent}

        i, j = np.nonzero(links)
        assert joined(zip(a.tolist(), b.tolist())) == joined(zip(rows[i].tolist(), columns[j].tolist()))
        assert len(a) < len({*rows.tolist(), *columns.tolist()})
