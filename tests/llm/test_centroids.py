import hashlib
import math

import numpy as np
import pytest

from kinweave.llm import centroids

SCHEMA = "vec_id bigint, embedding array<float>, label int, own int, v string"


def brute(rows, k, rounds, dim, scale=1024, seed=3):
    kept = [(i, [math.floor(scale * float(np.float32(x))) for x in e]) for i, e in rows if e is not None and len(e) == dim and all(x is not None and math.isfinite(x) for x in e)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    cs = [v for _, v in order[:k]]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v: min(range(len(cs)), key=lambda c: (gap(v, cs[c]), c))
    for _ in range(rounds):
        own = [near(v) for _, v in kept]
        for c in range(len(cs)):
            mine = [v for (_, v), o in zip(kept, own, strict=True) if o == c]
            if mine:
                cs[c] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    return sorted(((i if i is not None else -1), near(v), gap(v, cs[near(v)])) for i, v in kept), cs


def vectors(spark, rows):
    return spark.createDataFrame([(i, e, 0, 1, "v") for i, e in rows], SCHEMA)


@pytest.mark.parametrize("k,stored", [(8, 3), (8, 7), (12, 1), (5, None)])
def test_equals_full_scans(spark, k, stored):
    rng = np.random.default_rng(k)
    middle = rng.normal(0, 1, (6, 4))
    rows = [(int(i), [float(x) for x in middle[i % 6] + rng.normal(0, 0.4, 4)]) for i in range(400)]
    rows += [(500 + i, [0.25, 0.25, 0.25, 0.25]) for i in range(30)]  # ties and copies
    rows += [(7, rows[0][1]), (None, rows[3][1]), (None, rows[4][1])]
    rows += [(900, None), (901, [1.0, 2.0]), (902, [1.0, None, 2.0, 3.0]), (903, [1.0, float("nan"), 2.0, 3.0]), (904, [1.0, float("inf"), 2.0, 3.0]), (905, [])]
    state, cs = centroids.clusters(vectors(spark, rows), k=k, rounds=6, dim=4, stored=stored)
    want, middle = brute(rows, k, 6, 4)
    got = sorted((r.vec_id if r.vec_id is not None else -1, r.own, sum((a - b) ** 2 for a, b in zip(r.v, cs[r.own], strict=True))) for r in state.collect())
    assert cs == middle and got == want


def test_bounds_hold_and_save_work():
    rng = np.random.default_rng(1)
    x = rng.integers(-2000, 2000, (3000, 8)) + 6000 * rng.integers(0, 5, (3000, 1))
    cs = x[:10].copy()
    s = centroids.scan(x, cs, 4)
    for r in range(8):
        new = np.array([x[s.own == c].sum(0) // max(1, (s.own == c).sum()) if (s.own == c).any() else cs[c] for c in range(10)])
        moves = np.sqrt(centroids.squares(cs, new).astype(float)) * (1 + centroids.SLACK)
        cs, keep = new, 4 - r // 3
        s, needed, measured = centroids.settled(x, cs, centroids.moved(s, moves, keep))
        d2 = np.stack([centroids.squares(x, c) for c in cs], 1)
        assert (s.own == d2.argmin(1)).all() and needed.max() <= keep
        d = np.sqrt(d2.astype(float))
        assert (s.upper >= d[np.arange(len(x)), s.own]).all()
        assert (s.low <= np.take_along_axis(d, s.near, 1)).all()
        held = np.zeros_like(d, bool)
        np.put_along_axis(held, s.near, True, 1)
        held[np.arange(len(x)), s.own] = True
        assert (np.where(held, np.inf, d).min(1) >= s.rest).all()
    assert measured.mean() < 5


def test_few_and_no_vectors(spark):
    rows = [(1, [0.5, -0.5]), (2, [0.75, 1.0])]
    state, cs = centroids.clusters(vectors(spark, rows), k=8, rounds=3, dim=2)
    assert len(cs) == 2 and {r.own for r in state.collect()} == {0, 1}
    state, cs = centroids.clusters(vectors(spark, rows).limit(0), k=8, rounds=3, dim=2)
    assert cs == [] and state.collect() == []
    one, cs = centroids.clusters(vectors(spark, rows[:1]), k=8, rounds=3, dim=2)
    assert [r.own for r in one.collect()] == [0]


def test_large_numbers_are_an_error(spark):
    with pytest.raises(Exception, match="exceeds"):
        centroids.clusters(vectors(spark, [(1, [3e8, 0.0])]), dim=2)[0].collect()
