"""What training looks at: only the pairs that are kept, and small nodes of a tree all at once."""

import os

import numpy as np
import pytest

from kinweave.operators import boosting, features
from kinweave.plans import linkage
from kinweave.plans.adapter import tables

DIR = "/root/testdata/sf0.001"


def test_small_nodes_are_finished_once():
    rng = np.random.default_rng(5)
    n, width = 4000, 40
    bins = rng.integers(0, width, (n, 3)).astype(np.uint8)
    y = (bins[:, 0] * 1.0 + 9 * (bins[:, 1] > 20) * (bins[:, 2] > 10) + rng.normal(0, 6, n)) > 24
    g, h = np.rint((0.5 - y) * boosting.UNIT), np.full(n, np.rint(0.25 * boosting.UNIT))
    allowed, calls = np.ones(3, bool), []

    def sums(mine):
        def summed(tree, nodes):
            leaf = tree.walk(bins[mine], tree.bin, np.zeros(len(mine), np.int64))
            return np.stack([boosting._sums(bins[mine][leaf == k], np.zeros(int((leaf == k).sum()), np.int64), g[mine][leaf == k], h[mine][leaf == k], 1, width) for k in nodes])

        return summed

    def finished(tree, nodes, depths):
        calls.append(nodes)
        leaf = tree.walk(bins, tree.bin, np.zeros(n, np.int64))
        return [boosting.explored(sums(np.flatnonzero(leaf == k)), None, int((leaf == k).sum()), boosting.Growth(allowed, 20, d, 10, -1)) for k, d in zip(nodes, depths, strict=True)]

    edges = [np.arange(width - 1) + 0.5] * 3
    every = np.arange(n)
    trees = [boosting.pruned(*boosting.explored(sums(every), finished, n, boosting.Growth(allowed, 20, 0, 10, local)), edges, 0.1, 20) for local in (-1, 1500)]
    assert trees[0] == trees[1] and sum(f >= 0 for f in trees[0].feature) == 19
    assert len(calls) == 1 and len(calls[0]) > 2


@pytest.mark.parametrize("n", [1, 1 << 16, (1 << 16) + 7, 200_001])
def test_packed_sums_are_exact(n):
    rng = np.random.default_rng(n)
    bins, slot = rng.integers(0, 9, (n, 2)).astype(np.uint8), rng.integers(0, 3, n)
    g, h = rng.integers(-(1 << 20), 1 << 20, n).astype(float), np.full(n, float(1 << 18))  # the largest curvature there is
    got = boosting._sums(bins, slot, g, h, 3, 9)
    for f in range(2):
        key = slot * 9 + bins[:, f]
        assert all(np.array_equal(got[i, f], np.bincount(key, w, minlength=27)) for i, w in enumerate((g, h, None)))


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
def test_only_kept_pairs_are_compared_for_training(spark, monkeypatch):
    t, counts, make = tables(spark, DIR), [], features.pairs_of
    monkeypatch.setattr(features, "pairs_of", lambda pairs, a, b: counts.append(pairs.count()) or make(pairs, a, b))
    cands, _, _ = linkage.champion(t.s1, t.targets, t.truth, negatives=1, maxIter=1)
    per_s1 = cands.groupBy("s1_id").count().where("count > 2").count()
    assert per_s1 and counts[0] < cands.count() == counts[1]
