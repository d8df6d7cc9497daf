"""Connected components by joins and pre-aggregated minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.checkpoint import drop, written


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): each node that has an edge, with the smallest node it can reach.

    ``edges`` has two columns ``a`` and ``b`` of one type that has an order. Every round moves
    each node to the smallest label among its neighbours and then to that label's own label;
    both steps are pre-aggregated minima, so a hub of any degree stays cheap. Rounds end when
    no label moves; a path of length n takes about log n. ``edges`` is read in every round.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).where("a <> b")
    label, last = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("root")), None
    for _ in range(rounds):
        near = both.join(label, both.b == label.node).groupBy(both.a.alias("n")).agg(F.min("root").alias("low"))
        moved = label.join(near, label.node == near.n).select("node", "root", F.least("root", "low").alias("low"))
        far = label.select(F.col("node").alias("low"), F.col("root").alias("far"))
        # the old root learns of the smaller label too, so whole trees hook at once
        hook = moved.where("low < root").groupBy(F.col("root").alias("h")).agg(F.min("low").alias("hooked"))
        new = (
            moved.join(far, "low", "left")
            .join(hook, F.col("node") == F.col("h"), "left")
            .select("node", F.col("root").alias("was"), F.least("low", "far", "hooked").alias("root"))
        )
        new = written(new, "label")
        if last is not None:
            drop(last)
        label, last = new.select("node", "root"), new
        label._scratch = new._scratch  # a caller may drop it
        if new.where("was <> root").isEmpty():
            return label
    raise RuntimeError(f"components are not settled after {rounds} rounds")
