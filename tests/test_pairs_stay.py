"""Pairs are many and compress well, so their table must not be broadcast for being few bytes on disk."""

from pyspark.sql import functions as F

from kinweave.checkpoint import written
from kinweave.operators import features


def test_pairs_are_not_broadcast(spark):
    ids = lambda side, n: written(spark.range(n).select(F.concat(F.lit(side), "id").alias("entity_id"), F.sha2(F.col("id").cast("string"), 512).alias("x"), F.lit("US").alias("country")))
    s1, t = ids("S1-", 3000), ids("S2-", 50)
    pairs = written(spark.range(500).select(F.concat(F.lit("S1-"), F.col("id") % 40).alias("s1_id"), F.concat(F.lit("S2-"), F.col("id") % 50).alias("t_id")))
    joined = features.pairs_of(pairs, s1, t)
    plan = joined._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("SortMergeJoin") == 1 and "SortMergeJoin [s1_id" in plan
    assert joined.count() == 500
