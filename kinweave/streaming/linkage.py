"""New target records against a static source 1, in micro-batches.

The source-1 side is normalised and keyed once, as written tables; keys that more than
``max_posting`` of its records have are cut there, so a hot key doesn't multiply with every
batch. Each micro-batch is normalised, joined on its keys and scored; of each target the
``top`` best candidates go on, as in ``blocking.candidates`` seen from the target, since a
batch can't know the targets to come. ``foreachBatch`` gets a batch id, so
a batch that is run again after a failure replaces its own output. With ``assigned`` the global
unique assignment is kept up to date by ``UniqueMatches``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinweave.checkpoint import drop, written
from kinweave.graph import components
from kinweave.operators import blocking, features, selection
from kinweave.operators.records import normalize_records


class UniqueMatches:
    """Global unique assignment (L-5) of edges that arrive in batches, equal after each batch to that of all edges so far.

    An assignment is decided inside each connected component of the edges. A batch's edges touch
    some components; those are read, joined with the new edges into new components, and assigned
    anew. The log in ``path`` has a folder for each batch: the edges of the components it made,
    with ``kept``, and a tombstone for each component it replaced. Nothing else is read or
    written, so a batch costs what it touches. A batch that is run again reads only the batches
    before it and replaces its own folder. An edge that arrives again has its new score.
    """

    SCHEMA = "root string, s1_id string, t_id string, score double, kept boolean, dead boolean, batch bigint"

    def __init__(self, path: str, min_score: float = 0.85, margin: float = 0.08, cap: int = 3):
        self.path, self.rule = path, {"min_score": min_score, "margin": margin, "cap": cap}

    def edges(self, spark: SparkSession, before: int | None = None) -> DataFrame:
        """The edges of all living components, as they were before a batch."""
        jvm = spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(self.path)
        if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
            return spark.createDataFrame([], self.SCHEMA)
        log = spark.read.schema(self.SCHEMA).option("basePath", self.path).parquet(self.path)
        if before is not None:
            log = log.where(F.col("batch") < before)
        return log.where("not dead").join(log.where("dead").select("root").distinct(), "root", "left_anti")

    def matches(self, spark: SparkSession) -> DataFrame:
        return self.edges(spark).where("kept").select("s1_id", "t_id", "score")

    def update(self, scored: DataFrame, batch: int) -> None:
        """Take in the edges (s1_id, t_id, score) of a batch."""
        spark = scored.sparkSession
        new = written(scored.groupBy("s1_id", "t_id").agg(F.max("score").alias("score")), "new")
        old = self.edges(spark, batch)
        by = lambda c: old.join(new.select(c).distinct(), c, "left_semi").select("root")
        touched = written(by("s1_id").union(by("t_id")).distinct(), "touched")
        region = old.join(touched, "root", "left_semi").join(new, ["s1_id", "t_id"], "left_anti").select("s1_id", "t_id", "score").unionByName(new)
        region = written(region, "region")
        node = lambda kind, c: F.concat(F.lit(kind), F.col(c))
        kept = selection.unique_assignment(region, **self.rule)
        rows = region.withColumn("node", node("s", "s1_id"))
        if not region.isEmpty():
            roots = components(region.select(node("s", "s1_id").alias("a"), node("t", "t_id").alias("b")))
            rows = rows.join(roots, "node")
        else:
            rows = rows.withColumn("root", F.lit(""))
        rows = rows.join(kept.select("s1_id", "t_id", F.lit(True).alias("kept")), ["s1_id", "t_id"], "left")
        live = rows.select(F.concat(F.lit(f"{batch}:"), "root").alias("root"), "s1_id", "t_id", "score", F.coalesce("kept", F.lit(False)).alias("kept"), F.lit(False).alias("dead"))
        gone = touched.withColumn("dead", F.lit(True))
        live.unionByName(gone, allowMissingColumns=True).write.mode("overwrite").parquet(f"{self.path}/batch={batch}")
        drop(new, touched, region, kept)


class StreamLinker:
    def __init__(self, s1: DataFrame, out: str, min_score: float = 0.5, max_posting: int = 2000, top: int = 30, assigned: UniqueMatches | None = None):
        self.records = written(normalize_records(s1))
        keys, by = blocking.blocking_keys(self.records).withColumnRenamed("entity_id", "s1_id").distinct(), ["country", "key_type", "key"]
        small = keys.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= max_posting).drop("n")
        self.keys = written(keys.join(small, by))
        self.out, self.min_score, self.top, self.assigned = out, min_score, top, assigned

    def score(self, batch: DataFrame) -> DataFrame:
        """s1_id, t_id, score of a batch of target entities."""
        targets = normalize_records(batch.dropDuplicates(["entity_id"]))
        posts = blocking.blocking_keys(targets).withColumnRenamed("entity_id", "t_id").distinct()
        pairs = self.keys.join(posts, ["country", "key_type", "key"]).select("s1_id", "t_id").distinct()
        both = features.pairs_of(pairs, self.records, targets)
        near = blocking.token_jaccard(F.col("a_name_tokens"), F.col("b_name_tokens"))
        best = Window.partitionBy("t_id").orderBy(F.desc("_near"), "s1_id")
        both = both.withColumn("_near", near).withColumn("_rank", F.row_number().over(best)).where(F.col("_rank") <= self.top)
        rows = features.features14(both, cosines=False)
        return rows.select("s1_id", "t_id", F.col("combined_jaccard").alias("score")).where(F.col("score") >= self.min_score)

    def batch(self, df: DataFrame, batch_id: int) -> None:
        path = f"{self.out}/batch={batch_id}"
        self.score(df).write.mode("overwrite").parquet(path)
        if self.assigned is not None:
            self.assigned.update(df.sparkSession.read.parquet(path), batch_id)

    def start(self, stream: DataFrame, checkpoint: str, **trigger):
        """A running query over a stream of entities."""
        return stream.writeStream.foreachBatch(self.batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
