"""Scans (S-1 to S-9). Empty CSV fields are NULL in Spark; every reader turns them into empty strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinweave.checkpoint import drop, written
from kinweave.schema import ENTITY


def entities(spark: SparkSession, path: str, country: str | None = None, ordered: bool = False) -> DataFrame:
    """A TSV source with header, optionally one country (S-1, S-5, S-7): short rows get empty columns.

    ``ordered`` adds ``ord``, the place of a row (K-2, P-7): its file, where its split begins, and its
    number in the split, so it is file order whatever splits a scan makes and however they are dealt.
    """
    df = spark.read.schema(ENTITY).option("sep", "\t").option("header", True).option("mode", "PERMISSIVE").option("quote", "").csv(path)
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("row"))
    df = df.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ENTITY.names], *([place.alias("ord")] if ordered else []))
    return df if country is None else df.where(F.trim("country") == country)


def parquet(spark: SparkSession, path: str, country: str | None = None) -> DataFrame:
    """The same from Parquet; the filter and the columns reach the scan."""
    df = spark.read.parquet(path).select(*ENTITY.names)
    return df if country is None else df.where(F.trim("country") == country)


def sample(df: DataFrame, n: int) -> DataFrame:
    """The n rows with the smallest ids (S-2, S-3): a sort with a limit, the same on every run."""
    return df.orderBy("entity_id").limit(n)


def row_range(df: DataFrame, offset: int, length: int, by: str = "entity_id") -> DataFrame:
    """Rows offset .. offset + length in the order of ``by`` (S-4); rows with one value of ``by`` are in the order of a hash.

    Keys alone are dealt into ranges and sorted; a range's rows are counted, so the keys at both
    ends of the slice are known without a task that sees all rows. Then the scan takes what lies
    between them. Equal rows at an end are told apart by number.
    """
    spark, own = df.sparkSession, F.xxhash64(*df.columns)
    keys = df.select(F.col(by).alias("v"), own.alias("h"))
    at = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    ranged = written(keys.repartitionByRange(F.asc_nulls_first("v"), "h").sortWithinPartitions(F.asc_nulls_first("v"), "h").select("v", "h", F.spark_partition_id().alias("p"), at.alias("i")), "ranges")
    sizes = sorted((r.p, r["count"]) for r in ranged.groupBy("p").count().collect())  # one row for each range
    total = sum(n for _, n in sizes)
    offset, end = max(0, offset), min(max(0, offset) + max(0, length), total)
    if offset >= end:
        return df.limit(0)

    def key_at(place: int) -> tuple:
        """(value, hash, rows of this key before the place)"""
        for p, n in sizes:
            if place < n:
                break
            place -= n
        row = ranged.where((F.col("p") == p) & (F.col("i") == place)).first()
        before = ranged.where((F.col("p") == p) & (F.col("i") < place) & F.col("v").eqNullSafe(F.lit(row.v)) & (F.col("h") == row.h)).count()
        return row.v, row.h, before

    (v1, h1, skipped), (v2, h2, before) = key_at(offset), key_at(end - 1)
    drop(ranged)
    kind = df.schema[by].dataType
    lit = lambda v: F.lit(v).cast(kind)
    order = lambda v: F.struct(F.lit(v is not None), lit(v))
    here = F.struct(F.col(by).isNotNull(), F.col(by).cast(kind))
    span = df if v1 is None else df.where(F.col(by) >= lit(v1))  # these reach the scan
    if v1 is not None and v2 is not None:
        span = span.where(F.col(by) <= lit(v2))
    low, high = F.struct(order(v1), F.lit(h1)), F.struct(order(v2), F.lit(h2))
    me = F.struct(here, own)
    inner = span.where((me > low) & (me < high))
    one = (v1, h1) == (v2, h2)
    ends = span.where((me == low) | (me == high)).withColumn("_low", me == low)
    ends = ends.withColumn("_n", F.row_number().over(Window.partitionBy("_low").orderBy(F.lit(0))))
    # equal rows: those after the skipped ones at the first key, those up to the end at the last
    ends = ends.where((F.col("_n") > skipped) & (F.col("_n") <= before + 1)) if one else ends.where(F.when(F.col("_low"), F.col("_n") > skipped).otherwise(F.col("_n") <= before + 1))
    return inner.unionByName(ends.drop("_low", "_n")).orderBy(F.asc_nulls_first(by), own)


def needed(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose entity_id is in ``ids`` (S-6)."""
    return df.join(ids.select("entity_id").distinct(), "entity_id", "left_semi")


def id_list(col: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(col, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def results(spark: SparkSession, path: str, comma: bool = False) -> DataFrame:
    """s1_id, t_id, idx of a result file, ``idx`` null and t_id null for an empty list (S-8)."""
    lines = spark.read.text(path).where(~F.lower("value").startswith("source1_entity_id"))
    parts = F.split("value", "," if comma else "\t", 2)
    rows = lines.select(F.trim(parts[0]).alias("s1_id"), id_list(F.replace(F.coalesce(F.get(parts, F.lit(1)), F.lit("")), F.lit('"'), F.lit(""))).alias("ids"))
    return rows.select("s1_id", F.posexplode_outer("ids").alias("idx", "t_id"))


def truth(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(entities, long truth) of a ground-truth TSV: singletons stay in the first."""
    rows = results(spark, path)
    return rows.select(F.col("s1_id").alias("entity_id")).distinct(), rows.where(F.col("t_id").isNotNull()).select("s1_id", "t_id")


def raw_lines(spark: SparkSession, path: str) -> DataFrame | None:
    """The lines of a text file; None if there is no such file."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return None
    return spark.read.text(path)


def keep_first(df: DataFrame, by: str = "entity_id", order: str = "ord") -> DataFrame:
    """The first row for each id."""
    w = Window.partitionBy(by).orderBy(order)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
