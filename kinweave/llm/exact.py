"""Exact deduplication with an extendible-hash index on shared files. DataFrame functions only.

1. Slots: every row's key (64-bit hash of the normalised text), digest and id are
   written to the shared folder. No text is kept there.
2. Directory: starts with one bucket; while a bucket holds more than its capacity of
   slots it is split by one more bit of the key, and the directory doubles when the
   bucket is already as deep as the directory. It is made from a histogram of key
   prefixes of at most 2**MAX_DEPTH rows, which bounds what the driver holds and what
   is broadcast; the capacity grows with the table, so that this depth is enough. A
   bucket of one key isn't split; it becomes a chain.
3. Build: keys that occur once are no copies, and their texts don't travel: a bitmap of
   the keys that occur again picks the others in the scan. Those go through the directory
   to their bucket, pre-aggregated in each map task, so a hot text sends one row for each
   task. The owner task of a bucket, which is a range of keys, compares the texts of equal
   keys byte by byte, numbers those that differ as the key's chain, and writes the
   bucket's file.
4. Probe: slots of keys that occur again go through the same directory and are joined to
   the entry of their bucket, key and digest; both sides are small rows, and AQE splits a
   hot key's slots.

Input cases. Null text counts as empty, and empty texts are equal to each other. Of
equal texts the largest id stays; a null id stays only if its group has no other. Rows
that repeat both id and text get the same answer. An empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinweave.llm.common import ascii_lower, bit_table, bits_for, fresh, shared_dir, table, with_bit, written

#: the directory has at most 2**MAX_DEPTH entries: 65,536 rows of 24 bytes
MAX_DEPTH = 16
CAPACITY = 50_000


def directory(histogram: dict[int, tuple[int, bool]], max_depth: int, capacity: int) -> tuple[int, list[tuple[int, int]]]:
    """(global depth, [(bucket's first prefix at max_depth, local depth)] for each directory entry).

    ``histogram``: key prefix of ``max_depth`` bits -> (slots, whether they have one key).
    """
    from bisect import bisect_left

    keys = sorted(histogram)
    sums = [0]
    for k in keys:
        sums.append(sums[-1] + histogram[k][0])

    def full(bits: int, depth: int) -> bool:
        lo = bisect_left(keys, bits << (max_depth - depth))
        hi = bisect_left(keys, (bits + 1) << (max_depth - depth))
        one_key = hi - lo == 1 and histogram[keys[lo]][1]
        return sums[hi] - sums[lo] > capacity and not one_key

    depth, entries, todo = 0, [(0, 0)], [(0, 0)]
    while todo:
        bits, local = todo.pop()
        if local == max_depth or not full(bits, local):
            continue
        if local == depth:  # double the directory
            entries = [e for e in entries for _ in range(2)]
            depth += 1
        span = 1 << (depth - local - 1)
        at = bits << (depth - local)
        for half in (0, 1):
            child = (bits << 1 | half, local + 1)
            entries[at + half * span : at + (half + 1) * span] = [child] * span
            todo.append(child)
    return depth, entries


def _norm(text_col: str):
    return ascii_lower(F.coalesce(F.col(text_col), F.lit("")))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, key, bucket, chain for every row. ``capacity``: slots of a bucket."""
    spark = docs.sparkSession
    keyed = docs.select(F.col(id_col).alias("doc_id"), _norm(text_col).alias("norm")).withColumn("key", F.xxhash64("norm"))
    slots = written(keyed.select("doc_id", "key", F.unhex(F.sha2("norm", 256)).alias("digest")), "slots")

    prefix = F.shiftrightunsigned("key", 64 - MAX_DEPTH)
    counts = slots.groupBy(prefix.alias("p")).agg(F.count(F.lit(1)).alias("n"), (F.min("key") == F.max("key")).alias("one")).collect()
    if capacity is None:  # a quarter of the directory's entries would do for keys that are spread evenly
        capacity = max(CAPACITY, sum(r.n for r in counts) >> (MAX_DEPTH - 2))
    depth, entries = directory({r.p: (r.n, r.one) for r in counts}, MAX_DEPTH, capacity)
    rows = [(i, bits << (MAX_DEPTH - local)) for i, (bits, local) in enumerate(entries)]
    found = F.broadcast(spark.createDataFrame(rows, "entry bigint, bucket bigint"))
    entry = F.shiftrightunsigned("key", 64 - depth) if depth else F.lit(0).cast("bigint")
    routed = lambda df: df.withColumn("entry", entry).join(found, "entry").drop("entry")

    again = written(slots.groupBy("key").count().where("count > 1").select("key"), "again")
    bits = bits_for(again.count())
    place = F.pmod("key", F.lit(bits))
    known = bit_table(again.select(place), bits)
    texts = routed(with_bit(keyed, place, known, "again").where("again"))
    texts = texts.groupBy("bucket", "key", "norm").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    owned = texts.repartition("bucket").withColumn("chain", F.row_number().over(Window.partitionBy("bucket", "key").orderBy("norm")))
    owned = owned.select("key", "chain", F.unhex(F.sha2("norm", 256)).alias("digest"), "keep_id", "group_size", "bucket")
    path = f"{shared_dir(spark)}/index"
    owned.write.partitionBy("bucket").parquet(path)
    index = spark.read.schema(owned.schema).parquet(path)

    slots = routed(with_bit(slots, place, known, "again"))
    one = slots.where("not again").withColumns({"keep_id": F.col("doc_id"), "group_size": F.lit(1).cast("bigint"), "chain": F.lit(1)}).drop("again")
    more = slots.where("again").drop("again").join(index, ["bucket", "key", "digest"])
    return one.unionByName(more).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.coalesce(F.col("doc_id").eqNullSafe(F.col("keep_id")), F.lit(False)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "key",
        "bucket",
        "chain",
    )


def survivors(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns. Rows that repeat id and text count once.

    Texts of groups of one row pass in the scan; only those that a bitmap of the other groups' keys knows are joined.
    """
    groups = written(exact_groups(docs, **options).where("group_size > 1"), "groups")
    again = not groups.where("kept").groupBy("doc_id", "text_sha256").count().where("count > 1").isEmpty()
    keys = groups.select("key").distinct()
    bits = bits_for(keys.count())
    own, left, right, maybe = fresh(docs, "own", "id", "digest", "maybe")
    gone = groups.where("not kept").select(F.col("doc_id").alias(left), F.col("text_sha256").alias(right)).distinct()
    norm = _norm("text")
    tested = with_bit(docs, F.pmod(F.xxhash64(norm), F.lit(bits)), bit_table(keys.select(F.pmod("key", F.lit(bits))), bits), maybe)
    stay = tested.where(maybe).withColumn(own, F.sha2(norm, 256))
    stay = stay.join(gone, F.col("doc_id").eqNullSafe(F.col(left)) & (F.col(own) == F.col(right)), "left_anti")
    if again:
        stay = stay.dropDuplicates(["doc_id", own])
    return tested.where(~F.col(maybe)).select(docs.columns).unionByName(stay.select(docs.columns))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_groups(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP6_SQL = """
SELECT doc_id,
       max(doc_id) OVER w AS keep_id,
       count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept,
       sha256(norm) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
      FROM documents)
WINDOW w AS (PARTITION BY norm)
"""
