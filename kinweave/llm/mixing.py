"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Each source is a line of words: its documents in an order shuffled by a hash of the id,
read round and round up to the source's target. The line is cut into blocks of ``block``
words; the last one ends where the target is met. A source has as many points as blocks.

The schedule has 2**k slots. Slot i looks up the van der Corput point of i, its k bits in
reverse, in the cumulative numbers of points: the source whose interval holds it has the
slot (points behind the last interval belong to none). Slots are ranked in each source,
and rank r takes block r. Both directions are arithmetic: the points of an interval are
counted off and reversed, and the rank of a slot is a sum over its bits, so neither a
search nor a sort is needed, and a source with a third of all blocks is many tasks.

``schedule`` gives the mix as rows (slot, source, block, row, lap, begin, stop): which
words of which document stand where. How many words ``mix`` takes of a document is the
sum of those rows, and ``mixed_documents`` writes documents in the order of the slots. A
document of several blocks stays whole, at the slot of the block it begins in.

Bounds. ``block`` is ``BLOCK_WORDS``, or less where the mix would have under ``MIN_SLOTS``
slots. The driver gets one row for each source. Positions on the line come from sums in
hash buckets and sums of buckets.

Input cases. Null text has size 0; a null source is a source, the last one; documents of
size 0 take 0. Repeated rows are documents of their own. Empty table: no rows. The order
depends on ids and sizes only, so reruns agree.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinweave.llm.common import WORD, fresh, table, written

MIN_SLOTS, BLOCK_WORDS, BUCKET_ROWS = 1 << 17, 256, 1000
#: points that one row of the driver's plan is unfolded to at a time
POINTS_EACH = 1 << 15


def targets(sizes: Sequence[int], weights: Sequence[float], share: float, cap: float) -> list[float]:
    """Shares of ``share * sum(sizes)`` by weight, none above ``cap`` times its size; the excess is shared again."""
    out, free, left = [0.0] * len(sizes), list(range(len(sizes))), share * sum(sizes)
    while free:
        per = left / sum(weights[i] for i in free)
        over = [i for i in free if per * weights[i] > cap * sizes[i]]
        if not over:
            for i in free:
                out[i] = per * weights[i]
            break
        for i in over:
            out[i] = cap * sizes[i]
            left -= out[i]
        free = [i for i in free if i not in set(over)]
    return out


def van_der_corput(i: Column, bits: int) -> Column:
    """The numerator of the point of ``i`` over 2**bits: its bits in reverse. It is its own inverse."""
    return F.conv(F.reverse(F.lpad(F.bin(i), bits, "0")), 2, 10).cast("bigint")


def slots_before(point: Column, low: Column, high: Column, bits: int) -> Column:
    """How many slots before that of ``point`` have points from ``low`` to below ``high``.

    The slots before i fall into runs that share i's upper bits and have one bit less; the
    points of such a run are an arithmetic progression, whose members below a limit are counted.
    """
    total = F.lit(0).cast("bigint")
    for m in range(bits):
        first = point.bitwiseAND((1 << m) - 1)
        below = lambda limit: F.greatest(F.lit(0), F.shiftright(limit - first + ((2 << m) - 1), m + 1))  # noqa: B023, E731
        total = total + F.when(point.bitwiseAND(1 << m) != 0, below(high) - below(low)).otherwise(0)
    return total


class Schedule(NamedTuple):
    """``slots``: their number; ``line``: a row for each document; ``pieces``: slot, s, block, row, lap, begin, stop, copy (words of that lap)."""

    slots: int
    line: DataFrame
    pieces: DataFrame


def _schedule(docs: DataFrame, weights: Sequence[float], share: float, cap: float, seed: int) -> Schedule:
    spark = docs.sparkSession
    sized = docs.select(
        "doc_id",
        "source",
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
        F.xxhash64("text").alias("digest"),
    ).withColumn("ord", F.xxhash64(F.lit(seed), F.col("doc_id").cast("string")))
    # row ids are made once and written, so every later read sees the same ones
    sized = written(sized.withColumn("row", F.monotonically_increasing_id()), "sizes")

    totals = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect()
    totals.sort(key=lambda r: (r.source is None, (r.source or "").encode()))
    goal = targets([r["size"] for r in totals], [weights[i % len(weights)] for i in range(len(totals))], share, cap)
    block = min(BLOCK_WORDS, max(1, int(sum(goal)) // MIN_SLOTS))
    plan, low = [], 0
    for i, (r, want) in enumerate(zip(totals, goal, strict=True)):
        take = min(round(want), int(cap * r["size"]))
        points = max(1, round(take / block)) if take else 0
        plan.append((i, r.source, r["size"], float(want), take, points, low))
        low += points
    bits = max(1, (low - 1).bit_length())
    kind = docs.schema["source"].dataType.simpleString()
    sources = spark.createDataFrame(plan, f"s int, name {kind}, source_size bigint, target double, take bigint, points bigint, low bigint")

    chunks = sources.where("points > 0").select("s", "points", "low", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("points") - 1) / POINTS_EACH))).alias("c"))
    tasks = min(low // POINTS_EACH, int(spark.conf.get("spark.sql.shuffle.partitions")))
    chunks = chunks.repartition(max(1, tasks, low >> 24))
    first = F.col("low") + F.col("c") * POINTS_EACH
    points = chunks.select("s", "low", (F.col("low") + F.col("points")).alias("high"), F.explode(F.sequence(first, F.least(first + POINTS_EACH, F.col("low") + F.col("points")) - 1)).alias("point"))
    point = F.col("point")
    slots = points.select("s", van_der_corput(point, bits).alias("slot"), slots_before(point, F.col("low"), F.col("high"), bits).alias("block"))

    known = sized.join(sources, F.col("source").eqNullSafe(F.col("name"))).drop("name", "low")
    parts = max(0, (sum(r.n for r in totals) // BUCKET_ROWS).bit_length())
    bucket = F.shiftrightunsigned("ord", 64 - parts) if parts else F.lit(0).cast("bigint")
    known = known.withColumn("bucket", bucket)
    before = known.groupBy("s", "bucket").agg(F.sum("size").alias("words"))
    before = before.withColumn("offset", F.sum("words").over(Window.partitionBy("s").orderBy("bucket")) - F.col("words"))
    inside = Window.partitionBy("s", "bucket").orderBy("ord", "doc_id", "size", "row")
    line = known.withColumn("upto", F.sum("size").over(inside)).join(before.drop("words"), ["s", "bucket"])
    line = line.withColumn("start", F.col("offset") + F.col("upto") - F.col("size"))

    laps = F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("take") - 1 - F.col("start")) / F.col("source_size")))
    copies = line.where("size > 0 AND start < take").select("row", "s", "size", "take", "points", "source_size", "start", F.explode(laps).alias("lap"))
    copies = copies.withColumn("from", F.col("lap") * F.col("source_size") + F.col("start")).withColumn("to", F.least(F.col("from") + F.col("size"), "take"))
    last = F.col("points") - 1  # the last block takes what is left up to the target
    cuts = F.sequence(F.least(F.floor(F.col("from") / block), last), F.least(F.floor((F.col("to") - 1) / block), last))
    cuts = copies.select("row", "s", "lap", "from", "to", "points", F.explode(cuts).alias("block"))
    # the slots come from the driver's few rows, so Spark takes them for small: they are to be shuffled, not broadcast
    pieces = cuts.join(slots.hint("merge"), ["s", "block"])
    begin = F.greatest(F.col("from"), F.col("block") * block) - F.col("from")
    end = F.when(F.col("block") == last, F.col("to")).otherwise(F.least("to", (F.col("block") + 1) * block)) - F.col("from")
    return Schedule(1 << bits, line, pieces.select("slot", "s", "block", "row", "lap", begin.alias("begin"), end.alias("stop"), (F.col("to") - F.col("from")).alias("copy")))


OPTIONS = {"weights": (5, 2, 1), "share": 1.5, "cap": 2.0, "seed": 7}


def schedule(docs: DataFrame, **options) -> DataFrame:
    """slot, source, block, doc_id, row, lap, begin, stop: the words begin to stop (not itself) of a document stand at a slot."""
    _, line, pieces = _schedule(docs, **(OPTIONS | options))
    return pieces.join(line.select("row", "doc_id", "source"), "row").select("slot", "source", "block", "doc_id", "row", "lap", "begin", "stop")


def mix(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken, slots, source, row, digest for every row of ``docs`` (doc_id, text, source).

    ``slots`` has (slot, words, place) for each time that the row is taken: where it begins, how
    many of its words are taken then, and its place among what begins at that slot. Options: ``OPTIONS``.
    """
    return _mixed(_schedule(docs, **(OPTIONS | options)))


def _mixed(plan: Schedule) -> DataFrame:
    _, line, pieces = plan
    begun = F.when(F.col("begin") == 0, F.struct("slot", F.col("copy").alias("words")))
    taken = pieces.groupBy("row").agg(F.sum(F.col("stop") - F.col("begin")).alias("taken"), F.sort_array(F.collect_list(begun)).alias("slots"))
    places = F.transform("slots", lambda x: F.struct(x["slot"].alias("slot"), F.col("start").alias("at"), x["words"].alias("words")))
    return line.join(taken, "row", "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"), places.alias("slots"), "source", "row", "digest"
    )


def mixed_documents(docs: DataFrame, order: str | None = None, **options) -> DataFrame:
    """The mix as documents in the order of the schedule: a row for each full time that a document is taken, and its leading words where it is cut.

    Rows are found by id, digest of the text and source; those that repeat all three are
    documents of their own. ``order`` names a column to add: the place (slot, first word on the line).
    """
    keys = ["doc_id", "digest", "source"]
    own, digest, source, size, slots, place, twin, left, right = fresh(docs, "id", "digest", "own_source", "size", "slots", "place", "twin", "copy", "copy_of")
    spark = docs.sparkSession
    plan = _schedule(docs, **(OPTIONS | options))
    took = written(_mixed(plan).where("taken > 0").select(*keys, "size", "row", "slots"), "took")
    again = not took.groupBy(*keys).count().where("count > 1").isEmpty()
    took = took.withColumnsRenamed(dict(zip([*keys, "size", "slots"], [own, digest, source, size, slots], strict=True)))
    text = docs.withColumn(twin, F.xxhash64("text"))
    same = F.col("doc_id").eqNullSafe(F.col(own)) & (F.col(twin) == F.col(digest)) & F.col("source").eqNullSafe(F.col(source))
    if again:  # rows that repeat id, text and source are numbered on both sides
        text = text.withColumn(left, F.row_number().over(Window.partitionBy("doc_id", twin, "source").orderBy(F.xxhash64(*docs.columns))))
        took = took.withColumn(right, F.row_number().over(Window.partitionBy(own, digest, source).orderBy("row")))
        same = same & (F.col(left) == F.col(right))
    out = text.join(took.drop("row"), same).withColumn(place, F.explode(slots))
    words = F.col(place)["words"]
    cut = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), F.lit(1), words.cast("int")), " ")
    out = out.withColumn("text", F.when(words < F.col(size), cut).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    # slots are spread evenly, so ranges of them need no sample of the data: part i of the table has the i-th range
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    part = F.floor(F.col(place)["slot"] * parts / F.lit(plan.slots)).cast("int")
    out = out.repartitionById(parts, part).sortWithinPartitions(F.col(place)["slot"], F.col(place)["at"])
    at = F.struct(F.col(place)["slot"].alias("slot"), F.col(place)["at"].alias("at"))
    return out.select(*docs.columns, *([at.alias(order)] if order else []))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents"))
    where = F.transform("slots", lambda x: x["slot"])
    return out.select("doc_id", "size", "source_size", "target", "taken", F.array_join(where.cast("array<string>"), ",").alias("slots"))
