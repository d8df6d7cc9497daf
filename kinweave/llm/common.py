"""What the operators of this package share: tables, batches, bitmaps, components."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from contextlib import suppress

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.checkpoint import drop, shared_dir, written  # noqa: F401
from kinweave.graph import components  # noqa: F401

#: What separates words: the blank and the ASCII controls from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: rows and bytes of an Arrow batch
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """From now on the session's Arrow batches have at most ``BATCH_ROWS`` rows and ``BATCH_BYTES`` bytes or one row, so that texts on both sides of a Python worker's pipe stay small."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key)
        now = int(now) if now.lstrip("-").isdigit() else 0
        if not 0 < now <= most:
            spark.conf.set(key, str(most))


def freed() -> None:
    """Give memory that Python doesn't use back to the system, as a worker lives on after its task."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def arrow_map(df: DataFrame, run, schema: str) -> DataFrame:
    """``mapInArrow`` over bounded batches; a worker gives its memory back at the end of a task."""
    bounded_batches(df.sparkSession)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        freed()

    return df.mapInArrow(task, schema)


def ascii_lower(col):
    """A-Z only. Pure ASCII strings take the byte-wise built-in."""
    slow = F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.length(col) == F.octet_length(col), F.lower(col)).otherwise(slow)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, changed where ``df`` has such columns already."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def bitmap(place: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of the values in the one column of ``place``, all below ``bits``; OR-ed in the cluster, so the driver gets ``bits`` at most."""
    v = F.col("v")
    words = place.toDF("v").groupBy(F.shiftright(v, 15).alias("w")).agg(F.bitmap_construct_agg(v.bitwiseAND(32767)).alias("bits"))
    out = np.zeros(-(-bits // 32768) * 4096, np.uint8)
    for r in words.toLocalIterator():
        out[r["w"] * 4096 : (r["w"] + 1) * 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out


def bits_for(rows: int, most: int = 1 << 27) -> int:
    """A bitmap's length for so many values: 16 places or more for each, up to ``most`` (16 MiB)."""
    return min(most, max(1 << 16, 1 << (16 * rows).bit_length()))


def bit_table(place: DataFrame, bits: int) -> DataFrame:
    """w, bits: a bitmap of the values in the one column of ``place``, all below ``bits``, as ``bits`` / 32768 rows of 4 KB."""
    v = F.col("v")
    return place.toDF("v").groupBy(F.shiftright(v, 15).alias("w")).agg(F.bitmap_construct_agg(v.bitwiseAND(32767)).alias("bits"))


def with_bit(df: DataFrame, place, table: DataFrame, name: str) -> DataFrame:
    """``df`` and the boolean column ``name``: whether the value of ``place`` is in the bitmap. Built-in functions; the table's size is bounded, so it is broadcast."""
    at, w, held = fresh(df, name + "_at", name + "_w", name + "_held")
    known = F.broadcast(table.select(F.col("w").alias(w), F.col("bits").alias(held)))
    out = df.withColumn(at, place).join(known, F.shiftright(at, 15) == F.col(w), "left")
    byte = F.conv(F.hex(F.substring(F.col(held), F.shiftright(F.col(at).bitwiseAND(32767), 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = byte.bitwiseAND(F.element_at(F.array(*[F.lit(1 << i) for i in range(8)]), F.col(at).bitwiseAND(7).cast("int") + 1))
    return out.withColumn(name, F.coalesce(bit != 0, F.lit(False))).drop(at, w, held)


def test_bits(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return bits[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1


def in_bitmap(bits: np.ndarray, spark: SparkSession):
    """A function of a bigint column: whether its value is in the bitmap."""
    shared = spark.sparkContext.broadcast(bits)

    @F.pandas_udf("boolean")
    def known(at: pd.Series) -> pd.Series:
        return pd.Series(test_bits(shared.value, at.to_numpy()))

    return known
