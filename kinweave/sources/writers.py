"""Sinks (K-1 to K-9)."""

from __future__ import annotations

import struct
import zlib
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinweave.checkpoint import drop, written


def wide(s1: DataFrame, pairs: DataFrame, column: str = "matched_entity_ids", order: str = "idx") -> DataFrame:
    """source1_entity_id and a comma list for every s1, empty ones included (K-1). Lists are in the order of ``order``, then id."""
    lists = pairs.groupBy("s1_id").agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), "t_id"))).alias("l"))
    joined = F.coalesce(F.concat_ws(",", F.transform("l", lambda x: x["t_id"])), F.lit(""))
    more = [c for c in ("ord",) if c in s1.columns]
    return s1.select(F.col("entity_id").alias("source1_entity_id"), *more).join(lists, F.col("source1_entity_id") == F.col("s1_id"), "left").select(
        "source1_entity_id", joined.alias(column), *more
    )


def write_tsv(table: DataFrame, path: str, mode: str = "overwrite", ordered: bool = False) -> None:
    """A TSV with header; ``ordered`` by ``ord`` (K-2), ``mode='append'`` adds to what is there (K-6)."""
    if ordered:
        table = table.orderBy("ord")
    table.drop("ord").write.mode(mode).option("sep", "\t").option("header", mode != "append").option("quote", "").option("emptyValue", "").csv(path)


def write_csv(table: DataFrame, path: str, quoted: bool = False) -> None:
    """K-3: the list's commas are quoted, or not, as the profile has it."""
    if quoted:
        table.drop("ord").write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)
    else:
        names = [c for c in table.columns if c != "ord"]
        table.select(F.concat_ws(",", *names).alias("value")).write.mode("overwrite").text(path)


def write_partitioned(table: DataFrame, path: str, by: str = "country") -> None:
    """Parquet by country: later reads of one country skip the others' files."""
    table.write.mode("overwrite").partitionBy(by).parquet(path)


#: sizes and offsets stand in the ZIP64 fields, so no archive is too large for the format
_ABOVE = 0xFFFFFFFF


def _entry(signature: int, more: bytes, name: bytes, crc: int, tail: bytes, extra: bytes) -> bytes:
    """A local header or a directory entry: versions, UTF-8 names, deflate, 1 January 1980."""
    return struct.pack("<I", signature) + more + struct.pack("<HHHHHIIIHH", 45, 0x800, 8, 0, 33, crc, _ABOVE, _ABOVE, len(name), len(extra)) + tail + name + extra


def deflated(spark: SparkSession, folder: str) -> DataFrame:
    """name, crc, size, packed (a raw deflate stream) of a folder's part files: one task packs a file."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(folder)

    def run(batches):
        for b in batches:
            for path, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                data = data.as_py()
                packer = zlib.compressobj(6, zlib.DEFLATED, -15)
                packed = packer.compress(data) + packer.flush()
                yield pa.RecordBatch.from_pydict({"name": [path], "crc": [zlib.crc32(data)], "size": [len(data)], "packed": pa.array([packed], pa.binary())})

    return files.select("path", "content").mapInArrow(run, "name string, crc bigint, size bigint, packed binary")


def package(spark: SparkSession, folder: str, archive: str) -> str:
    """K-4: a deflated ZIP, a file of the driver's, of a result folder's part files on any file system.

    Tasks read, check and deflate the files; the driver writes one packed file after another
    behind its header, and then the directory, whose entries are all that it keeps.
    """
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    base = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).getPath().toString()
    pieces = written(deflated(spark, folder), "zip")
    directory = b""
    with open(archive, "wb") as out:
        for r in pieces.select("name", "crc", "size").orderBy("name").collect():  # one row for each file
            packed = bytes(pieces.where(F.col("name") == r.name).first().packed)
            name = unquote(r.name).removeprefix(unquote(base)).lstrip("/").encode()
            at, sizes = out.tell(), struct.pack("<QQ", r.size, len(packed))
            out.write(_entry(0x04034B50, b"", name, r.crc, b"", struct.pack("<HH", 1, 16) + sizes))
            out.write(packed)
            directory += _entry(0x02014B50, struct.pack("<H", 45), name, r.crc, struct.pack("<HHHII", 0, 0, 0, 0, _ABOVE), struct.pack("<HH", 1, 24) + sizes + struct.pack("<Q", at))
        n, start = pieces.count(), out.tell()
        out.write(directory)
        end = out.tell()
        out.write(struct.pack("<IQHHIIQQQQ", 0x06064B50, 44, 45, 45, 0, 0, n, n, len(directory), start))
        out.write(struct.pack("<IIQI", 0x07064B50, 0, end, 1))
        out.write(struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, min(n, 0xFFFF), min(n, 0xFFFF), _ABOVE, _ABOVE, 0))
    drop(pieces)
    return archive


def promote(spark, new: str, current: str) -> None:
    """K-5: rename a result to the current name; what was current is kept beside it."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(new).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(path(current)):
        old = path(f"{current}.previous")
        if fs.exists(old):
            fs.delete(old, True)
        fs.rename(path(current), old)
    fs.rename(path(new), path(current))


def log_experiment(spark, row: dict, path: str) -> None:
    """K-7: one more line of an experiment log; every part carries its header."""
    df = spark.createDataFrame([{k: str(v) for k, v in row.items()}]).withColumn("logged_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss"))
    df.coalesce(1).write.mode("append").option("header", True).csv(path)


def write_report(table: DataFrame, path: str, kind: str = "json") -> None:
    """K-8: profiles and examples as JSON or CSV."""
    getattr(table.coalesce(1).write.mode("overwrite").option("header", True), kind)(path)


def markdown(title: str, row: dict) -> str:
    """K-8: a small report of one aggregated row."""
    return "\n".join([f"# {title}", "", "| measure | value |", "|-|-|", *(f"| {k} | {v} |" for k, v in row.items())]) + "\n"


def write_validation_split(s1: DataFrame, targets: DataFrame, truth: DataFrame, path: str) -> None:
    """K-9: three TSVs."""
    write_tsv(s1, f"{path}/val_s1")
    write_tsv(targets, f"{path}/val_targets")
    rows = truth.withColumn("idx", F.row_number().over(Window.partitionBy("s1_id").orderBy("t_id")))
    write_tsv(wide(s1, rows), f"{path}/val_gt")
