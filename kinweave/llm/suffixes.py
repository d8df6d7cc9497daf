"""Removal of long repeated byte strings, by sorting suffixes in buckets behind a difference cover.

A byte is removed if a string of ``length`` bytes that covers it also starts anywhere else in the
corpus. Strings never cross documents.

1. Units: texts that occur once stay where they are; the others, which a bitmap of their hashes
   picks in the scan, are grouped by text. A text with a copy is removed whole if it is long
   enough, and stands once for all its copies in what follows. Units are packed into blocks.
2. Cover sample: the positions of a text whose residue is in a difference cover modulo ``v``. Any
   two positions have a common shift below ``v`` to sampled ones, so of two equal strings the
   samples under them at that shift have equal strings of ``w = length - v + 1`` bytes. Samples are
   sorted, bucket by bucket, by fingerprints of these strings; what a sample's rank is needed for
   is one bit, whether it shares its rank with another sample.
3. Only suffixes with such a sample at a shift below ``v`` can be tied with others to the depth of
   ``length``. All others (four in five of a clean corpus) are never sorted. That is where the
   sample bounds memory and disk.
4. Suffixes that are left are dealt into buckets and sorted one bucket at a time; equal
   neighbours repeat each other. The answers go back to the blocks as one bit a suffix.

A suffix's key is a fingerprint of ``length`` bytes: 64 bits of one polynomial, and the bucket,
which comes of another. Buckets grow in number with the corpus (about ``BUCKET`` keys each), so the
key grows too: n keys make n * n / 2**65 / buckets wrong pairs, 4e-4 at 30 GB. The bytes aren't
compared again. In step 2 a shorter key will do, as a wrong tie there only opens a suffix in vain.
A block sends equal keys once, so a string that is everywhere comes once from each block.

Input cases. Null text counts as empty. Texts shorter than ``length`` and empty texts stay whole.
Rows that repeat an id or a text are documents of their own and repeat each other; null ids are
kept. An empty table gives no rows; extra columns are ignored. A task holds one block, or one
document if that is longer, about 60 bytes for each of its bytes; and one bucket.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm.common import arrow_map, bit_table, bits_for, drop, freed, table, with_bit, written

# fixed values: perfect difference sets by period, every difference but 0 occurs once
COVERS = {1: (0,), 3: (0, 1), 7: (1, 2, 4), 31: (1, 5, 11, 24, 25, 27), 133: (1, 2, 4, 13, 21, 35, 39, 82, 89, 95, 105, 110)}
#: bytes of a block, keys of a bucket
BLOCK, BUCKET = 1 << 20, 1 << 20
U = np.uint64
_PRIME = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)
_tables: dict[int, tuple[np.ndarray, ...]] = {}


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose upper bits depend on all bits."""
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


def _powers(n: int, which: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of the 256 bytes, powers of the polynomial's base and of its inverse modulo 2**64, ``n`` of them at least."""
    known = _tables.get(which)
    if known is None or len(known[1]) < n:
        base, m = _PRIME[which], 1 << max(16, (n - 1).bit_length())
        up, down = np.full(m, base, U), np.full(m, pow(base, -1, 1 << 64), U)
        up[0] = down[0] = 1
        known = _tables[which] = (_mixed(np.arange(1, 257, dtype=U) * U(_PRIME[1 - which])), np.multiply.accumulate(up), np.multiply.accumulate(down))
    return known


class Prints:
    """Fingerprints of the strings of a buffer, by prefix sums."""

    def __init__(self, data: np.ndarray, which: int = 0):
        self.which = which
        words, up, _ = _powers(len(data) + 1, which)
        self.sums = np.zeros(len(data) + 1, U)
        np.cumsum(words[data] * up[: len(data)], out=self.sums[1:])

    def at(self, start: np.ndarray, length: int) -> np.ndarray:
        return _mixed((self.sums[start + length] - self.sums[start]) * _powers(len(self.sums), self.which)[2][start])


def period(length: int) -> int:
    """The longest period whose samples still have a third of the string."""
    return max(v for v in COVERS if v == 1 or 3 * v <= 2 * length)


def sampled(lens: np.ndarray, length: int) -> np.ndarray:
    """Positions in a buffer of texts that lie in the cover and have ``length - period + 1`` bytes after them in their text."""
    v = period(length)
    w = length - v + 1
    longest = int(lens.max(initial=0))
    grid = (np.arange(0, longest + v, v)[:, None] + np.sort(np.array(COVERS[v]))).ravel()
    upto = np.searchsorted(grid, lens - w, side="right")
    starts = np.cumsum(lens) - lens
    return np.concatenate([np.zeros(0, np.int64), *[grid[:n] + s for n, s in zip(upto.tolist(), starts.tolist(), strict=True)]])


class Keys:
    """Distinct (bucket, value) of a block in order; ``many``: those that occur again in the block; ``inverse``: of each key its place."""

    def __init__(self, bucket: np.ndarray, value: np.ndarray):
        order = np.lexsort((value, bucket))
        b, v = bucket[order], value[order]
        new = np.ones(len(b), bool)
        new[1:] = (b[1:] != b[:-1]) | (v[1:] != v[:-1])
        place = np.cumsum(new) - 1
        self.inverse = np.empty(len(b), np.int64)
        self.inverse[order] = place
        self.bucket, self.value = b[new], v[new]
        self.many = np.bincount(place, minlength=len(self.bucket)) > 1 if len(b) else np.zeros(0, bool)

    def parts(self) -> Iterator[tuple[int, slice]]:
        edges = np.flatnonzero(np.concatenate([[True], self.bucket[1:] != self.bucket[:-1], [True]])) if len(self.bucket) else np.zeros(1, np.int64)
        for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            yield int(self.bucket[lo]), slice(lo, hi)

    def answers(self, parts: list[dict]) -> np.ndarray:
        """Of each key whether its bucket's owner found it twice."""
        by_bucket = {p["bucket"]: p["bits"] for p in parts}
        bits = [np.unpackbits(np.frombuffer(by_bucket[b], np.uint8), count=s.stop - s.start) for b, s in self.parts()]
        return np.concatenate([np.zeros(0, np.uint8), *bits]).astype(bool)[self.inverse]


def sample_keys(data: np.ndarray, lens: np.ndarray, length: int, bits: int) -> tuple[np.ndarray, Keys]:
    """Positions of the cover sample and their keys: bucket of ``bits`` bits, 40 more bits."""
    at = sampled(lens, length)
    prints = Prints(data).at(at, length - period(length) + 1)
    bucket = prints >> U(64 - bits) if bits else np.zeros(len(at), U)
    return at, Keys(bucket, (prints << U(bits)) >> U(24))


def suffix_keys(data: np.ndarray, at: np.ndarray, length: int, bits: int) -> Keys:
    bucket = Prints(data, 1).at(at, length) >> U(64 - bits) if bits else np.zeros(len(at), U)
    return Keys(bucket, Prints(data).at(at, length))


def opened(lens: np.ndarray, at: np.ndarray, shared: np.ndarray, length: int) -> np.ndarray:
    """Of each position of the buffer whether a string may start there that occurs again: a shared sample follows within the period, and the text is long enough."""
    v, ends = period(length), np.cumsum(lens)
    n = int(ends[-1]) if len(ends) else 0
    p = at[shared]
    text = np.searchsorted(ends, p, side="right")
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, np.maximum(p - v + 1, (ends - lens)[text]), 1)
    np.add.at(edge, p + 1, -1)
    out = np.cumsum(edge)[:n] > 0
    for s, e in zip((ends - lens).tolist(), ends.tolist(), strict=True):
        out[max(s, e - length + 1) : e] = False
    return out


def _bytes(row: dict, name: str, kind=np.uint8) -> np.ndarray:
    return np.frombuffer(row[name], kind)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


UNITS = "block bigint, bytes bigint, lens binary, keys binary, data binary"
_UNITS = pa.schema([("block", pa.int64()), ("bytes", pa.int64()), ("lens", pa.binary()), ("keys", pa.binary()), ("data", pa.binary())])
PARTS = "block bigint, bucket bigint, keys binary, many binary"
_PARTS = pa.schema([("block", pa.int64()), ("bucket", pa.int64()), ("keys", pa.binary()), ("many", pa.binary())])
OPEN = "block bigint, suffixes bigint, lens binary, keys binary, data binary, opened binary"
_OPEN = pa.schema([("block", pa.int64()), ("suffixes", pa.int64()), ("lens", pa.binary()), ("keys", pa.binary()), ("data", pa.binary()), ("opened", pa.binary())])
FOUND = "key binary, n_removed bigint, n_spans bigint, starts array<bigint>, ends array<bigint>, kept_sha256 string"
_FOUND = pa.schema([("key", pa.binary()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("kept_sha256", pa.string())])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for i in range(b.num_rows):
            yield {name: b.column(k)[i].as_py() for k, name in enumerate(b.schema.names)}


def _pack(size: int):
    """Texts and their keys as blocks of about ``size`` bytes."""

    def run(batches):
        part, n, texts, keys, total = TaskContext.get().partitionId(), 0, [], [], 0
        block = lambda: _batch([(part << 32 | n, total, np.array([len(t) for t in texts], np.int64).tobytes(), b"".join(keys), b"".join(texts))], _UNITS)
        for r in _rows(batches):
            if texts and total + len(r["text"]) > size:
                yield block()
                n, texts, keys, total = n + 1, [], [], 0
            texts.append(r["text"])
            keys.append(r["key"])
            total += len(r["text"])
        if texts:
            yield block()

    return run


def _send(block: int, keys: Keys, width: int) -> pa.RecordBatch:
    raw = keys.value.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    return _batch([(block, b, raw[s].tobytes(), np.packbits(keys.many[s]).tobytes()) for b, s in keys.parts()], _PARTS)


def _owner(width: int):
    """A bucket's owner sorts all its keys; answers every block with one bit for each key it sent."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        lists = []
        for raw in group.column("keys"):
            x = np.frombuffer(raw.as_py(), np.uint8).reshape(-1, width)
            lists.append(np.pad(x, ((0, 0), (0, 8 - width))).view("<u8").ravel())
        every = np.concatenate(lists)
        many = np.concatenate([np.unpackbits(np.frombuffer(m.as_py(), np.uint8), count=len(x)) for m, x in zip(group.column("many"), lists, strict=True)]).astype(bool)
        order = np.argsort(every)
        ranked = every[order]
        again = many[order]
        same = ranked[1:] == ranked[:-1]
        again[1:] |= same
        again[:-1] |= same
        out = np.empty(len(every), bool)
        out[order] = again
        ends = np.cumsum([len(x) for x in lists])
        bits = [np.packbits(out[e - len(x) : e]).tobytes() for x, e in zip(lists, ends.tolist(), strict=True)]
        n = group.num_rows
        freed()
        return pa.table({"block": group.column("block"), "bucket": pa.array([key[0].as_py()] * n, pa.int64()), "bits": pa.array(bits, pa.binary())})

    return run


def _ask(parts: DataFrame, width: int) -> DataFrame:
    """block, answers: what the owners of the buckets say to each block."""
    said = parts.groupBy("bucket").applyInArrow(_owner(width), "block bigint, bucket bigint, bits binary")
    return written(said.groupBy("block").agg(F.collect_list(F.struct("bucket", "bits")).alias("answers")), "answers")


def _bits(keys: int, size: int) -> int:
    """Bits of a bucket's number."""
    return max(0, -(-keys // size) - 1).bit_length()


def _open(length: int, bits: int):
    """Blocks of the texts that have open suffixes, with the suffixes."""

    def run(batches):
        for r in _rows(batches):
            data, lens, keys = _bytes(r, "data"), _bytes(r, "lens", np.int64), _bytes(r, "keys").reshape(-1, 32)
            at, own = sample_keys(data, lens, length, bits)
            mask = opened(lens, at, own.answers(r["answers"]), length)
            some = np.add.reduceat(mask, np.cumsum(lens) - lens, dtype=np.int64) > 0  # no text is empty
            if some.any():
                held = np.repeat(some, lens)
                yield _batch([(r["block"], int(mask.sum()), lens[some].tobytes(), keys[some].tobytes(), data[held].tobytes(), np.packbits(mask[held]).tobytes())], _OPEN)

    return run


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _found(length: int, bits: int):
    """What is removed of each text in which anything is."""

    def run(batches):
        for r in _rows(batches):
            data, lens, keys = _bytes(r, "data"), _bytes(r, "lens", np.int64), _bytes(r, "keys").reshape(-1, 32)
            at = np.flatnonzero(np.unpackbits(_bytes(r, "opened"), count=len(data)))
            at = at[suffix_keys(data, at, length, bits).answers(r["answers"])]
            edge = np.zeros(len(data) + 1, np.int64)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + length, -1)
            gone, out, start = np.cumsum(edge)[:-1] > 0, [], 0
            for n, key in zip(lens.tolist(), keys, strict=True):
                mask = gone[start : start + n]
                if mask.any():
                    lo, hi = runs(mask)
                    kept = hashlib.sha256(data[start : start + n][~mask].tobytes()).hexdigest()
                    out.append((key.tobytes(), int(mask.sum()), len(lo), lo.tolist(), hi.tolist(), kept))
                start += n
            yield _batch(out, _FOUND)

    return run


def repeats(docs: DataFrame, length: int = 200, block: int = BLOCK, bucket: int = BUCKET) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, starts, ends (of the removed runs), kept_sha256 of every row of ``docs`` (doc_id, text)."""
    body = F.coalesce("text", F.lit(""))
    texts = docs.select(F.col("doc_id"), body.cast("binary").alias("text"))
    long = texts.where(F.octet_length("text") >= length).select("text", F.xxhash64("text").alias("h"))
    again = written(long.groupBy("h").count().where("count > 1").select("h"), "again")
    places = bits_for(again.count())
    place = F.pmod("h", F.lit(places))
    marked = with_bit(long, place, bit_table(again.select(place), places), "maybe")
    copies = written(marked.where("maybe").groupBy("text").agg((F.count(F.lit(1)) > 1).alias("copied")), "copies")
    digest = F.unhex(F.sha2("text", 256))
    units = marked.where("not maybe").select("text").unionByName(copies.select("text")).withColumn("key", digest)
    blocks = written(arrow_map(units, _pack(block), UNITS), "blocks")

    total = blocks.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("n")).first().n
    v = period(length)
    bits = _bits(total * len(COVERS[v]) // v, bucket)

    def samples(batches):
        for r in _rows(batches):
            yield _send(r["block"], sample_keys(_bytes(r, "data"), _bytes(r, "lens", np.int64), length, bits)[1], 5)

    shared = _ask(arrow_map(blocks.select("block", "lens", "data"), samples, PARTS), 5)
    some = written(arrow_map(blocks.drop("bytes").join(shared, "block"), _open(length, bits), OPEN), "open")
    drop(blocks, shared)

    total = some.agg(F.coalesce(F.sum("suffixes"), F.lit(0)).alias("n")).first().n
    more = _bits(total, bucket)

    def suffixes(batches):
        for r in _rows(batches):
            at = np.flatnonzero(np.unpackbits(_bytes(r, "opened"), count=len(r["data"])))
            yield _send(r["block"], suffix_keys(_bytes(r, "data"), at, length, more), 8)

    tied = _ask(arrow_map(some.select("block", "data", "opened"), suffixes, PARTS), 8)
    found = written(arrow_map(some.drop("suffixes").join(tied, "block"), _found(length, more), FOUND), "found")
    drop(some, tied)

    twice = copies.where("copied").select(digest.alias("key"), F.lit(True).alias("copied"))
    whole = found.join(twice.select("key"), "key", "left_anti").withColumn("copied", F.lit(False)).unionByName(twice, allowMissingColumns=True)
    own = texts.select("doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"), digest.alias("key")).join(whole, "key", "left")
    none, n = F.array().cast("array<bigint>"), F.col("n_bytes")
    by = lambda all_, some_, rest: F.when(F.col("copied"), all_).otherwise(F.coalesce(some_, rest))
    return own.select(
        "doc_id",
        "n_bytes",
        by(n, F.col("n_removed"), F.lit(0).cast("bigint")).alias("n_removed"),
        by(F.lit(1).cast("bigint"), F.col("n_spans"), F.lit(0).cast("bigint")).alias("n_spans"),
        by(F.array(F.lit(0).cast("bigint")), F.col("starts"), none).alias("starts"),
        by(F.array(n), F.col("ends"), none).alias("ends"),
        by(F.lit(hashlib.sha256(b"").hexdigest()), F.col("kept_sha256"), F.lower(F.hex("key"))).alias("kept_sha256"),
    )


def kept(text: Column, starts: Column, ends: Column) -> Column:
    """The bytes of a text outside the removed runs, as binary."""
    data = F.coalesce(text, F.lit("")).cast("binary")
    begins = F.concat(F.array(F.lit(0).cast("bigint")), ends)
    stops = F.concat(starts, F.array(F.octet_length(data).cast("bigint")))
    pieces = F.zip_with(begins, stops, lambda a, b: F.substring(data, a.cast("int") + 1, (b - a).cast("int")))
    return F.aggregate(pieces, F.lit(b""), lambda s, x: F.concat(s, x))


def op12_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
