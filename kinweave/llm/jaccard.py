"""Jaccard join of word n-gram sets over a token-group matrix, and its components.

Two documents link when 100 * |A and B| >= percent * |A or B|. The join is exact.

The matrix's tokens are *parts* of shingle sets. A level holds the sets of up to
2**(level + 1) - 1 shingles; it cuts the hash space into K ranges, and the shingles of a
set in one range are one part. Linked sets differ in at most d shingles, and K > d, so
linked sets have equal parts, while a passage that many documents share makes no equal
part by itself: it is cut up among other shingles. A set that fits two levels, because
larger partners fall into the next one, has parts in both. Empty parts count only for
sets with so many of them that they could be the only equal ones. So a set knows how many
of its parts any linked set has too, at least (``need``).

1. Sets: shingles are hashed in the scan; a row keeps the size, the class (digest of the
   set: equal sets are one class) and the parts. Shingles are not kept.
2. Groups: parts that one class has are dropped, then classes with fewer shared parts
   than their need. A part that several classes have points to its smallest class, the
   leader; a class belongs to the group of the leader that most of its parts point to (the
   smallest of several), whose name the group has. All are pre-aggregated.
3. Matrix: it holds (part, group) where any class of the group has the part: the group's
   token union. A query class bounds its overlap with a group by the number of its parts
   in the union, and opens only groups that reach what a linked set would have. Shingle
   sets are made again for the classes of opened groups only.
4. Opening a group begins with its leader: the query is compared with that one class.
   Most copies are connected then, in work linear in the size of a group. Of what is left,
   parts whose classes are not all connected, groups are cut into blocks of at most
   ``BLOCK`` classes with unions of their own; queries are bounded by them in the same
   way, and in an open block all comparisons are one matrix product; the task gives edges
   that span what it connects, fewer than it has classes, never all pairs.

A class is known by 64 bits of its digest; where two sets share those, the other 64 bits
tell them apart and name them anew, so that classes are equal sets up to 128 bits.

Input cases. Null text and text without words have the empty set, size 0, link with
nothing and are their own component. With fewer words than n the whole sequence is the
one shingle. Repeated rows are equal sets; rows that repeat an id get one row each. Null
ids never name a component unless nothing else is in it. Empty table: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm.common import arrow_map, bit_table, bitmap, bits_for, components, drop, fresh, table, test_bits, with_bit, written

BLOCK = 1024
#: shingles of a block, and of the queries that meet it in one task
TOKENS = 1_000_000
#: columns of a dense product
COLUMNS = 4096
#: words whose hashes a worker keeps, and classes that it knows to have given already
HASHES, SEEN = 50_000, 100_000
#: bits of the filter that picks the documents whose shingles are made again, 8 MiB
FILTER_BITS = 1 << 26

_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _Hashes(dict):
    """word -> hash, for the words met so far; emptied when it is full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > HASHES:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) < 64:
            self[word] = h
        return h


def shingles(text: bytes | None, n: int, hashes: _Hashes) -> np.ndarray:
    """The distinct hashes of the n-word shingles, sorted. ``bytes`` lower-cases A-Z and splits at ASCII white space only."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, _U)
    if len(words) < n:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=1)], _U)
    h = np.fromiter(map(hashes.__getitem__, words), _U, len(words))
    m = len(words) - n + 1
    out = h[:m].copy()
    for k in range(1, n):
        out = out * _U(0x9E3779B97F4A7C15) + h[k : k + m]
    out = _mix(out)
    out.sort()
    return out[np.concatenate(([True], out[1:] != out[:-1]))]


class Levels:
    """Numbers of parts, for a threshold in percent."""

    def __init__(self, percent: int):
        self.percent = percent

    def differ(self, a: int, b: int) -> int:
        """Linked sets of these sizes differ in at most so many shingles."""
        return (a + b) * (100 - self.percent) // (100 + self.percent)

    def largest(self, n: int) -> int:
        return n * 100 // self.percent

    def parts(self, level: int) -> int:
        d = self.differ(2 ** (level + 1) - 1, 2 ** (level + 1) - 1)
        return d + 1 + d // 8 + (d > 3)

    def of(self, n: int) -> list[int]:
        low = n.bit_length() - 1
        return list(range(low, self.largest(n).bit_length()))


def parts(s: np.ndarray, levels: Levels) -> tuple[np.ndarray, int]:
    """The parts of a sorted shingle set, over its levels, and how many of them a linked set has too, at least."""
    out, n, need = [], len(s), len(s)
    mixed = _mix(s + _U(0x632BE59BD9B4E019))
    for level in levels.of(n):
        k = levels.parts(level)
        place = (s >> _U(32)) * _U(k) >> _U(32)
        starts = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        d = levels.differ(n, min(levels.largest(n), 2 ** (level + 1) - 1))
        need = min(need, len(starts) - d)
        sums = np.add.reduceat(mixed, starts)
        own = place[starts] + _U(level << 40)
        out.append(_mix(sums ^ _mix(own)))
        if k - len(starts) >= k - d:
            empty = np.setdiff1d(np.arange(k, dtype=_U), place[starts])
            out.append(_mix(_mix(empty + _U(level << 40)) ^ _U(0x5851F42D4C957F2D)))
    return np.concatenate(out), max(1, need)


def set_class(s: np.ndarray) -> tuple[int, int]:
    """The two halves of the set's digest."""
    d = xxhash.xxh3_128_intdigest(s.tobytes(), seed=len(s))
    return (d & (1 << 64) - 1) - (1 << 63), (d >> 64) - (1 << 63)


def _as_bytes(batch: pa.RecordBatch, column: int) -> list[bytes | None]:
    return batch.column(column).cast(pa.binary()).to_pylist()


def _sets(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """doc_id, digest of the text, size, class and check (two halves of the set's digest, null for the empty set), parts, how many of them a linked set has at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, levels = _Hashes(), Levels(percent)
        seen: set[tuple[int, int]] = set()  # classes whose parts this task has given already
        for b in batches:
            size, cls, check, own, need = [], [], [], [], []
            for t in _as_bytes(b, 1):
                s = shingles(t, n, hashes)
                c = set_class(s) if len(s) else None
                size.append(len(s))
                cls.append(c and c[0])
                check.append(c and c[1])
                if c is None or c in seen:
                    own.append(None)
                    need.append(None)
                else:
                    p, k = parts(s, levels)
                    own.append(p.view(np.int64))
                    need.append(k)
                    if len(seen) < SEEN:
                        seen.add(c)
            long = [pa.array(x, pa.int64()) for x in (size, cls, check)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *long, pa.array(own, pa.list_(pa.int64())), pa.array(need, pa.int64())], names)

    names = ["doc_id", "digest", "size", "cls", "check", "parts", "need"]
    kinds = [docs.schema["doc_id"].dataType.simpleString(), *["bigint"] * 4, "array<bigint>", "bigint"]
    return arrow_map(docs.select("doc_id", "text", F.xxhash64("text").alias("digest")), run, ", ".join(map(" ".join, zip(names, kinds, strict=True))))


def _apart(rows: DataFrame, shared: DataFrame | None) -> DataFrame:
    """``rows`` with sets that share a class (``shared`` has it) named anew by both halves."""
    if shared is None:
        return rows
    met = rows.join(shared.withColumn("met", F.lit(True)), "cls", "left")
    return met.withColumn("cls", F.when(F.col("met"), F.xxhash64("cls", "check")).otherwise(F.col("cls"))).drop("met")


def _posts(sets: DataFrame, leaders: DataFrame) -> DataFrame:
    """cls, part of the parts that ``leaders`` (part) holds, and of a few that its filter lets pass: most parts never travel again."""
    bits = sets.sparkSession.sparkContext.broadcast(bitmap(leaders.select(F.col("part").bitwiseAND(FILTER_BITS - 1)), FILTER_BITS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b.column(1)
            flat = own.flatten().to_numpy(zero_copy_only=False)
            cls = np.repeat(b.column(0).to_numpy(zero_copy_only=False), own.value_lengths().to_numpy(zero_copy_only=False))
            at = flat & (FILTER_BITS - 1)
            ok = test_bits(bits.value, at)
            yield pa.RecordBatch.from_arrays([pa.array(cls[ok], pa.int64()), pa.array(flat[ok], pa.int64())], ["cls", "part"])

    return arrow_map(sets.where("parts is not null").select("cls", "parts"), run, "cls bigint, part bigint")


def _shingled(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """cls, check, s (sorted shingles as bytes) of the documents that ``wanted`` (doc_id) holds, and of a few that its filter lets pass."""
    bits = docs.sparkSession.sparkContext.broadcast(bitmap(wanted.select(F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS))), FILTER_BITS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = _Hashes(), set()
        for b in batches:
            at = b.column(2).to_numpy(zero_copy_only=False)
            b = b.filter(pa.array(test_bits(bits.value, at)))
            cls, own = [], []
            for t in _as_bytes(b, 1):
                s = shingles(t, n, hashes)
                if not len(s) or (c := set_class(s)) in seen:
                    continue
                if len(seen) < SEEN:
                    seen.add(c)
                cls.append(c)
                own.append(s.tobytes())
            if cls:
                halves = [pa.array(x, pa.int64()) for x in zip(*cls, strict=True)]
                yield pa.RecordBatch.from_arrays([*halves, pa.array(own, pa.binary())], ["cls", "check", "s"])

    place = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS)).alias("at")
    return arrow_map(docs.select("doc_id", "text", place), run, "cls bigint, check bigint, s binary")


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    small, large = sorted((len(a), len(b)))
    if small * 100 < percent * large:
        return False
    both = np.intersect1d(a, b, assume_unique=True).size
    return 100 * both >= percent * (len(a) + len(b) - both)


def _with_leader(pairs: DataFrame, percent: int) -> DataFrame:
    """The linked ones of (a, b, s of a, t of b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [_linked(np.frombuffer(x, _U), np.frombuffer(y, _U), percent) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield b.filter(pa.array(keep, pa.bool_())).select([0, 1])

    return arrow_map(pairs, run, "a bigint, b bigint")


def open_block(queries: list[np.ndarray], members: list[np.ndarray], percent: int) -> np.ndarray:
    """Which query links with which member. Only shingles that both sides have take part in the product."""
    nq, nm = np.array([len(s) for s in queries]), np.array([len(s) for s in members])
    qt, mt = np.concatenate(queries), np.concatenate(members)
    shared = np.intersect1d(np.unique(qt), np.unique(mt), assume_unique=True)
    both = np.zeros((len(queries), len(members)), np.float32)

    def coords(tokens: np.ndarray, sizes: np.ndarray):
        row, col = np.repeat(np.arange(len(sizes)), sizes), np.searchsorted(shared, tokens)
        col[col == len(shared)] = 0
        ok = shared[col] == tokens
        order = np.argsort(col[ok], kind="stable")
        return row[ok][order], col[ok][order]

    if len(shared):
        qr, qc = coords(qt, nq)
        mr, mc = coords(mt, nm)
        for lo in range(0, len(shared), COLUMNS):
            hi = min(lo + COLUMNS, len(shared))
            q, m = np.zeros((len(queries), hi - lo), np.float32), np.zeros((len(members), hi - lo), np.float32)
            a, b = np.searchsorted(qc, [lo, hi])
            q[qr[a:b], qc[a:b] - lo] = 1
            a, b = np.searchsorted(mc, [lo, hi])
            m[mr[a:b], mc[a:b] - lo] = 1
            both += q @ m.T
    union = nq[:, None] + nm[None, :] - both
    return 100 * both.astype(np.float64) >= percent * union


def spanning(links: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fewest edges between roots that connect what ``links`` (rows x columns, each with its root) connects."""
    names, at = np.unique(np.concatenate([rows, columns]), return_inverse=True)
    i, j = np.nonzero(links & (rows[:, None] != columns[None, :]))
    pairs = np.unique(at[: len(rows)][i] * len(names) + at[len(rows) :][j])
    a, b = pairs // max(1, len(names)), pairs % max(1, len(names))
    label = np.arange(len(names))
    while True:
        low = label.copy()
        np.minimum.at(low, a, label[b])
        np.minimum.at(low, b, label[a])
        low = np.minimum(low, low[low])
        if (low == label).all():
            break
        label = low
    moved = np.flatnonzero(label != np.arange(len(names)))
    return names[moved], names[label[moved]]


def _opened(rows: DataFrame, percent: int) -> DataFrame:
    """Edges between queries and members of a block. ``rows``: block, chunk, side (0 member, 1 query), cls, root, s."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        m, q = pdf[pdf.side == 0], pdf[pdf.side == 1]
        if not len(m) or not len(q):
            return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
        sets = lambda x: [np.frombuffer(s, _U) for s in x.s]
        a, b = spanning(open_block(sets(q), sets(m), percent), q.root.to_numpy(), m.root.to_numpy())
        one = dict(zip([*q.root, *m.root], [*q.cls, *m.cls], strict=True))  # a class of each root
        return pd.DataFrame({"a": [one[x] for x in a.tolist()], "b": [one[x] for x in b.tolist()]}, dtype=np.int64)

    return rows.groupBy("block", "chunk").applyInPandas(run, "a bigint, b bigint")


def near_components(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs`` (doc_id, text)."""
    return _components(docs, n, percent).select("doc_id", F.col("size").alias("n_shingles"), F.coalesce("first.doc_id", "doc_id").alias("component_id"))


def _groups(sets: DataFrame, classes: DataFrame) -> DataFrame:
    """cls, part, home of the classes that share as many parts as a linked set would: each in the group of one leader."""
    posts = sets.where("parts is not null").select("cls", F.explode("parts").alias("part"))
    several = lambda df: df.groupBy("part").agg(F.min("cls").alias("leader"), F.max("cls").alias("last")).where("leader <> last").select("part", "leader")
    leaders = written(several(posts), "leaders")
    shared = written(_posts(sets, leaders).join(leaders.select("part"), "part").distinct(), "shared")
    # the whole corpus as one group: a class with fewer shared parts than a linked set has links with nothing
    alive = shared.groupBy("cls").agg(F.count(F.lit(1)).alias("n")).join(classes, "cls").where("n >= need").select("cls")
    near = shared.join(alive, "cls")
    votes = near.join(several(near), "part").groupBy("cls", "leader").agg(F.count(F.lit(1)).alias("n"))
    home = votes.groupBy("cls").agg(F.min(F.struct(-F.col("n"), "leader"))["leader"].alias("home"))
    out = written(near.join(home, "cls"), "homes")
    drop(leaders, shared)
    return out


def _qualifying(posts: DataFrame, classes: DataFrame) -> DataFrame:
    """cls, home: the groups that a class opens, by the bound of its overlap with their unions. ``posts``: cls, part, home."""
    matrix = posts.select("part", "home").distinct()
    bound = posts.select("cls", "part").join(matrix, "part").groupBy("cls", "home").agg(F.count(F.lit(1)).alias("overlap"))
    return bound.join(classes.select("cls", "need"), "cls").where("overlap >= need").select("cls", "home")


def _joined(rooted: DataFrame, edges: DataFrame) -> DataFrame:
    """``rooted`` (cls, root, ...) after its roots have been connected by ``edges`` (a, b) between classes."""
    own = lambda c, to: rooted.select(F.col("cls").alias(c), F.col("root").alias(to))
    between = written(edges.join(own("a", "x"), "a").join(own("b", "y"), "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "between")
    if not between.isEmpty():
        found = components(between).select(F.col("node").alias("root"), F.col("root").alias("_new"))
        rooted = rooted.join(found, "root", "left").withColumn("root", F.coalesce("_new", "root")).drop("_new").select(rooted.columns)
    drop(between)
    return rooted


def _components(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """doc_id, digest, size, first for every row: ``first`` is the component's smallest (id is null, doc_id, digest), null for the empty set."""
    sets = written(_sets(docs, n, percent), "sets")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "digest")).alias("rep")
    grouped = lambda: sets.where("cls is not null").groupBy("cls").agg(first, F.max("size").alias("size"), F.max("need").alias("need"), (F.min("check") != F.max("check")).alias("alike"))
    classes, alike = written(grouped(), "classes"), None
    if not classes.where("alike").isEmpty():
        alike = classes.where("alike").select("cls")
        sets = _apart(sets, alike)
        classes = written(grouped(), "classes")
    posts = _groups(sets, classes)
    opened = written(_qualifying(posts, classes).where("cls <> home"), "qualifying")
    # linked classes have both opened the group of one of them, so no other class has a link
    asked = opened.select("cls").union(opened.select("home")).distinct()
    wanted = asked.join(classes, "cls").select("rep.doc_id")
    made = _apart(_shingled(docs, wanted, n), alike).join(asked, "cls", "left_semi")
    made = written(made.groupBy("cls").agg(F.first("s").alias("s")), "shingles")
    near = posts.select("cls", "home").distinct().join(asked, "cls", "left_semi")
    near = written(near.select("cls", F.col("cls").alias("root"), "home").join(classes.select("cls", "size", "need"), "cls"), "near")

    def led(pairs: DataFrame) -> DataFrame:
        leaders = made.select(F.col("cls").alias("home"), F.col("s").alias("t"))
        pairs = pairs.join(made, "cls").join(leaders, "home").select(F.col("cls").alias("a"), F.col("home").alias("b"), "s", "t")
        return _with_leader(pairs, percent)

    # its own group's leader first, then, for each component among the other groups it opens, one leader
    mine = near.select("cls", F.col("home").alias("mine"))
    rooted = _joined(near, led(opened.join(mine, "cls").where("home = mine").select("cls", "home")))
    own, other = rooted.select("cls", "root"), rooted.select(F.col("cls").alias("home"), F.col("root").alias("to"))
    away = opened.join(own, "cls").join(other, "home").where("root <> to").groupBy("cls", "to").agg(F.min("home").alias("home"))
    rooted = written(_joined(rooted, led(away.select("cls", "home"))), "rooted")

    # what the leaders left open
    post = posts.select("part", "cls").join(rooted, "cls")
    mixed = post.groupBy("part").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("part")
    post = written(post.join(mixed, "part"), "open")
    members = post.select("cls", "home", "size").distinct().groupBy("home").agg(F.count(F.lit(1)).alias("members"), F.sum("size").alias("tokens"))
    blocks = members.select("home", F.ceil(F.greatest(F.col("members") / BLOCK, F.col("tokens") / TOKENS)).alias("blocks"))
    member = rooted.join(post.select("cls").distinct(), "cls").join(blocks, "home")
    member = written(member.withColumn("block", F.xxhash64("home", F.pmod(F.xxhash64("cls"), F.col("blocks")))), "members")
    # the blocks' matrix has the roots and sizes behind each part, too
    matrix = (
        post.select("part", "cls")
        .join(member.select("cls", "block", "root", "size"), "cls")
        .groupBy("part", "block")
        .agg(F.min("root").alias("low"), F.min("size").alias("least"), F.max("size").alias("most"))
    )
    fits = (F.col("least") * percent <= F.col("size") * 100) & (F.col("size") * percent <= F.col("most") * 100)
    bound = (
        post.select("part", "cls", "root", "size", "need")
        .join(matrix, "part")
        .where(fits & (F.col("low") < F.col("root")))  # a pair is compared from the side of the larger root
        .groupBy("cls", "block")
        .agg(F.count(F.lit(1)).alias("overlap"), F.max("size").alias("size"), F.max("need").alias("need"))
    )
    open_ = written(bound.where("overlap >= need").select("cls", "block", "size"), "opened")

    chunks = open_.groupBy("block").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("size") / TOKENS)).alias("chunks"))
    asks = open_.join(chunks, "block").withColumn("chunk", F.pmod(F.xxhash64("cls"), F.col("chunks")))
    asks = asks.join(rooted.select("cls", "root"), "cls").select("block", "chunk", F.lit(1).alias("side"), "cls", "root")
    held = member.join(chunks, "block").select(
        "block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1)).alias("chunk"), F.lit(0).alias("side"), "cls", "root"
    )
    last = _joined(rooted, _opened(asks.union(held).join(made, "cls"), percent)).select("cls", "root")
    named = classes.select("cls", "rep").join(last, "cls", "left").select("cls", "rep", F.coalesce("root", "cls").alias("root"))
    names = named.groupBy("root").agg(F.min("rep").alias("first"))
    named = written(named.join(names, "root").select("cls", "first"), "named")
    drop(posts, opened, made, near, rooted, post, member, open_)
    return sets.join(named, "cls", "left").select("doc_id", "digest", "size", "first")


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay: of each component that with the smallest id.

    A null id comes after all others; of rows with the smallest id, or with null only, that
    with the smallest digest of its text stays. Rows that repeat id and text stay or go together.
    """
    found = _components(docs, n, percent)
    own, left, right, maybe = fresh(docs, "own", "id", "digest", "maybe")
    first = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("digest") == F.col("first.digest"))
    gone = written(found.where(F.col("first").isNotNull() & ~first).select(F.col("doc_id").alias(left), F.col("digest").alias(right)).distinct(), "gone")
    # rows that a bitmap of those that go doesn't know stay without a join
    bits = bits_for(gone.count())
    place = lambda i, d: F.pmod(F.xxhash64(i, d), F.lit(bits))
    tested = with_bit(docs.withColumn(own, F.xxhash64("text")), place("doc_id", own), bit_table(gone.select(place(left, right)), bits), maybe)
    stay = tested.where(maybe).join(gone, F.col("doc_id").eqNullSafe(F.col(left)) & (F.col(own) == F.col(right)), "left_anti")
    return tested.where(~F.col(maybe)).select(docs.columns).unionByName(stay.select(docs.columns))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(table(spark, sf_dir, "documents"), n=4, percent=85)
