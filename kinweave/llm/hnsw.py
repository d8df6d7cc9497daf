"""Approximate nearest neighbours: a hierarchical navigable small-world graph for each shard.

Rows are dealt to shards by a hash of their id, ``SHARD_ROWS`` to a shard at most in
expectation. In a shard, equal vectors are one node, which keeps the ids of all its rows.
A node's top layer is geometric, from a hash; nodes are numbered by it, highest first, so
that each layer is the nodes below some number.

Nodes are inserted in that order, a batch at a time (one node, then ever more, up to
``BATCH`` and a quarter of those inserted): a batch descends from the top layer through the
graph as it is, and in each layer that a node belongs to, a beam of ``BUILD_BEAM`` nodes
and the batch's other nodes are its candidates. Of these it links to diverse near ones (a
candidate is taken first if it is nearer to the node than to those taken; the nearest others
fill up). Links are made mutual, and a node with too many chooses anew in the same way. A
graph is flat arrays: vectors, ids with offsets, and for each layer an array of neighbours.

Every query goes to every shard of its length: a stated query set against all rows, in
blocks of ``QUERY_ROWS``. A task reads a stream of one graph and then the queries, so each graph
travels once; a block of queries goes down the layers, then a beam of ``BEAM`` nodes in layer 0. Each shard gives k rows for a query; they are ranked
by exact distance in double precision, ties by id. Work is queries times shards, so on a
cluster shards should be as large as an executor's memory allows (``shard_rows``).

Input cases. Vectors that are null, zero or hold null or non-finite components take no
part, as candidates or queries. Vectors of other length are never compared. Rows that
repeat the query's own id are its own. Query rows that repeat an id and a vector are one
query; with another vector they are another one, with ranks of its own. Values of any size
are searched after scaling. Fewer than k candidates: all of them. Empty: none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinweave.llm.common import arrow_map, table, written

SHARD_ROWS = 32_768
QUERY_ROWS = 4096
LINKS = 16  # twice that in layer 0
BUILD_BEAM = 96
BEAM = 320
BATCH = 256  # nodes that are inserted, and queries that are searched, at once
STEP = 4  # nodes of a beam whose neighbours are looked at together

_NONE = np.float32(np.inf)


def _gaps(vectors: np.ndarray, a: np.ndarray, q: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of vectors[a] and q[b]."""
    gap = vectors[a]
    gap -= q[b]
    return np.einsum("ij,ij->i", gap, gap)


def _best(ids: np.ndarray, dist: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``width`` nearest of each row, nearest first, ties to the smaller number."""
    if dist.shape[1] > 2 * width:
        at = np.argpartition(dist, width, axis=1)[:, :width]
        ids, dist = np.take_along_axis(ids, at, 1), np.take_along_axis(dist, at, 1)
    order = np.lexsort((ids, dist), axis=1)[:, :width]
    return np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)


def beam(vectors: np.ndarray, links: np.ndarray, size: int, q: np.ndarray, entry: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``q`` the ``width`` nearest nodes found from its row of ``entry`` (-1: none) in a layer of the nodes below ``size``.

    Gives nodes and squared distances, nearest first, -1 and infinity where fewer are found.
    """
    n = len(q)
    ids, dist = np.full((n, width), -1, np.int32), np.full((n, width), _NONE, np.float32)
    done = np.ones((n, width), bool)
    seen = np.zeros((n, size), bool)
    live, new = np.arange(n), entry.astype(np.int32)
    while len(live):
        # rows of ``new`` may repeat a node, or hold one met before
        new = np.sort(new, axis=1)
        fresh = new >= 0
        fresh[:, 1:] &= new[:, 1:] != new[:, :-1]
        row, col = np.nonzero(fresh)
        met = seen[live[row], new[row, col]]
        row, col = row[~met], col[~met]
        node = new[row, col]
        seen[live[row], node] = True
        far = np.full(new.shape, _NONE, np.float32)
        far[row, col] = _gaps(vectors, node, q, live[row])
        all_ids = np.concatenate([ids[live], np.where(far < _NONE, new, -1)], axis=1)
        all_dist = np.concatenate([dist[live], far], axis=1)
        all_done = np.concatenate([done[live], far == _NONE], axis=1)
        order = np.argsort(all_dist, axis=1, kind="stable")[:, :width]
        ids[live], dist[live] = np.take_along_axis(all_ids, order, 1), np.take_along_axis(all_dist, order, 1)
        now = np.take_along_axis(all_done, order, 1)
        # the nearest nodes of the beam that haven't been left yet
        pick = ~now & (np.cumsum(~now, axis=1) <= STEP)
        done[live] = now | pick
        going = pick.any(1)
        live, pick = live[going], pick[going]
        row, col = np.nonzero(pick)
        place = np.cumsum(pick, axis=1)[row, col] - 1
        new = np.full((len(live), STEP, links.shape[1]), -1, np.int32)
        new[row, place] = links[ids[live[row], col]]
        new = new.reshape(len(live), STEP * links.shape[1])
    return ids, dist


def chosen(vectors: np.ndarray, ids: np.ndarray, dist: np.ndarray, links: int) -> np.ndarray:
    """``links`` of each row's candidates (nearest first, -1 for none): diverse ones, then the nearest of those passed over."""
    rows, width = ids.shape
    own = vectors[np.maximum(ids, 0)]
    norm = np.einsum("ijk,ijk->ij", own, own)
    between = norm[:, :, None] + norm[:, None, :] - 2 * own @ own.transpose(0, 2, 1)
    shut = ids < 0
    taken = np.zeros((rows, width), bool)
    found = np.zeros(rows, int)
    for j in range(width):
        ok = ~shut[:, j] & (found < links)
        if not ok.any():
            continue
        taken[:, j] = ok
        found += ok
        # nearer to the one just taken than to the node
        shut |= ok[:, None] & (between[:, j] < dist)
    rank = np.where(ids < 0, 2, ~taken)
    order = np.argsort(rank, axis=1, kind="stable")[:, :links]
    out = np.full((rows, links), -1, np.int32)
    out[:, : order.shape[1]] = np.take_along_axis(ids, order, 1)
    return out


class Graph:
    """Flat arrays; see the module. ``sizes``: nodes of each layer, layer 0 first; ``links``: for each layer its nodes' neighbours."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, offsets: np.ndarray, sizes: list[int], links: list[np.ndarray]):
        self.vectors, self.ids, self.offsets, self.sizes, self.links = vectors, ids, offsets, sizes, links
        self.scale = float(np.abs(vectors).max()) or 1.0 if len(vectors) else 1.0
        self.centre = (vectors / self.scale).mean(0) if len(vectors) else 0.0
        self.near = self._scaled(vectors)

    def _scaled(self, vectors: np.ndarray) -> np.ndarray:
        """In the graph's own measure: about its centre, in single precision."""
        return (vectors / self.scale - self.centre).astype(np.float32)

    @classmethod
    def build(cls, ids: np.ndarray, vectors: np.ndarray) -> Graph:
        order = np.lexsort((ids, *vectors.T[::-1]))
        ids, vectors = ids[order], vectors[order]
        first = np.concatenate(([True], (vectors[1:] != vectors[:-1]).any(1))) if len(ids) else np.zeros(0, bool)
        starts = np.flatnonzero(first)
        counts = np.diff(np.append(starts, len(ids)))
        h = ids[starts].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        u = ((h >> np.uint64(11)).astype(np.float64) + 1) / 2.0**53
        top = np.floor(-np.log(u) / np.log(LINKS)).astype(int)
        turn = np.lexsort((h, -top))  # the highest first, else as good as random
        nodes = vectors[starts[turn]]
        offsets = np.concatenate(([0], np.cumsum(counts[turn])))
        ids = ids[np.arange(len(ids)) - np.repeat(offsets[:-1], counts[turn]) + np.repeat(starts[turn], counts[turn])]
        sizes = [len(turn)]
        while (n := int((top >= len(sizes)).sum())) > 1:
            sizes.append(n)
        links = [np.full((n, LINKS if level else 2 * LINKS), -1, np.int32) for level, n in enumerate(sizes)]
        graph = cls(nodes, ids, offsets, sizes, links)
        lo = 0
        while lo < len(nodes):
            hi = min(len(nodes), lo + max(1, min(BATCH, lo // 4)))
            graph._insert(lo, hi)
            lo = hi
        return graph

    def _insert(self, lo: int, hi: int) -> None:
        q, entry = self.near[lo:hi], np.zeros((hi - lo, 1), np.int32)
        mates = np.arange(lo, hi, dtype=np.int32)
        between = np.stack([_gaps(self.near, np.repeat(i, hi - lo), self.near, np.arange(lo, hi)) for i in range(lo, hi)])
        np.fill_diagonal(between, _NONE)
        for level in range(len(self.sizes) - 1, -1, -1):
            size, links = self.sizes[level], self.links[level]
            own = max(0, min(hi, size) - lo)  # nodes of the batch that belong to this layer
            found, dist = np.full((hi - lo, 1), -1, np.int32), np.full((hi - lo, 1), _NONE, np.float32)
            if lo:
                found, dist = beam(self.near, links, min(lo, size), q, np.where(entry < min(lo, size), entry, -1), BUILD_BEAM if own else 8)
            if own:
                more = np.broadcast_to(mates[:own], (own, own))
                ids, far = _best(np.concatenate([found[:own], more], 1), np.concatenate([dist[:own], between[:own, :own]], 1), BUILD_BEAM)
                ids = np.where(far < _NONE, ids, -1)
                out = chosen(self.near, ids, far, links.shape[1] // 2)
                links[lo : lo + own, : out.shape[1]] = out
                self._answer(links, out, lo)
            entry = found[:, :8] if lo else entry

    def _answer(self, links: np.ndarray, out: np.ndarray, lo: int) -> None:
        """Links back to the nodes from ``lo`` on, whose links are ``out``; who has too many chooses anew."""
        src, col = np.nonzero(out >= 0)
        dst, src = out[src, col], (src + lo).astype(np.int32)
        far = _gaps(self.near, src, self.near, dst)
        order = np.lexsort((src, far, dst))
        dst, src, far = dst[order], src[order], far[order]
        node, begin, count = np.unique(dst, return_index=True, return_counts=True)
        width = links.shape[1]
        place = np.arange(len(dst)) - np.repeat(begin, count)
        near = place < width  # the nearest are enough: no more could be chosen
        row = np.repeat(np.arange(len(node)), count)[near]
        more, gap = np.full((len(node), width), -1, np.int32), np.full((len(node), width), _NONE, np.float32)
        more[row, place[near]], gap[row, place[near]] = src[near], far[near]
        held = links[node]
        more = np.where((more[:, :, None] == held[:, None, :]).any(2), -1, more)  # linked already
        ids = np.concatenate([held, more], 1)
        r, c = np.nonzero(ids >= 0)
        dist = np.full(ids.shape, _NONE, np.float32)
        dist[r, c] = _gaps(self.near, ids[r, c], self.near, node[r])
        ids, dist = _best(ids, dist, 2 * width)
        room = (ids >= 0).sum(1) <= width
        links[node[room]] = ids[room][:, :width]
        if not room.all():
            links[node[~room]] = chosen(self.near, ids[~room], dist[~room], width)

    def search(self, q: np.ndarray, own: int, k: int, width: int) -> list[tuple[float, int]]:
        return self.search_all(q[None], np.array([own]), k, width)[0]

    def search_all(self, q: np.ndarray, own: np.ndarray, k: int, width: int) -> list[list[tuple[float, int]]]:
        """For each row of ``q``: (distance, id) of the k nearest rows found, without those of its id in ``own``."""
        if not len(self.vectors):
            return [[] for _ in q]
        out = []
        for lo in range(0, len(q), BATCH):
            part = q[lo : lo + BATCH]
            near = self._scaled(part)
            near = np.clip(near, -1e18, 1e18)  # beyond all nodes: squares stay finite
            found = np.broadcast_to(np.arange(min(8, self.sizes[-1]), dtype=np.int32), (len(part), min(8, self.sizes[-1])))
            for level in range(len(self.sizes) - 1, -1, -1):
                found, _ = beam(self.near, self.links[level], self.sizes[level], near, found, 16 if level else width)
            for i in range(len(part)):
                out.append(self._ranked(found[i][found[i] >= 0], part[i], own[lo + i], k))
        return out

    def _ranked(self, nodes: np.ndarray, q: np.ndarray, own: int, k: int) -> list[tuple[float, int]]:
        with np.errstate(over="ignore"):
            gap = self.vectors[nodes] - q
            d = np.sqrt((gap * gap).sum(1))
        for i in np.flatnonzero(np.isinf(d)):  # the squares are too large, the distance perhaps not
            half = self.vectors[nodes[i]] / 2 - q / 2
            most = np.abs(half).max()
            d[i] = np.sqrt(((half / most) ** 2).sum()) * most * 2
        best: list[tuple[float, int]] = []
        for i in np.argsort(d, kind="stable"):
            if len(best) >= k and d[i] > best[-1][0]:
                break
            ids = self.ids[self.offsets[nodes[i]] : self.offsets[nodes[i] + 1]]
            best = sorted(best + [(float(d[i]), int(x)) for x in ids[ids != own][:k]])[:k]
        return best

    def row(self) -> dict:
        return {
            "vectors": self.vectors.astype(np.float64).tobytes(),
            "ids": self.ids.astype(np.int64).tobytes(),
            "offsets": self.offsets.astype(np.int64).tobytes(),
            "sizes": list(map(int, self.sizes)),
            "links": b"".join(x.tobytes() for x in self.links),
        }

    @classmethod
    def of(cls, row, dim: int) -> Graph:
        links, at, flat = [], 0, np.frombuffer(row["links"], np.int32)
        for level, n in enumerate(row["sizes"]):
            w = LINKS if level else 2 * LINKS
            links.append(flat[at : at + n * w].reshape(n, w))
            at += n * w
        return cls(np.frombuffer(row["vectors"], np.float64).reshape(-1, dim), np.frombuffer(row["ids"], np.int64), np.frombuffer(row["offsets"], np.int64), list(row["sizes"]), links)


def valid(embeddings: DataFrame) -> DataFrame:
    """vec_id, embedding (array<double>), dim of the vectors that take part."""
    own = embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return own.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite & F.exists("embedding", lambda x: x != 0)).withColumn("dim", F.size("embedding"))


def neighbours(embeddings: DataFrame, queries: DataFrame, k: int = 10, beam: int = BEAM, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score; both inputs have vec_id and embedding."""
    spark = embeddings.sparkSession
    rows, asks = valid(embeddings), valid(queries)
    sizes = rows.groupBy("dim").count().collect()  # one row for each vector length
    shards = spark.createDataFrame([(r["dim"], max(1, -(-r["count"] // shard_rows))) for r in sizes], "dim int, shards int")
    dealt = rows.join(F.broadcast(shards), "dim").withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.col("shards")).cast("int"))

    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        g = Graph.build(pdf.vec_id.to_numpy(np.int64), np.array(pdf.embedding.tolist(), np.float64))
        return pd.DataFrame([{"dim": key[0], "shard": key[1], **g.row()}])

    fields = "dim int, shard int, vectors binary, ids binary, offsets binary, sizes array<int>, links binary"
    graphs = written(dealt.select("dim", "shard", "vec_id", "embedding").groupBy("dim", "shard").applyInPandas(build, fields), "graphs")

    # one stream for each shard: its graph, then the queries, so a graph travels once however many queries there are
    none = lambda **kinds: [F.lit(None).cast(k).alias(n) for n, k in kinds.items()]
    held = graphs.select("dim", "shard", "vectors", "ids", "offsets", "sizes", "links", *none(vec_id="bigint", embedding="array<double>", asked="bigint"))
    upto = F.explode(F.sequence(F.lit(0), F.col("shards") - 1))
    sent = (
        asks.join(F.broadcast(shards), "dim")
        .withColumn("shard", upto)
        # a repeated id with another vector is another query
        .select("dim", "shard", *none(vectors="binary", ids="binary", offsets="binary", sizes="array<int>", links="binary"), "vec_id", "embedding", F.xxhash64("embedding").alias("asked"))
    )
    stream = held.unionByName(sent).repartition("dim", "shard").sortWithinPartitions("dim", "shard", F.asc_nulls_first("vec_id"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph, dim, waiting = None, 0, []

        def found() -> pa.RecordBatch:
            q, own = np.array([w[1] for w in waiting], np.float64), np.array([w[0] for w in waiting], np.int64)
            near = graph.search_all(q, own, k, beam)
            rows = [(i, asked, x, d) for (i, _, asked), hits in zip(waiting, near, strict=True) for d, x in hits]
            waiting.clear()
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(kinds)], names=["query_id", "asked", "vec_id", "score"])

        for b in batches:
            for row in b.to_pylist():
                if row["vectors"] is not None:
                    if waiting:
                        yield found()
                    dim = row["dim"]
                    graph = Graph.of(row, dim)
                elif graph is not None:
                    waiting.append((row["vec_id"], row["embedding"], row["asked"]))
                    if len(waiting) >= QUERY_ROWS:
                        yield found()
        if waiting:
            yield found()

    hits = arrow_map(stream, search, "query_id bigint, asked bigint, vec_id bigint, score double")
    w = Window.partitionBy("query_id", "asked").orderBy("score", "vec_id")
    ranked = hits.distinct().withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op8_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return neighbours(rows, rows.where("vec_id % 100 = 0"))
