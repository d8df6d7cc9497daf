"""Centroid clustering with Drake's adaptive bounds, in exact integers.

A vector's state holds an upper bound of the distance to its own centroid, a lower bound for
each of several centroids that were next nearest, with their numbers, and one remainder bound
for all others. When centroids move, bounds are loosened by the lengths of the moves; a vector
whose upper bound is below all its lower bounds keeps its centroid unread. Else its own distance
is measured; then only those stored centroids whose bounds still reach it; and all centroids,
with a new order, only if the remainder bound reaches it. A round's greatest need says how many
bounds the next keeps; a dropped one goes into the remainder.

Distances are sums of integer squares. Bounds are floating-point numbers widened by more than
their rounding, and a tie never certifies, so results equal those of a full scan.

Each round is one pass over a table of states in the shared folder, which a pass replaces, and
one aggregate of at most ``k`` rows with a count and a sum for each component. The driver holds
the ``k`` centroids and nothing else.

Input cases. Vectors that are null, of another length, or hold null or non-finite components
take no part. Rows that repeat an id are vectors of their own; null ids come last among first
centroids, equal hashes are ordered by the vectors. With fewer than ``k`` vectors there are as
many centroids as vectors; an empty table gives no rows. Integers beyond 2**27 are an error, as
the squared distances must fit a long; so is an inertia beyond a long. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm.common import arrow_map, drop, table, written

LARGEST = 1 << 27
#: more than the relative rounding of a square root, a sum and a product
SLACK = 1e-12
STATE = "vec_id bigint, v array<int>, own int, upper double, near array<int>, low array<double>, rest double, needed int, measured int"


class Bounds(NamedTuple):
    """States of some vectors: own centroid, upper bound; stored centroids and their lower bounds; remainder bound."""

    own: np.ndarray
    upper: np.ndarray
    near: np.ndarray
    low: np.ndarray
    rest: np.ndarray


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows to rows."""
    gap = x - c
    return (gap * gap).sum(-1)


def scan(x: np.ndarray, centroids: np.ndarray, keep: int) -> Bounds:
    """Order all centroids by distance, then number: the first is the own one, ``keep`` more are stored."""
    d2 = np.stack([squares(x, c) for c in centroids], 1)
    order = np.argsort(d2, axis=1, kind="stable")
    d = np.sqrt(np.take_along_axis(d2, order, 1).astype(np.float64))
    rest = d[:, keep + 1] * (1 - SLACK) if keep + 1 < len(centroids) else np.full(len(x), np.inf)
    return Bounds(order[:, 0], d[:, 0] * (1 + SLACK), order[:, 1 : keep + 1], d[:, 1 : keep + 1] * (1 - SLACK), rest)


def moved(s: Bounds, moves: np.ndarray, keep: int) -> Bounds:
    """Bounds after the centroids' moves; only the ``keep`` lowest stay, the others join the remainder."""
    upper = (s.upper + moves[s.own]) * (1 + SLACK)
    low = s.low - moves[s.near] * (1 + SLACK) - SLACK * np.abs(s.low)
    rest = np.where(np.isinf(s.rest), np.inf, s.rest - moves.max() * (1 + SLACK) - SLACK * np.abs(s.rest))
    order = np.argsort(low, axis=1, kind="stable")
    near, low = np.take_along_axis(s.near, order, 1), np.take_along_axis(low, order, 1)
    if keep < low.shape[1]:
        rest = np.minimum(rest, low[:, keep])
    return Bounds(s.own, upper, near[:, :keep], low[:, :keep], rest)


def settled(x: np.ndarray, centroids: np.ndarray, s: Bounds) -> tuple[Bounds, np.ndarray, np.ndarray]:
    """The states with right own centroids; how many stored bounds each vector needed, how many distances were measured."""
    own, upper, near, low, rest = (a.copy() for a in s)
    keep = near.shape[1]
    needed, measured = np.zeros(len(x), np.int32), np.zeros(len(x), np.int32)
    least = np.minimum(low.min(1), rest) if keep else rest
    rows = np.flatnonzero(upper >= least)
    upper[rows] = np.sqrt(squares(x[rows], centroids[own[rows]]).astype(np.float64)) * (1 + SLACK)
    measured[rows] += 1
    rows = rows[upper[rows] >= least[rows]]

    every = upper[rows] >= rest[rows]  # the remainder can't be certified
    full, some = rows[every], rows[~every]
    if len(full):
        new = scan(x[full], centroids, keep)
        for a, b in zip((own, upper, near, low, rest), new, strict=True):
            a[full] = b
        measured[full], needed[full] = len(centroids), keep
    if len(some):
        best = squares(x[some], centroids[own[some]])
        who = own[some].copy()
        for j in range(keep):
            reach = low[some, j] <= upper[some]
            at = some[reach]
            if not len(at):
                continue
            d2 = squares(x[at], centroids[near[at, j]])
            measured[at] += 1
            needed[at] = j + 1
            c, b, w = near[at, j].copy(), best[reach], who[reach]
            won = (d2 < b) | ((d2 == b) & (c < w))
            # the one that isn't the best stays in the slot, with its exact distance
            near[at, j] = np.where(won, w, c)
            low[at, j] = np.sqrt(np.where(won, b, d2).astype(np.float64)) * (1 - SLACK)
            best[reach], who[reach] = np.where(won, d2, b), np.where(won, c, w)
        own[some] = who
        upper[some] = np.sqrt(best.astype(np.float64)) * (1 + SLACK)
    return Bounds(own, upper, near, low, rest), needed, measured


def _matrix(column, kind) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(kind)


def _lists(a: np.ndarray, kind) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1, dtype=np.int32) * a.shape[1]), pa.array(a.ravel(), kind))


def _state(vec_id, v, s: Bounds, needed: np.ndarray, measured: np.ndarray) -> pa.RecordBatch:
    ints, reals = pa.int32(), pa.float64()
    columns = [vec_id, v, pa.array(s.own, ints), pa.array(s.upper, reals), _lists(s.near, ints), _lists(s.low, reals), pa.array(s.rest, reals), pa.array(needed, ints), pa.array(measured, ints)]
    return pa.RecordBatch.from_arrays(columns, names=["vec_id", "v", "own", "upper", "near", "low", "rest", "needed", "measured"])


def integers(embeddings: DataFrame, dim: int, scale: int) -> DataFrame:
    """vec_id, v: floor(scale * x) of the vectors that take part."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    scaled = F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * F.least(F.greatest(x.cast("double"), F.lit(-1e12)), F.lit(1e12))))
    rows = embeddings.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding").where((F.size("embedding") == dim) & fine).select("vec_id", scaled.alias("v"))
    large = F.exists("v", lambda x: F.abs(x) > LARGEST)
    return rows.select("vec_id", F.when(large, F.raise_error(F.lit(f"a component exceeds {LARGEST} after scaling"))).otherwise(F.col("v")).cast("array<int>").alias("v"))


def clusters(embeddings: DataFrame, k: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, seed: int = 3, stored: int | None = None) -> tuple[DataFrame, list[list[int]]]:
    """States (``STATE``) of all vectors after the last assignment, and the centroids.

    ``embeddings`` has vec_id and embedding. ``stored``: lower bounds to begin with, half of ``k`` unless said.
    """
    spark = embeddings.sparkSession
    kept = integers(embeddings, dim, scale)
    first = kept.orderBy(F.asc_nulls_last(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)), "v").limit(k)
    centroids = np.array([r.v for r in first.collect()], np.int64).reshape(-1, dim)
    if not len(centroids):
        return spark.createDataFrame([], STATE), []
    keep = min(len(centroids) - 1, max(1, k // 2) if stored is None else stored)

    def begin(batches):
        for b in batches:
            x = _matrix(b.column(1), np.int64)
            yield _state(b.column(0), b.column(1), scan(x, centroids, keep), np.full(len(x), keep), np.full(len(x), len(centroids)))

    state = written(arrow_map(kept, begin, STATE), "state")
    for _ in range(rounds):
        sums = state.groupBy("own").agg(F.count(F.lit(1)).alias("n"), F.max("needed").alias("needed"), F.array(*[F.sum(F.get("v", F.lit(i)).cast("bigint")) for i in range(dim)]).alias("s")).collect()
        new = centroids.copy()
        for r in sums:
            new[r.own] = [x // r.n for x in r.s]
        need = min(keep, max(1, max((r.needed for r in sums), default=1)))
        last, state = state, written(arrow_map(state, _pass(centroids, new, need), STATE), "state")
        drop(last)
        centroids, keep = new, need
    return state, centroids.tolist()


def _pass(old: np.ndarray, new: np.ndarray, keep: int):
    """A round: loosened bounds, then the assignment."""
    moves = np.sqrt(squares(old, new).astype(np.float64)) * (1 + SLACK)

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column(1), np.int64)
            own, upper, rest = (b.column(i).to_numpy(zero_copy_only=False) for i in (2, 3, 6))
            s = moved(Bounds(own.astype(np.int64), upper, _matrix(b.column(4), np.int64), _matrix(b.column(5), np.float64), rest), moves, keep)
            yield _state(b.column(0), b.column(1), *settled(x, new, s))

    return run


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    state, centroids = clusters(table(spark, sf_dir, "embeddings"))
    text = [",".join(map(str, c)) for c in centroids]
    known = F.broadcast(spark.createDataFrame([(i, c, hashlib.sha256(t.encode()).hexdigest()) for i, (c, t) in enumerate(zip(centroids, text, strict=True))], "cluster int, c array<bigint>, centroid_sha256 string"))
    gap = F.zip_with("v", "c", lambda a, b: (a - b) * (a - b))
    rows = state.select("vec_id", "v", F.col("own").alias("cluster")).join(known, "cluster")
    rows = rows.select("vec_id", "cluster", F.aggregate(gap, F.lit(0).cast("bigint"), lambda s, x: s + x).alias("distance"), "centroid_sha256")
    totals = rows.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).collect()  # k rows at most
    sums = F.broadcast(spark.createDataFrame([(r.cluster, r.cluster_inertia, sum(t.cluster_inertia for t in totals)) for r in totals], "cluster int, cluster_inertia bigint, inertia bigint"))
    return rows.join(sums, "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql(k: int = 8, rounds: int = 10, dim: int = 64) -> str:
    """The same by full scans, a common table expression for each assignment and each set of centroids."""
    ctes = [
        f"""kept AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
  FROM embeddings WHERE len(embedding) = {dim} AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0)""",
        f"c0 AS MATERIALIZED (SELECT c, v FROM (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id) NULLS LAST, v) - 1 AS c, v FROM kept) WHERE c < {k})",
    ]
    for r in range(rounds + 1):
        ctes.append(f"""a{r} AS MATERIALIZED (SELECT rid, vec_id, v, b.c AS c, b.d AS d FROM (SELECT k.rid, k.vec_id, k.v, min({{'d': list_sum([(z[1] - z[2]) * (z[1] - z[2]) FOR z IN list_zip(k.v, n.v)]), 'c': n.c}}) AS b
  FROM kept k, c{r} n GROUP BY ALL))""")
        if r < rounds:
            ctes.append(f"""c{r + 1} AS MATERIALIZED (SELECT o.c, coalesce(m.v, o.v) AS v FROM c{r} o LEFT JOIN (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v
  FROM (SELECT c, i, sum(v[i]) AS s, count(*) AS n FROM a{r}, range(1, {dim + 1}) t(i) GROUP BY c, i) GROUP BY c) m ON m.c = o.c)""")
    return f"""WITH {", ".join(ctes)}
SELECT a.vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(a.d AS BIGINT) AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(n.v, ',')) AS centroid_sha256 FROM a{rounds} a JOIN c{rounds} n ON n.c = a.c"""


OP13_SQL = _sql()
