"""URL rules judged by Bloom filter cascades.

A key is a host suffix followed by a path prefix, as in ``example.com/en/``. The key
universe of a corpus is every key that any of its URLs could match. A cascade stores a
set of listed keys: level 0 is a Bloom filter of the listed keys; level 1 holds the keys
of the universe that pass it wrongly; level 2 the listed keys that pass level 1; and so
on until no key is left. Membership is the parity of the first level that a key fails,
which is exact for every key of the universe, with no join when URLs are judged.

Bounds. A level has at most ``MAX_BITS`` bits; that bounds what the driver gathers (its
words, summed by OR in the cluster) and what is broadcast. More keys than that make more
false positives, which later levels hold: the answer stays exact. Beyond about 1e8 listed keys
levels are full and the build ends with an error; such lists are to be split by ranges of a hash.

Input cases. A null URL or one without ``://`` has empty host and path, matches no rule
and gets the default verdict. Repeated rows are judged alike. Of fitting rules the
longest string wins; a rule in both lists blocks. No rules or no rows: no error.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm.common import ascii_lower, bitmap, table, test_bits, written

MAX_BITS = 1 << 27
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"

Rule = tuple[str, str, str]  # verdict, host, path


def host(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, PARTS, 1)), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def keys(host: Column, path: Column, labels: int, lengths: Sequence[int]) -> Column:
    """The keys of a URL that some listed key could equal, longest first."""
    parts = F.split(host, r"\.", -1)
    n = F.least(F.size(parts), F.lit(labels))
    hosts = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(parts, -i, i), "."))
    paths = F.transform(F.filter(F.array(*map(F.lit, lengths)), lambda k: k <= F.length(path)), lambda k: F.substring(path, F.lit(1), k))
    both = F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: F.concat(h, p))))
    # the sort is on (length, key), descending
    ranked = F.sort_array(F.transform(both, lambda k: F.struct(F.length(k).alias("n"), k.alias("k"))), asc=False)
    return F.transform(ranked, lambda x: x["k"])


def _positions(h1: np.ndarray, h2: np.ndarray, bits: int, hashes: int, level: int):
    """Places in a level's filter. Every level hashes anew, else keys that meet in one would meet in all."""
    salt = np.uint64((level + 1) * 0x9E3779B97F4A7C15 % 2**64)
    x = (h1 ^ salt) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(31))) + h2
    for i in range(hashes):
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        yield (x >> np.uint64(20)) % np.uint64(bits)


class Level:
    def __init__(self, map_: np.ndarray, bits: int, hashes: int, number: int):
        self.map, self.bits, self.hashes, self.number = map_, bits, hashes, number

    def has(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        ok = np.ones(len(h1), bool)
        for p in _positions(h1, h2, self.bits, self.hashes, self.number):
            ok &= test_bits(self.map, p.astype(np.int64))
        return ok


class Cascade:
    def __init__(self, levels: list[Level]):
        self.levels = levels

    def has(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Exact for keys of the universe that the cascade was built over."""
        out, open_ = np.zeros(len(h1), bool), np.arange(len(h1))
        for k, level in enumerate(self.levels):
            passed = level.has(h1[open_], h2[open_])
            out[open_[~passed]] = k % 2 == 1
            open_ = open_[passed]
        out[open_] = len(self.levels) % 2 == 1
        return out


def _hashed(keys: DataFrame) -> DataFrame:
    return keys.select(F.xxhash64(F.lit(11), "key").alias("h1"), F.xxhash64(F.lit(23), "key").alias("h2"))


def _level(hashed: DataFrame, n: int, hashes: int, number: int) -> Level:
    """A Bloom filter of ``n`` hashed keys; its bits are OR-ed in the cluster, and the driver gets it in pieces of 4 KB."""
    bits = int(min(MAX_BITS, max(64, math.ceil(n * hashes * 1.4427 / 64) * 64)))

    def places(batches: Iterable[pd.DataFrame]):
        for b in batches:
            h1, h2 = b["h1"].to_numpy().view(np.uint64), b["h2"].to_numpy().view(np.uint64)
            for p in _positions(h1, h2, bits, hashes, number):
                yield pd.DataFrame({"place": p.astype(np.int64)})

    return Level(bitmap(hashed.mapInPandas(places, "place bigint"), bits), bits, hashes, number)


def build(listed: DataFrame, universe: DataFrame, max_levels: int = 64) -> Cascade:
    """A cascade of the keys in ``listed`` (column key) over those in ``universe`` (column key, distinct)."""
    inside = written(_hashed(listed.select("key").distinct()), "listed")
    outside = written(_hashed(universe.select("key").join(listed.select("key"), "key", "left_anti")), "universe")
    n, others, levels = inside.count(), outside.count(), []
    if not n:
        return Cascade([])
    hashes = max(1, round(math.log2(max(2.0, others / n))))
    held, tested = inside, outside
    while n:
        if len(levels) == max_levels:
            raise RuntimeError("the cascade doesn't end: keys with equal hashes")
        level = _level(held, n, hashes, len(levels))
        levels.append(level)
        hashes = 2 + len(levels) % 2

        def passed(batches: Iterable[pd.DataFrame], level=level):
            for b in batches:
                yield b[level.has(b["h1"].to_numpy().view(np.uint64), b["h2"].to_numpy().view(np.uint64))]

        wrong = written(tested.mapInPandas(passed, "h1 bigint, h2 bigint"), "wrong")
        held, tested, n = wrong, held, wrong.count()
    return Cascade(levels)


def judge(pages: DataFrame, rules: Sequence[Rule] | DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """page_id, host, path, rule and verdict for every row. ``rules``: verdict, host, path; a list that is too long for the driver is a table."""
    spark = pages.sparkSession
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame(list(rules), "verdict string, host string, path string")
    lengths = sorted(r[0] for r in rules.select(F.length("path")).distinct().collect()) or [1]  # no more than a path has characters
    labels = rules.agg(F.max(F.size(F.split("host", r"\.", -1)))).first()[0] or 1
    parts = pages.select(F.col(id_col).alias("page_id"), host(F.col(url_col)).alias("host"), path(F.col(url_col)).alias("path"))
    keyed = parts.withColumn("keys", keys(F.col("host"), F.col("path"), labels, lengths))
    universe = written(keyed.select(F.explode("keys").alias("key")).distinct(), "keys")
    lists = [rules.where(F.col("verdict") == verdict).select(F.concat("host", "path").alias("key")) for verdict in ("block", "allow")]
    cascades = spark.sparkContext.broadcast([build(x, universe) for x in lists])

    @F.pandas_udf("int")
    def first(h1: pd.Series, h2: pd.Series) -> pd.Series:
        """Of each row's keys the first that is listed: its place from 1, negative for the allow list, 0 for none."""
        ends = np.cumsum([len(x) for x in h1]) if len(h1) else np.zeros(0, int)
        a = np.concatenate([*h1, np.zeros(0, np.int64)]).astype(np.int64).view(np.uint64)
        b = np.concatenate([*h2, np.zeros(0, np.int64)]).astype(np.int64).view(np.uint64)
        blocked, allowed = (c.has(a, b) for c in cascades.value)
        out, start = [], 0
        for end in ends:
            hit = np.flatnonzero(blocked[start:end] | allowed[start:end])
            out.append(0 if not len(hit) else int(hit[0] + 1) * (1 if blocked[start + hit[0]] else -1))
            start = end
        return pd.Series(out, dtype="int32")

    hashes = [F.transform("keys", lambda k: F.xxhash64(F.lit(11), k)), F.transform("keys", lambda k: F.xxhash64(F.lit(23), k))]
    found = keyed.withColumn("at", first(*hashes))
    return found.select(
        "page_id",
        "host",
        "path",
        F.when(F.col("at") != 0, F.get("keys", F.abs("at") - 1)).alias("rule"),
        F.when(F.col("at") > 0, "block").when(F.col("at") < 0, "allow").otherwise(default).alias("verdict"),
    )


# fixed values: the rules of the query
RULES: list[Rule] = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), RULES)


OP3_SQL = r"""
WITH rules(verdict, h, p) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'),
       ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
parts AS (
  SELECT page_id, row_number() OVER () AS n,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages),
fit AS (
  SELECT parts.*, h || p AS rule, verdict
  FROM parts LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM fit QUALIFY row_number() OVER (PARTITION BY n ORDER BY length(rule) DESC NULLS LAST) = 1
"""
