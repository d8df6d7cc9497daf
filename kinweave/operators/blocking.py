"""Candidate generation: equi-joins on exploded blocking keys.

A posting is a row (country, key_type, key, t_id). Posting lengths are aggregates, and
limits are filters on them or ranks inside a key, so no list is ever built. Country is
part of every key. Orders that were left to chance elsewhere are by id here.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.checkpoint import written
from kinweave.session import small_methods


def _key(kind: str, value: Column, ok: Column) -> Column:
    return F.when(ok & value.isNotNull(), F.struct(F.lit(kind).alias("key_type"), value.alias("key")))


def _keys() -> Column:
    """Up to six keys (key_type, key) of a normalised record."""
    w1, w2 = F.get("name_tokens", F.lit(0)), F.get("name_tokens", F.lit(1))
    number = F.get("address_numbers", F.lit(0))
    street = F.get(F.filter("address_tokens", lambda t: (F.length(t) >= 4) & ~t.rlike(r"^\p{Nd}+$")), F.lit(0))
    return F.array_compact(
        F.array(
            _key("w1", w1, F.length(w1) >= 3),
            _key("pfx3", F.substring(w1, 1, 3), F.length(w1) >= 3),
            _key("pfx", F.substring(w1, 1, 4), F.length(w1) >= 4),
            _key("w2", w2, F.length(w2) >= 3),
            _key("num", number, F.lit(True)),
            _key("addr", street, F.lit(True)),
        )
    )


def blocking_keys(records: DataFrame, *more: str) -> DataFrame:
    """country, entity_id, key_type, key (and ``more`` columns): up to six keys for each normalised record, one of a type (B-1).

    ``w1`` first name word, ``pfx3`` and ``pfx`` its first 3 and 4 characters, ``w2`` second
    name word, ``num`` first address number, ``addr`` first long address word.
    """
    return records.select("country", "entity_id", *more, F.explode(_keys()).alias("k")).select("country", "entity_id", "k.key_type", "k.key", *more)


def key_histogram(keys: DataFrame) -> DataFrame:
    """country, key_type, keys, postings, longest."""
    by_key = keys.groupBy("country", "key_type", "key").agg(F.count(F.lit(1)).alias("n"))
    return by_key.groupBy("country", "key_type").agg(
        F.count(F.lit(1)).alias("keys"), F.sum("n").alias("postings"), F.max("n").alias("longest")
    )


def token_jaccard(a: Column, b: Column) -> Column:
    """Jaccard of two token arrays, 0 if either is empty (B-4)."""
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


#: key types whose records share a name word, so that no pair of them has Jaccard 0
SHARING = ("w1", "w2")
#: postings of more than so many times ``top`` are bounded; shorter ones meet as they are, as bounds let about so many through
LONG = 8
BY = ["country", "key_type", "key"]
#: pairs that a task makes distinct and ranks, about 200 bytes each
DEALT = 1 << 19
#: asking records of a task; one meets some hundred pairs, 6 * ``max_posting`` at most
ASKING = 1024


def dealt(df: DataFrame, n: int | None, each: int, *by: str) -> DataFrame:
    """``df`` dealt out by columns to one task for ``each`` of ``n`` units.

    The number is given, as adaptive execution joins partitions by their compressed bytes, and ids compress well.
    """
    least = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(least, -(-(n or 0) // each)), *by)


def _subsets(words: Column, n: int) -> Column:
    """Subsets of ``n`` of the words, which are sorted and distinct, as texts."""
    if n == 1:
        return words
    rest = lambda i: F.slice(words, i + 2, F.size(words))
    longer = lambda w, i: F.transform(_subsets(rest(i), n - 1), lambda s: F.concat_ws(" ", w, s))
    return F.flatten(F.transform(words, longer))


def _first(df: DataFrame, n: int, by: list[str], *order: str) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


def postings(targets: DataFrame, max_posting: int) -> DataFrame:
    """country, key_type, key, n, size, words (sorted), t_id: the postings of keys that aren't hot. ``n``: length of the posting."""
    posts = blocking_keys(targets.dropDuplicates(["entity_id"]), "name_tokens").select(*BY, F.col("entity_id").alias("t_id"), F.array_sort(F.array_distinct("name_tokens")).alias("words"))
    # a key's length is aggregated before anything is joined: hot keys never meet
    small = posts.groupBy(*BY).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= max_posting)
    return posts.join(small, BY).withColumn("size", F.size("words"))


def bounded_postings(posts: DataFrame, top: int) -> dict[int, DataFrame]:
    """Of long postings what a best ``top`` can come from: 0 by key, 1 to 3 by key and that many name words (``part``).

    Targets of one name have one Jaccard with any record, so of each only the first ``top`` ids
    count. With a record X, a target Y that shares exactly a set S of k words has Jaccard
    k / (|X| + |Y| - k); targets that hold S and come first by (|Y|, id) aren't worse and rank
    before it, so ``top`` of them are enough for k = 1 and 2. Those that share three words are
    all there. Those that share none have Jaccard 0, and each of the key's first ``top`` ids ranks
    before any later one of them, whether it shares a word or not.
    """
    names = _first(posts, top, [*BY, "words"], "t_id")
    part = lambda n: names.where(F.col("size") >= n).withColumn("part", F.explode(_subsets(F.col("words"), n)))
    return {
        0: _first(posts.where(~F.col("key_type").isin(*SHARING)), top, BY, "t_id"),
        1: _first(part(1), top, [*BY, "part"], "size", "t_id"),
        2: _first(part(2), top, [*BY, "part"], "size", "t_id"),
        3: part(3),
    }


def met_pairs(asks: DataFrame, posts: DataFrame, top: int) -> DataFrame:
    """s1_id, t_id, jaccard, with repeats: ``asks`` (s1_id, keys, words) meets the postings; every pair that can be among the best ``top`` is there."""
    keyed = asks.select("s1_id", "country", "s1_words", F.explode("keys").alias("k")).select("s1_id", "country", "s1_words", "k.key_type", "k.key")
    long = F.col("n") > LONG * top
    jaccard = lambda p: p.select("s1_id", "t_id", token_jaccard(F.col("s1_words"), F.col("words")).alias("jaccard"))
    out = jaccard(keyed.join(posts.where(~long), BY))
    bounded = bounded_postings(posts.where(long), top)
    probes = keyed.join(posts.where(long).select(*BY).distinct(), BY, "left_semi")
    out = out.unionByName(jaccard(probes.join(bounded[0], BY)))
    for n in (1, 2, 3):
        parts = probes.withColumn("part", F.explode(_subsets(F.col("s1_words"), n)))
        out = out.unionByName(jaccard(parts.join(bounded[n], [*BY, "part"])))
    return out


def candidates(s1: DataFrame, targets: DataFrame, max_posting: int = 2000, top: int = 30) -> DataFrame:
    """s1_id, t_id, rank, jaccard: union of postings, hot keys skipped, best ``top`` by name Jaccard (B-2, B-3, L-7).

    Targets are distinct by id. Up to ``top`` candidates all stay; beyond, the best do, ties by id.
    Records of source 1 with equal keys and names have the same candidates, so one of them asks
    and a hot name asks once. Long postings are bounded before pairs meet (``bounded_postings``).
    """
    own = s1.select("entity_id", "country", F.array_sort(_keys()).alias("keys"), F.array_sort(F.array_distinct("name_tokens")).alias("s1_words"))
    own = own.withColumn("asked", F.unhex(F.sha2(F.to_json(F.struct("country", "keys", "s1_words")), 256)))
    asks = written(own.groupBy("asked").agg(*[F.first(c).alias(c) for c in ("country", "keys", "s1_words")]).withColumnRenamed("asked", "s1_id"), "asks")
    posts = written(postings(targets, max_posting), "postings")
    scored = dealt(met_pairs(asks, posts, top), asks.count(), ASKING, "s1_id").groupBy("s1_id", "t_id").agg(F.max("jaccard").alias("jaccard"))
    w = Window.partitionBy("s1_id").orderBy(F.desc("jaccard"), "t_id")
    best = scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).withColumnRenamed("s1_id", "asked")
    return own.select(F.col("entity_id").alias("s1_id"), "asked").join(best, "asked").select("s1_id", "t_id", "jaccard", "rank")


def with_true_matches(pairs: DataFrame, truth: DataFrame, pool: DataFrame) -> DataFrame:
    """Candidate pairs and the true pairs whose target is in the pool (B-10)."""
    known = truth.join(pool.select(F.col("entity_id").alias("t_id")), "t_id", "left_semi")
    return pairs.select("s1_id", "t_id").unionByName(known.select("s1_id", "t_id")).distinct()


def candidate_recall(s1: DataFrame, truth: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row: true_pairs, captured, missed, recall, avg_candidates, max_candidates (B-11).

    Singletons don't count; recall is 1 where there is no true pair.
    """
    found = truth.join(pairs.select("s1_id", "t_id", F.lit(1).alias("hit")), ["s1_id", "t_id"], "left")
    t = found.agg(F.count(F.lit(1)).alias("true_pairs"), F.count("hit").alias("captured"))
    per = s1.select(F.col("entity_id").alias("s1_id")).join(pairs.groupBy("s1_id").agg(F.count(F.lit(1)).alias("n")), "s1_id", "left")
    c = per.agg(F.avg(F.coalesce("n", F.lit(0))).alias("avg_candidates"), F.max(F.coalesce("n", F.lit(0))).alias("max_candidates"))
    recall = F.when(F.col("true_pairs") == 0, 1.0).otherwise(F.col("captured") / F.col("true_pairs"))
    return t.crossJoin(c).select(  # two rows of one
        "true_pairs", "captured", (F.col("true_pairs") - F.col("captured")).alias("missed"), recall.alias("recall"), "avg_candidates", "max_candidates"
    )


#: of ``Gate.prefix``: prefixes are used however many candidates there are
ALWAYS = 1 << 30


@dataclass(frozen=True)
class Gate:
    """Limits of the gated index (B-5 to B-9).

    ``take``: postings up to this length are used whole. ``geo``: of longer ones the first so
    many with the same region; ``any``: without a region the first so many; 0 drops the key.
    ``stop``: stems are used rarest first until so many candidates are found; 0 never stops.
    """

    take: int
    geo: int
    any: int
    stop: int = 0
    prefix: int = 0  # use 4-character prefixes while fewer candidates than this are found; 0: never
    prefix_take: int = 200
    numbers: int = 50  # limit for number keys
    address_words: int = 2
    no_space_query: bool = False
    geo_numbers: bool = True


GATES = {
    "v2": Gate(150, 0, 0, prefix=ALWAYS, prefix_take=150, numbers=50, geo_numbers=False),
    "v3": Gate(300, 200, 250, prefix=ALWAYS, prefix_take=300, numbers=50, geo_numbers=False),
    "v4": Gate(200, 150, 150, prefix=ALWAYS, prefix_take=200, numbers=50, geo_numbers=False),
    "production": Gate(200, 60, 60, stop=50, prefix=30, numbers=30),
    "turbo": Gate(200, 100, 100, stop=50, prefix=30, numbers=1 << 30),
    "v5": Gate(200, 50, 50, stop=50, prefix=30, numbers=30),
    "champion": Gate(200, 40, 40, stop=40, prefix=0, numbers=20),
    "refined": Gate(200, 40, 40, stop=40, prefix=0, numbers=20, address_words=4, no_space_query=True),
}


def _postings(rich: DataFrame, gate: Gate) -> DataFrame:
    """country, kind, key, place, id, geo of the rich records' stems, prefixes, compounds and joined names. ``place``: of a stem in its brand.

    Lists of texts are made distinct before keys come of them: distinct keys would be compared each with each, as they are
    structs, and a record of junk has thousands.
    """
    none = F.array().cast("array<struct<kind:string,key:string,place:int>>")
    key = lambda kind, value, place=None: F.struct(F.lit(kind).alias("kind"), value.alias("key"), F.lit(place).cast("int").alias("place") if place is None else place.cast("int").alias("place"))
    stems, numbers = F.array_distinct("stems"), F.array_distinct("raw_nums")
    stem = F.transform(stems, lambda s, i: key("stem", s, i))
    prefix = F.transform(F.filter(F.slice("stems", 1, 1), lambda s: F.length(s) >= 4), lambda s: key("pfx", F.substring(s, 1, 4)))
    joined = F.when((F.length("no_space") >= 5) & ~F.array_contains("stems", F.col("no_space")), F.array(key("stem", F.col("no_space")))).otherwise(none)
    words = F.array_distinct(F.slice("addr_tokens", 1, gate.address_words))
    num = F.flatten(F.transform(numbers, lambda n: F.transform(words, lambda w: key("num", F.concat_ws("|", n, w)))))
    pin = F.transform(F.filter(numbers, lambda n: F.length(n) >= 5), lambda n: key("pin", n))
    region = F.when(F.col("geo") != "", F.transform(numbers, lambda n: key("numgeo", F.concat_ws("|", n, F.col("geo"))))).otherwise(none)
    parts = [stem, prefix, joined, num, pin] + [region] * gate.geo_numbers
    return rich.select("country", F.col("entity_id").alias("id"), "geo", F.explode(F.concat(*parts)).alias("k")).select(
        "country", "k.kind", "k.key", "k.place", "id", "geo"
    )


@dataclass(frozen=True)
class Sieve:
    """Pairs that fail ``keep`` may be left out of the candidates. It reads ``columns`` of both records, as ``a_`` and ``b_``."""

    columns: tuple[str, ...]
    keep: Column


#: pairs that a task looks at where postings meet; they are streamed, so this bounds time and not memory
MEETING = 1 << 22
_GATED = ["country", "kind", "key"]


def _needed_asks(asks: DataFrame, posts: DataFrame, length: DataFrame, gate: Gate) -> DataFrame:
    """Of the asks for stems and prefixes those that can add a candidate, with ``length``.

    How many targets a stem gives is known from lengths alone. After a stem that gives ``stop`` of them no other is used, and
    where one gives ``prefix`` no prefix is, so these needn't meet anything. Ids of targets are distinct.
    """
    stem = F.col("kind") == "stem"
    region = posts.where("t_geo <> ''").groupBy(*_GATED, F.col("t_geo").alias("geo")).agg(F.count(F.lit(1)).alias("near"))
    asks = asks.where(F.col("kind").isin("stem", "pfx") if gate.prefix else stem).join(length, _GATED).join(region, [*_GATED, "geo"], "left")
    long = F.when(F.col("geo") != "", F.least(F.coalesce("near", F.lit(0)), F.lit(gate.geo))).otherwise(F.least("length", F.lit(gate.any)))
    asks = asks.withColumn("gives", F.when(stem, F.when(F.col("length") <= gate.take, F.col("length")).otherwise(long)))
    own = Window.partitionBy("s1_id")
    order = own.orderBy(F.when(stem, F.col("length")).otherwise(1 << 62), F.coalesce("place", F.lit(1 << 20))).rowsBetween(Window.unboundedPreceding, -1)
    asks = asks.withColumn("earlier", F.coalesce(F.max("gives").over(order), F.lit(0))).withColumn("most", F.coalesce(F.max("gives").over(own), F.lit(0)))
    needed = F.when(stem, F.col("earlier") < gate.stop).otherwise(F.col("most") < (gate.prefix if gate.prefix <= gate.stop else ALWAYS))
    return asks.where(needed).select(*_GATED, "place", "s1_id", "geo")


def _light(records: DataFrame, side: str, key: str, sieve: Sieve) -> DataFrame:
    """What a sieve reads of records, never null, which spares the condition's code the checks."""
    zero = {"bigint": F.lit(0).cast("bigint"), "string": F.lit(""), "boolean": F.lit(False)}
    return records.select(F.col("entity_id").alias(key), *[F.coalesce(c, zero[kind] if kind in zero else F.array().cast(kind)).alias(f"{side}_{c}") for c, kind in records.select(*sieve.columns).dtypes])


def _lower(of: str, name: str) -> list[Column]:
    """Of the keys ``of`` those that are numbered below ``no``, and their marks."""
    low = F.filter(of, lambda n: n < F.col("no"))
    bit = lambda n: F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(n, F.lit(64)).cast("int"))
    return [low.alias(name), F.aggregate(low, F.lit(0).cast("bigint"), lambda m, n: m.bitwiseOR(bit(n))).alias(f"{name}_mark")]


def _met_once(s1: DataFrame, targets: DataFrame, gate: Gate, asks: DataFrame, posts: DataFrame, sieve: Sieve | None, by_s1: bool) -> DataFrame:
    """The pairs of a gate that keeps all that meet, each at one key, so that nothing is made distinct.

    Keys are numbered. A record brings along which of its keys have lower numbers, and a pair that fits at a lower key of
    both is left to that one. Whether a target fits at a key is known before pairs meet: always, for its own region, or
    for records without one. Asks of a key that would meet in more than ``MEETING`` pairs are split.
    """
    word, stem = F.col("kind").isin("stem", "pfx"), F.col("kind") == "stem"
    take = F.when(stem, gate.take).otherwise(gate.prefix_take)
    most = F.when(word & (F.col("length") > take), max(gate.geo, gate.any)).otherwise(F.col("length"))
    asked = asks.where(F.lit(bool(gate.prefix)) | (F.col("kind") != "pfx"))
    length = posts.groupBy(*_GATED).agg(F.count(F.lit(1)).alias("length")).where(word | (F.col("length") <= gate.numbers))
    used = length.join(asked.groupBy(*_GATED).agg(F.count(F.lit(1)).alias("n")), _GATED).withColumn("meets", F.col("n") * most).where("meets > 0")
    used = used.withColumn("long", word & (F.col("length") > take)).withColumn("parts", F.ceil(F.col("meets") / MEETING).cast("int"))
    used = written(used.select(*_GATED, "long", "meets", "parts", F.monotonically_increasing_id().alias("no")), "keys")
    meets = used.agg(F.sum("meets")).first()[0]

    t = posts.join(used, _GATED).select("no", "parts", "long", "t_id", "t_geo")
    flags = lambda df, **on: df.withColumns({c: F.lit(c in on) for c in ("always", "near", "head")}).drop("long")
    # of a long posting only the head, or a region's head, can be used: each rank has a filter of its own, which Spark turns
    # into a limit before the shuffle, so no task sorts a long posting
    heads = flags(_first(t.where("long"), gate.any, ["no"], "t_id"), head=1).unionByName(flags(_first(t.where("long AND t_geo <> ''"), gate.geo, ["no", "t_geo"], "t_id"), near=1))
    heads = heads.groupBy("no", "parts", "t_id", "t_geo").agg(*[F.max(c).alias(c) for c in ("always", "near", "head")])
    rows = flags(t.where("NOT long"), always=1).unionByName(heads)
    t = rows.groupBy("t_id", "t_geo").agg(F.collect_set(F.struct("no", "parts", "always", "near", "head")).alias("k"))
    nos = lambda *c: F.transform(F.filter("k", lambda x: x["always"] | (x[c[0]] if c else F.lit(False))), lambda x: x["no"])
    a = asked.join(used, _GATED).groupBy("s1_id", "geo").agg(F.collect_set(F.struct("no", "parts")).alias("k"))
    if sieve:
        a, t = a.join(_light(s1, "a", "s1_id", sieve), "s1_id"), t.join(_light(targets, "b", "t_id", sieve), "t_id")
    a = a.withColumn("a_nos", F.transform("k", lambda x: x["no"])).withColumn("k", F.explode("k")).select("*", "k.*").drop("k")
    a = a.withColumn("part", F.pmod(F.xxhash64("s1_id"), F.col("parts").cast("bigint")).cast("int")).select("*", *_lower("a_nos", "low")).drop("a_nos", "parts")
    kinds = {"t_always": nos(), "t_near": nos("near"), "t_head": nos("head")}
    t = t.withColumns(kinds).withColumn("k", F.explode("k")).select("*", "k.*").drop("k")
    t = t.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), *[c for k in kinds for c in _lower(k, f"{k}_low")]).drop("parts", *kinds)

    place = lambda end: F.when(F.col("geo") == "", F.col(f"t_head_{end}")).when(F.col("geo") == F.col("t_geo"), F.col(f"t_near_{end}")).otherwise(F.col(f"t_always_{end}"))
    fit = F.col("always") | F.when(F.col("geo") == "", F.col("head")).otherwise((F.col("geo") == F.col("t_geo")) & F.col("near"))
    new = (F.col("low_mark").bitwiseAND(place("low_mark")) == 0) | ~F.arrays_overlap("low", place("low"))
    pairs = dealt(a, meets, MEETING, "no", "part").join(t, ["no", "part"]).where(fit & (sieve.keep if sieve else F.lit(True)) & new).select("s1_id", "t_id")
    if sieve:  # those left are written, so that the tasks they are dealt to follow their number
        pairs = written(pairs, "sifted")
        meets = pairs.count()
    return dealt(pairs, meets, DEALT, "s1_id") if by_s1 or sieve else pairs


def gated_candidates(s1: DataFrame, targets: DataFrame, gate: Gate, sieve: Sieve | None = None, by_s1: bool = True) -> DataFrame:
    """s1_id, t_id from the gated index (B-5 to B-9, B-13), in the rich record schema.

    "Rarest first, stop when there are enough" is a window: stems are ranked by posting
    length and place, each target counts at its first stem, and a stem is used while the
    targets before it are too few.

    Postings are written once. The pairs that meet are dealt out by source-1 record before
    anything is made distinct or ranked, to so many tasks that each has about ``DEALT`` of them,
    as a few postings can meet in many pairs. With a ``sieve`` pairs go where they meet, unless they count for a limit.
    Where all pairs that meet stay, each meets once (``_met_once``); ``by_s1=False`` leaves these where they met.
    """
    small_methods(s1.sparkSession)
    keys = _GATED
    posts = written(_postings(targets, gate).drop("place"), "posts").withColumnRenamed("id", "t_id").withColumnRenamed("geo", "t_geo")
    asks = written(_postings(s1, gate), "asks").withColumnRenamed("id", "s1_id")
    if not gate.no_space_query:
        asks = asks.where((F.col("kind") != "stem") | F.col("place").isNotNull())
    if not gate.stop and gate.prefix in (0, ALWAYS):  # every pair that meets stays
        return _met_once(s1, targets, gate, asks, posts, sieve, by_s1)
    length = posts.groupBy(*keys).agg(F.count(F.lit(1)).alias("length"))
    is_word = F.col("kind").isin("stem", "pfx")
    head = max(gate.take, gate.geo, gate.any, gate.prefix_take)
    # of a hot key only the head, or a region's head, can ever be used: each rank has a filter of its own, which Spark turns into
    # a limit before the shuffle, so no task sorts a long posting
    word = posts.where(is_word)
    ranked = lambda df, name, *by: df.withColumn(name, F.row_number().over(Window.partitionBy(*keys, *by).orderBy("t_id")))
    none = F.lit(None).cast("int")
    heads = ranked(word, "n_any").where(F.col("n_any") <= head).withColumn("n_geo", none)
    if gate.geo:
        region = ranked(word.where("t_geo <> ''"), "n_geo", "t_geo").where(F.col("n_geo") <= gate.geo).withColumn("n_any", none)
        heads = heads.unionByName(region)
    far = F.lit((1 << 31) - 1)
    heads = heads.groupBy(*keys, "t_id", "t_geo").agg(F.coalesce(F.min("n_any"), far).alias("n_any"), F.coalesce(F.min("n_geo"), far).alias("n_geo")).join(length, keys)
    numeric = posts.where(~is_word).join(length.where(F.col("length") <= gate.numbers), keys)
    stem = F.col("kind") == "stem"
    words = asks.where(is_word if gate.prefix else stem)
    if gate.stop:
        words = written(_needed_asks(asks, word, length.where(is_word), gate), "needed")
    asked = asks.where(~is_word)

    # how many pairs can meet, by the lengths of both sides
    most = F.when(is_word, F.least("length", F.lit(head))).when(F.col("length") <= gate.numbers, F.col("length")).otherwise(0)
    meets = words.unionByName(asked).groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).join(length, keys).groupBy().agg(*[F.sum(F.when(c, F.col("n") * most)).alias(n) for n, c in (("w", is_word), ("n", ~is_word))])
    of_words, of_numbers = (n or 0 for n in meets.collect()[0])
    same = (F.col("geo") != "") & (F.col("geo") == F.col("t_geo"))
    fits = lambda take: F.when(F.col("length") <= take, F.lit(True)).when(F.col("geo") != "", same & (F.col("n_geo") <= gate.geo)).otherwise(F.col("n_any") <= gate.any)
    fit = F.when(stem, fits(gate.take)).otherwise(fits(gate.prefix_take))
    if sieve:
        own, theirs = _light(s1, "a", "s1_id", sieve), _light(targets, "b", "t_id", sieve)
        sifted = dealt(asked.join(own, "s1_id"), of_numbers, MEETING, *keys).join(numeric.join(theirs, "t_id"), keys).where(sieve.keep).select("s1_id", "t_id")
        # those left are written, so that the tasks that rank them follow their number
        numbers = written(sifted, "sifted")
        of_numbers = numbers.count()
    else:
        numbers = asked.join(numeric, keys)
    met = words.join(heads, keys).where(fit)
    pairs = met.select("s1_id", "t_id", stem.alias("stem"), (~stem).alias("prefix"), "length", F.coalesce("place", F.lit(1 << 20)).alias("place")).unionByName(
        numbers.select("s1_id", "t_id", F.lit(False).alias("stem"), F.lit(False).alias("prefix"), F.lit(None).cast("long").alias("length"), F.lit(None).cast("int").alias("place"))
    )
    pairs = dealt(pairs, of_words + of_numbers, DEALT, "s1_id").withColumn("length", F.when(F.col("stem"), F.col("length")).otherwise(1 << 62))  # stems rank before all others
    pairs = pairs.withColumn("step", F.dense_rank().over(Window.partitionBy("s1_id").orderBy("length", "place")))
    first = pairs.groupBy("s1_id", "t_id").agg(
        F.min(F.when(F.col("stem"), F.col("step"))).alias("step"), F.max("prefix").alias("prefix"), F.max(~F.col("stem") & ~F.col("prefix")).alias("number")
    )
    chosen = F.col("step").isNotNull()
    if gate.stop:
        earlier = Window.partitionBy("s1_id").orderBy("step").rangeBetween(Window.unboundedPreceding, -1)
        first = first.withColumn("before", F.count("step").over(earlier))
        chosen &= F.col("before") < gate.stop
    first = first.withColumn("chosen", chosen)
    few = F.count_if(F.col("chosen")).over(Window.partitionBy("s1_id")) < gate.prefix
    return first.withColumn("few", few).where(F.col("chosen") | F.col("number") | (F.col("prefix") & F.col("few"))).select("s1_id", "t_id")


def address_index(s1: DataFrame, kept: DataFrame, least: int = 18, cap: int = 2) -> DataFrame:
    """country, addr_key, s1_id, ord, n2, n3: S1 records with a long address key and a free slot (B-12).

    ``s1``: entity_id, country, addr_key, ord (place in the file); ``kept``: s1_id, t_id.
    """
    have = kept.groupBy("s1_id").agg(
        F.count_if(F.col("t_id").startswith("S2-")).alias("n2"), F.count_if(F.col("t_id").startswith("S3-")).alias("n3")
    )
    out = s1.where(F.length("addr_key") >= least).withColumnRenamed("entity_id", "s1_id").join(have, "s1_id", "left")
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n2", "n3")})
    return out.where((F.col("n2") < cap) | (F.col("n3") < cap)).select("country", "addr_key", "s1_id", "ord", "n2", "n3")
