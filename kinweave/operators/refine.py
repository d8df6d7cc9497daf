"""Refinement of an existing match table: conflict pruning, re-ranking, caps, rescue by equal address.

Matches are (s1_id, t_id, idx); ``idx`` is the place in the s1's list, from 0. Facts are
(entity_id, nums, pins): number sets of raw addresses.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.checkpoint import drop, written
from kinweave.functions import text as X
from kinweave.operators.blocking import address_index


def address_facts(entities: DataFrame) -> DataFrame:
    raw = F.col("business_address")
    return entities.select("entity_id", X.number_set(raw).alias("nums"), X.postal_codes(raw).alias("pins"))


def conflict(a: str, b: str) -> Column:
    """Both sets have elements, and none in common."""
    return F.coalesce((F.size(a) > 0) & (F.size(b) > 0) & ~F.arrays_overlap(a, b), F.lit(False))


def _with_facts(matches: DataFrame, facts: DataFrame) -> DataFrame:
    a = facts.select(F.col("entity_id").alias("s1_id"), F.col("nums").alias("a_nums"), F.col("pins").alias("a_pins"))
    b = facts.select(F.col("entity_id").alias("t_id"), F.col("nums").alias("b_nums"), F.col("pins").alias("b_pins"))
    out = matches.join(a, "s1_id", "left").join(b, "t_id", "left")
    none = F.array().cast("array<string>")
    return out.withColumns({c: F.coalesce(c, none) for c in ("a_nums", "b_nums", "a_pins", "b_pins")})


def prune(matches: DataFrame, facts: DataFrame, pins: bool = True) -> DataFrame:
    """Without pairs whose street numbers (P-1) or postal codes (P-2) conflict."""
    out = _with_facts(matches, facts).where(~conflict("a_nums", "b_nums"))
    if pins:
        out = out.where(~conflict("a_pins", "b_pins"))
    return out.select(*matches.columns)


def rerank(matches: DataFrame, facts: DataFrame, consensus: DataFrame, version: int = 2) -> DataFrame:
    """s1_id, t_id, idx, score (P-3: version 1, P-4: version 2). ``consensus``: another run's (s1_id, t_id)."""
    step, number, pin = (5, 30, 20) if version == 2 else (1, 20, 0)
    rows = _with_facts(matches, facts).join(consensus.select("s1_id", "t_id").distinct().withColumn("_both", F.lit(1)), ["s1_id", "t_id"], "left")
    gain = lambda cond, n: F.when(cond, n).otherwise(0)
    score = (
        100
        - step * F.col("idx")
        + gain(F.col("_both").isNotNull(), 50)
        + gain(F.arrays_overlap("a_nums", "b_nums"), number)
        + gain(F.arrays_overlap("a_pins", "b_pins"), pin)
    )
    return rows.select("s1_id", "t_id", "idx", score.cast("int").alias("score"))


def cap(scored: DataFrame, most: int = 2, third_from: int | None = None) -> DataFrame:
    """The first ``most`` of each source (P-5), and one more if it scores ``third_from`` (P-6); ``idx`` is the new place."""
    w = Window.partitionBy("s1_id", "source").orderBy(F.desc("score"), "idx", "t_id")
    rows = scored.withColumn("source", F.substring("t_id", 1, 2)).where(F.col("source").isin("S2", "S3")).withColumn("rank", F.row_number().over(w))
    keep = F.col("rank") <= most
    if third_from is not None:
        keep |= (F.col("rank") == most + 1) & (F.col("score") >= third_from)
    place = F.row_number().over(Window.partitionBy("s1_id").orderBy(F.desc("score"), "idx", "t_id")) - 1
    return rows.where(keep).withColumn("idx", place).select("s1_id", "t_id", "idx", "score")


def unassigned(targets: DataFrame, matches: DataFrame) -> DataFrame:
    """P-8."""
    return targets.join(matches.select(F.col("t_id").alias("entity_id")).distinct(), "entity_id", "left_anti")


#: targets and free places of one address that a task decides at once
TURN = 200_000


def rescue(s1: DataFrame, targets: DataFrame, matches: DataFrame, least: int = 18, most: int = 2, turn: int = TURN) -> DataFrame:
    """s1_id, t_id of targets without a match given to the first s1 of equal address with a free place (P-7).

    Inputs are entities with ``ord``, their place in the file. Targets go in file order; sources
    have places of their own, so each is decided by itself. Where no numbers in an address group
    conflict, places and targets are numbered and joined. Groups with a conflict go in turns: the
    first ``turn`` targets that are open, and those free places that are among the first ``turn``
    without numbers or with any one number, which is all that these targets can reach, are decided
    by one task in linear time; the next turn has the targets after them. So a task's size is
    bounded whatever the group's, and turns follow the order of a single walk.
    """
    keyed = lambda df: df.select(
        "entity_id", F.trim(F.coalesce("country", F.lit(""))).alias("country"), X.address_key(X.fold_marks(F.coalesce("business_address", F.lit("")))).alias("addr_key"), "ord",
        X.number_set(F.col("business_address")).alias("nums"),
    )
    free = keyed(unassigned(targets, matches)).where(F.length("addr_key") >= least).withColumn("source", F.substring("entity_id", 1, 2)).where(F.col("source").isin("S2", "S3"))
    own = keyed(s1)
    index = address_index(own, matches, least, most).join(own.select(F.col("entity_id").alias("s1_id"), "nums"), "s1_id")
    keys = ["country", "addr_key"]
    words = F.when(F.size("nums") > 0, F.concat_ws(" ", F.array_sort("nums")))
    seen = index.select(*keys, words.alias("w")).unionByName(free.select(*keys, words.alias("w")))
    clash = seen.groupBy(*keys).agg(F.coalesce(F.min("w") != F.max("w"), F.lit(False)).alias("clash"))
    clash = written(clash.join(free.select(*keys).distinct(), keys, "left_semi").join(index.select(*keys).distinct(), keys, "left_semi"), "clash")

    room = F.array(*[F.struct(F.lit(s).alias("source"), F.col(n).alias("n")) for s, n in (("S2", "n2"), ("S3", "n3"))])
    places = index.join(clash, keys).select(*keys, "clash", "s1_id", "ord", "nums", F.explode(room).alias("f"))
    places = places.where(F.col("f.n") < most).select(*keys, "clash", "f.source", "s1_id", "ord", "nums", F.explode(F.sequence(F.col("f.n") + 1, F.lit(most).cast("bigint"))).alias("k"))
    open_ = free.join(clash, keys).select(*keys, "clash", "source", F.col("entity_id").alias("t_id"), F.col("ord").alias("t_ord"), "nums")
    number = lambda df, *by: df.where("not clash").withColumn("no", F.row_number().over(Window.partitionBy(*keys, "source").orderBy(*by))).drop("nums", "clash")
    out = [number(places, "ord", "s1_id", "k").join(number(open_, "t_ord", "t_id"), [*keys, "source", "no"]).select("s1_id", "t_id")]

    group = [*keys, "source"]
    places, open_ = (written(x.where("clash").drop("clash"), "turn") for x in (places, open_))
    while not open_.isEmpty() and not places.isEmpty():
        first = lambda df, by, *order: df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_r") <= turn).drop("_r")
        now = written(first(open_, group, "t_ord", "t_id"), "now")
        # a place stands in the list of all places, in that of places without numbers, or in those of its numbers
        lists = F.concat(F.array(F.lit("")), F.when(F.size("nums") == 0, F.array(F.lit("-"))).otherwise(F.transform("nums", lambda n: F.concat(F.lit("="), n))))
        near = first(places.withColumn("_l", F.explode(lists)), [*group, "_l"], "ord", "s1_id", "k").drop("_l").dropDuplicates([*group, "s1_id", "k"])
        near = near.join(now.select(*group).distinct(), group, "left_semi")
        given = near.groupBy(*group).cogroup(now.groupBy(*group)).applyInPandas(_walk, "country string, addr_key string, source string, s1_id string, k bigint, t_id string")
        given = written(given, "given")
        out.append(given.select("s1_id", "t_id"))
        rest = written(open_.join(now.select(*group, "t_id"), [*group, "t_id"], "left_anti"), "turn")
        left = written(places.join(given.select(*group, "s1_id", "k"), [*group, "s1_id", "k"], "left_anti"), "turn")
        drop(open_, places, now)
        open_, places = rest, left
    drop(open_, places)
    every = out[0]
    for x in out[1:]:
        every = every.unionByName(x)
    return every


def _walk(key: tuple, places: pd.DataFrame, targets: pd.DataFrame) -> pd.DataFrame:
    """Targets in order, each to the first free place whose numbers don't conflict with its own.

    A place that a target may take stands first in the list of all places (for a target without
    numbers), or in that of places without numbers or of one of the target's numbers. Lists only
    lose places, so each is read once.
    """
    rows = places.sort_values(["ord", "s1_id", "k"])
    lists: dict[str | None, list[int]] = {"": list(range(len(rows))), None: []}
    for i, nums in enumerate(rows.nums):
        for n in set(nums) if len(nums) else (None,):
            lists.setdefault(n, []).append(i)
    at, taken, out = dict.fromkeys(lists, 0), [False] * len(rows), []
    who = list(zip(rows.s1_id, rows.k, strict=True))

    def head(name: str | None) -> int:
        mine, i = lists[name], at[name]
        while i < len(mine) and taken[mine[i]]:
            i += 1
        at[name] = i
        return mine[i] if i < len(mine) else len(rows)

    for t in targets.sort_values(["t_ord", "t_id"]).itertuples():
        names = [None, *[n for n in t.nums if n in lists and n != ""]] if len(t.nums) else [""]
        place = min(map(head, names))
        if place < len(rows):
            taken[place] = True
            out.append((*key, *who[place], t.t_id))
    return pd.DataFrame(out, columns=["country", "addr_key", "source", "s1_id", "k", "t_id"])
