"""Pairwise feature vectors (F-1 to F-13) as column expressions over joined pairs.

A pair frame has the columns of both records, prefixed ``a_`` (source 1) and ``b_`` (target).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.functions import text as X
from kinweave.functions.similarity import jaro_winkler_udf, ratio_udf, token_set_udf, token_sort_udf
from kinweave.session import small_methods

FEATURES14 = (
    "name_exact name_jaccard name_recall name_char_cosine name_pfx_match name_len_diff name_token_diff addr_exact addr_jaccard addr_char_cosine "
    "addr_num_match is_addr_empty country_match combined_jaccard"
).split()
FEATURES17 = (
    "name_exact name_jaccard name_recall name_char_jaccard name_w1_match name_w2_match name_pfx4_match name_pfx6_match name_contain name_len_diff "
    "name_token_diff addr_exact addr_jaccard addr_char_jaccard addr_num_match is_addr_empty combined_jaccard"
).split()
FEATURES19 = (
    "b_sort b_set b_jaro b_lev a_sort a_set a_jaro is_empty has_nums nums_overlap nums_conflict num_inter geo_match geo_conflict is_indic w1_match w2_match "
    "ns_contain is_s2"
).split()
FEATURES22 = (
    "b_sort b_set b_jaro b_lev b_len_ratio a_sort a_set a_jaro is_empty addr_tok_ratio has_nums nums_overlap nums_conflict num_inter pin_match geo_match "
    "geo_conflict is_indic w1_match w2_match ns_contain is_s2"
).split()


def pairs_of(pairs: DataFrame, s1: DataFrame, targets: DataFrame) -> DataFrame:
    """The pairs (s1_id, t_id, ...) with both records' columns.

    Pairs are never broadcast: written ids compress to some 3 bytes a pair, so that Spark takes a table of millions for a
    small one, and the driver would hold 136 bytes for each (measured: 3,702,351 pairs, 503 MB).
    """
    small_methods(pairs.sparkSession)
    a = s1.select(*[F.col(c).alias(f"a_{c}") for c in s1.columns])
    b = targets.select(*[F.col(c).alias(f"b_{c}") for c in targets.columns])
    return pairs.hint("merge").join(a, pairs["s1_id"] == a["a_entity_id"]).join(b, pairs["t_id"] == b["b_entity_id"])


def _flag(cond: Column) -> Column:
    return F.coalesce(cond, F.lit(False)).cast("double")


def _jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def with_grams(records: DataFrame, *columns: str) -> DataFrame:
    """Records with the padded 3-grams of a text, counted, and ``<column>_len``, the count vector's length.

    A gram is its three code points in one bigint, so that sets of them meet as primitives.
    ``<column>_once`` has those that occur once, ``<column>_more`` (g, n) the others, which are
    few. Made once for each record, in steps: an expression used several times is its own
    projection. Counts are the lengths of runs in the sorted list.
    """
    code = lambda i: F.element_at("_c", i).cast("bigint")
    for c in columns:
        records = records.withColumn("_c", F.when(F.col(c) == "", F.array().cast("array<int>")).otherwise(F.transform(F.split(F.concat(F.lit(" "), F.col(c), F.lit(" ")), ""), F.ascii)))
        size = F.size("_c")
        grams = F.transform(F.sequence(F.lit(1), F.greatest(size - 2, F.lit(1))), lambda i: F.shiftleft(code(i), 42) + F.shiftleft(code(i + 1), 21) + code(i + 2))
        records = records.withColumn("_g", F.when(size < 3, F.array().cast("array<bigint>")).otherwise(F.sort_array(grams)))
        place = F.sequence(F.lit(1), F.greatest(F.size("_g"), F.lit(1)))
        new = F.filter(place, lambda i: (i == 1) | (F.element_at("_g", i) != F.element_at("_g", F.greatest(i - 1, F.lit(1)))))
        records = records.withColumn("_s", F.when(F.size("_g") > 0, new).otherwise(F.array().cast("array<int>")))
        runs = F.transform("_s", lambda s, k: F.struct(F.element_at("_g", s).alias("g"), (F.coalesce(F.get("_s", k + 1), F.size("_g") + 1) - s).alias("n")))
        records = records.withColumn("_r", runs)
        records = records.withColumn(f"{c}_once", F.transform(F.filter("_r", lambda r: r["n"] == 1), lambda r: r["g"])).withColumn(f"{c}_more", F.filter("_r", lambda r: r["n"] > 1))
        records = records.withColumn(f"{c}_len", F.sqrt(F.aggregate("_r", F.lit(0.0), lambda s, r: s + r["n"] * r["n"]))).drop("_c", "_g", "_s", "_r")
    return records


def cosine(column: str) -> Column:
    """Cosine of two records' 3-gram counts, 0 where nothing is shared (F-1)."""
    a1, b1, a2, b2 = (f"{side}_{column}_{kind}" for kind in ("once", "more") for side in "ab")
    hit = lambda other: lambda s, r: s + F.when(F.array_contains(other, r["g"]), r["n"]).otherwise(0)
    both = lambda s, r: s + r["n"] * F.aggregate(b2, F.lit(0), lambda t, q: t + F.when(q["g"] == r["g"], q["n"]).otherwise(0))
    dot = F.size(F.array_intersect(a1, b1)) + F.aggregate(a2, F.lit(0), hit(b1)) + F.aggregate(b2, F.lit(0), hit(a1)) + F.aggregate(a2, F.lit(0), both)
    length = F.col(f"a_{column}_len") * F.col(f"b_{column}_len")
    return F.when(length > 0, dot / length).otherwise(0.0)


def features14(pairs: DataFrame, cosines: bool = True) -> DataFrame:
    """s1_id, t_id and the 14 features (F-2, F-13). With ``cosines`` the records have gone through ``with_grams`` for both texts."""
    an, bn, aa, ba = F.col("a_norm_name"), F.col("b_norm_name"), F.col("a_norm_address"), F.col("b_norm_address")
    at, bt = F.col("a_name_tokens"), F.col("b_name_tokens")
    empty = (ba == "") | F.col("b_is_address_empty")
    name_jaccard = _jaccard(at, bt)
    addr_jaccard = F.when(empty, 0.0).otherwise(_jaccard(F.col("a_address_tokens"), F.col("b_address_tokens")))
    distinct = F.size(F.array_distinct(at))
    f = {
        "name_exact": _flag((an != "") & (an == bn)),
        "name_jaccard": name_jaccard,
        "name_recall": F.when(distinct > 0, F.size(F.array_intersect(at, bt)) / distinct).otherwise(0.0),
        "name_char_cosine": cosine("norm_name") if cosines else F.lit(None).cast("double"),
        "name_pfx_match": _flag((F.length(an) >= 4) & (F.substring(an, 1, 4) == F.substring(bn, 1, 4))),
        "name_len_diff": F.abs(F.length(an) - F.length(bn)).cast("double"),
        "name_token_diff": F.abs(F.size(at) - F.size(bt)).cast("double"),
        "addr_exact": _flag(~empty & (aa != "") & (aa == ba)),
        "addr_jaccard": addr_jaccard,
        "addr_char_cosine": F.when(empty, 0.0).otherwise(cosine("norm_address")) if cosines else F.lit(None).cast("double"),
        "addr_num_match": _flag(F.arrays_overlap("a_address_numbers", "b_address_numbers")),
        "is_addr_empty": _flag(empty),
        "country_match": _flag(F.col("a_country") == F.col("b_country")),
        "combined_jaccard": 0.6 * name_jaccard + 0.4 * F.when(empty, name_jaccard).otherwise(addr_jaccard),
    }
    return pairs.select("s1_id", "t_id", *[f[n].alias(n) for n in FEATURES14])


def features17(pairs: DataFrame) -> DataFrame:
    """s1_id, t_id and the 17 hard-negative features (F-3)."""
    an, bn, aa, ba = F.col("a_norm_name"), F.col("b_norm_name"), F.col("a_norm_address"), F.col("b_norm_address")
    at, bt = F.col("a_name_tokens"), F.col("b_name_tokens")
    empty = (ba == "") | F.col("b_is_address_empty")
    name_jaccard = _jaccard(at, bt)
    addr_jaccard = F.when(empty, 0.0).otherwise(_jaccard(F.col("a_address_tokens"), F.col("b_address_tokens")))
    distinct = F.size(F.array_distinct(at))
    gram = lambda c: X.ngrams(c, pad=False)
    prefix = lambda n: _flag((F.length(an) >= n) & (F.length(bn) >= n) & (F.substring(an, 1, n) == F.substring(bn, 1, n)))
    word = lambda i: _flag(F.get(at, F.lit(i)) == F.get(bt, F.lit(i)))
    f = {
        "name_exact": _flag((an != "") & (an == bn)),
        "name_jaccard": name_jaccard,
        "name_recall": F.when(distinct > 0, F.size(F.array_intersect(at, bt)) / distinct).otherwise(0.0),
        "name_char_jaccard": _jaccard(gram(an), gram(bn)),
        "name_w1_match": word(0),
        "name_w2_match": word(1),
        "name_pfx4_match": prefix(4),
        "name_pfx6_match": prefix(6),
        "name_contain": _flag((an != "") & (bn != "") & (an.contains(bn) | bn.contains(an))),
        "name_len_diff": F.abs(F.length(an) - F.length(bn)).cast("double"),
        "name_token_diff": F.abs(F.size(at) - F.size(bt)).cast("double"),
        "addr_exact": _flag(~empty & (aa != "") & (aa == ba)),
        "addr_jaccard": addr_jaccard,
        "addr_char_jaccard": F.when(empty, 0.0).otherwise(_jaccard(gram(aa), gram(ba))),
        "addr_num_match": _flag(F.arrays_overlap("a_address_numbers", "b_address_numbers")),
        "is_addr_empty": _flag(empty),
        "combined_jaccard": 0.6 * name_jaccard + 0.4 * F.when(empty, name_jaccard).otherwise(addr_jaccard),
    }
    return pairs.select("s1_id", "t_id", *[f[n].alias(n) for n in FEATURES17])


def number_features(pairs: DataFrame) -> dict[str, Column]:
    """F-12: has_nums, num_inter, nums_overlap, nums_conflict."""
    has = (F.size("a_nums") > 0) & (F.size("b_nums") > 0)
    inter = F.size(F.array_intersect("a_nums", "b_nums"))
    return {"has_nums": _flag(has), "nums_overlap": _flag(inter > 0), "nums_conflict": _flag(has & (inter == 0)), "num_inter": inter.cast("double")}


def with_ratios(pairs: DataFrame, sets: bool = True) -> DataFrame:
    """The pairs with the string similarities of brands and addresses; 0 where the target has no address (F-6 to F-9)."""
    out = pairs.withColumn("b_sort", token_sort_udf("a_core_brand", "b_core_brand")).withColumn("b_jaro", jaro_winkler_udf("a_core_brand", "b_core_brand"))
    out = out.withColumn("_addr", F.when(F.col("b_is_addr_empty"), "").otherwise(F.col("b_norm_addr")))
    out = out.withColumn("a_sort", token_sort_udf("a_norm_addr", "_addr"))
    if sets:
        out = out.withColumn("b_set", token_set_udf("a_core_brand", "b_core_brand")).withColumn("b_lev", ratio_udf("a_core_brand", "b_core_brand"))
        out = out.withColumn("a_set", token_set_udf("a_norm_addr", "_addr")).withColumn("a_jaro", jaro_winkler_udf("a_norm_addr", "_addr"))
    gone = [c for c in ("a_sort", "a_set", "a_jaro") if c in out.columns]
    return out.withColumns({c: F.when(F.col("b_is_addr_empty"), 0.0).otherwise(F.col(c)) for c in gone}).drop("_addr")


def no_space_contained() -> Column:
    a, b = F.col("a_no_space"), F.col("b_no_space")
    return (a != "") & (b != "") & (a.contains(b) | b.contains(a))


def features19(pairs: DataFrame, more: bool = False) -> DataFrame:
    """s1_id, t_id and the 19 features (F-4), or 22 (F-5). ``pairs`` comes from ``with_ratios``."""
    words = lambda c: F.slice(X.tokens(F.col(c)), 1, 2)
    w, v = words("a_core_brand"), words("b_core_brand")
    both = (F.col("a_geo") != "") & (F.col("b_geo") != "")
    f = {
        **{c: F.col(c) for c in ("b_sort", "b_set", "b_jaro", "b_lev", "a_sort", "a_set", "a_jaro")},
        "is_empty": _flag(F.col("b_is_addr_empty")),
        **number_features(pairs),
        "geo_match": _flag(both & (F.col("a_geo") == F.col("b_geo"))),
        "geo_conflict": _flag(both & (F.col("a_geo") != F.col("b_geo"))),
        "is_indic": _flag(F.col("b_is_indic") & ~F.col("a_is_indic")),
        "w1_match": _flag(F.get(w, F.lit(0)) == F.get(v, F.lit(0))),
        "w2_match": _flag((F.size(w) >= 2) & (F.size(v) >= 2) & (w == v)),
        "ns_contain": _flag(no_space_contained()),
        "is_s2": _flag(F.col("t_id").startswith("S2-")),
    }
    if more:
        x, y = F.length("a_core_brand"), F.length("b_core_brand")
        f["b_len_ratio"] = F.least(x, y) / F.greatest(x, y, F.lit(1))
        own = F.array_distinct("a_addr_tokens")
        f["addr_tok_ratio"] = F.size(F.array_intersect(own, F.col("b_addr_tokens"))) / F.greatest(F.size(own), F.lit(1))
        f["pin_match"] = _flag(F.arrays_overlap("a_pins", "b_pins"))
    return pairs.select("s1_id", "t_id", *[f[n].alias(n) for n in (FEATURES22 if more else FEATURES19)])
