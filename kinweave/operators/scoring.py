"""Rule scorers: one operator whose tiers are data (R-2 to R-10).

``Tiers`` holds a profile's gates and its tiers in order; a pair's score is that of the
first tier that fits, or 0. Ratios are computed before (``features.with_ratios``), in two
stages where a profile prunes: pandas UDFs are not short-circuited by ``when``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.functions import text as X
from kinweave.functions.similarity import jaro_winkler_udf, letter_marks_udf, token_set_udf, token_sort_udf
from kinweave.operators.features import no_space_contained


@dataclass(frozen=True)
class Tier:
    """Fits where brand >= b and address >= a; scores base + (wb * brand + wa * address) / 1000.

    ``overlap``: the number sets must meet. ``agree``: they must meet if both have numbers.
    """

    b: float
    a: float
    base: float
    wb: float
    wa: float
    overlap: bool = False
    agree: bool = False
    auto: bool = False


@dataclass(frozen=True)
class Tiers:
    tiers: tuple[Tier, ...]
    empty_gate: float = 85.0  # brand ratio and Jaro-Winkler (in percent) for targets without address
    conflict_gate: float = 95.0  # brand ratio that outweighs disjoint numbers
    prune: float = 0.0  # brand ratio below which, without common numbers, the score is 0
    indic: tuple[float, float] | None = None  # address ratios for targets in another script: with common numbers, alone
    wide_address: bool = False  # the better of token sort and token set
    generic_veto: bool = False
    two_words: bool = False
    contained: float = 92.0  # floor of the brand ratio where the joined names contain each other
    notes: str = field(default="", compare=False)


_HIGH = Tier(70, 50, 0.90, 0.5, 0.5)
_MODERATE = Tier(55, 68, 0.88, 0.4, 0.6)
_MODERATE_52 = Tier(52, 68, 0.88, 0.4, 0.6)
_BRAND_88 = Tier(88, 0, 0.85, 1, 0)
_BRAND_90_40 = Tier(90, 40, 0.86, 1, 0)
_SAME_PLACE = Tier(0, 80, 0.88, 0, 1, overlap=True)

# fixed values: the profiles' gates and tiers
PROFILES: dict[str, Tiers] = {
    "v2": Tiers((Tier(0, 80, 0.88, 0, 1, agree=True, auto=True), _HIGH, _MODERATE, _BRAND_88)),
    "v3": Tiers((Tier(0, 78, 0.88, 0, 1, agree=True, auto=True), _HIGH, _MODERATE, _BRAND_88)),
    "v4": Tiers((_HIGH, _MODERATE, _SAME_PLACE, _BRAND_88)),
    "production": Tiers((_HIGH, _MODERATE, _SAME_PLACE, _BRAND_88), prune=50),
    "turbo": Tiers((_HIGH, _MODERATE, _SAME_PLACE, _BRAND_88), prune=55),
    "v5": Tiers((_HIGH, _MODERATE_52, Tier(30, 80, 0.88, 0, 1, overlap=True), _BRAND_90_40), empty_gate=88, indic=(78, 88)),
    "fixed": Tiers(
        (_HIGH, _MODERATE, Tier(30, 88, 0.88, 0, 1, overlap=True), Tier(0, 92, 0.88, 0, 1, overlap=True), Tier(90, 0, 0.85, 1, 0)),
        conflict_gate=98,
        prune=40,
    ),
    "optimal": Tiers((_HIGH, _MODERATE_52, Tier(30, 82, 0.88, 0, 1, overlap=True), _BRAND_90_40), indic=(78, 88)),
    "refined": Tiers(
        (Tier(68, 50, 0.90, 0.5, 0.5), Tier(50, 68, 0.88, 0.4, 0.6), Tier(0, 85, 0.88, 0, 1, overlap=True), _BRAND_90_40),
        indic=(75, 88),
        wide_address=True,
        generic_veto=True,
        two_words=True,
    ),
}


def tier_score(t: Tiers, b: Column, jaro: Column, a: Column, overlap: Column, has: Column, empty: Column, region_conflict: Column, indic: Column, veto: Column | None = None) -> tuple[Column, Column]:
    """(score, is_auto) from ratios in percent and flags. Pure expressions, so they can be checked against SQL."""
    zero = F.lit(0.0)
    score = F.when(region_conflict, zero)
    auto = F.when(region_conflict, F.lit(False))
    if veto is not None:
        score, auto = score.when(veto, zero), auto.when(veto, F.lit(False))
    gate = (b >= t.empty_gate) & (jaro >= t.empty_gate / 100)
    score = score.when(empty, F.when(gate, 0.92 + b / 1000).otherwise(zero)).when(has & ~overlap & (b < t.conflict_gate), zero)
    auto = auto.when(empty | (has & ~overlap & (b < t.conflict_gate)), F.lit(False))
    if t.prune:
        score = score.when((b < t.prune) & ~(has & overlap), zero)
        auto = auto.when((b < t.prune) & ~(has & overlap), F.lit(False))
    if t.indic:
        with_numbers, alone = t.indic
        score = score.when(indic, F.when(overlap & (a >= with_numbers), 0.91 + a / 1000).when(a >= alone, 0.90 + a / 1000).otherwise(zero))
        auto = auto.when(indic, F.lit(False))
    for x in t.tiers:
        fits = (b >= x.b) & (a >= x.a)
        if x.overlap:
            fits &= has & overlap
        if x.agree:
            fits &= ~has | overlap
        score = score.when(fits, x.base + (x.wb * b + x.wa * a) / 1000)
        auto = auto.when(fits, F.lit(x.auto))
    return score.otherwise(zero), auto.otherwise(F.lit(False))


#: words of marks of a record's brand, address and joined name
MARKS = {"brand": 2, "addr": 4, "ns": 1}
#: what ``may_score`` reads of a record
LIGHT = ("geo", "is_addr_empty", "is_indic", "nums", "nums_mark", "two_mark", *(f"{c}_{i}" for c, n in MARKS.items() for i in range(n + 1)))


def with_marks(records: DataFrame) -> DataFrame:
    """Rich records with marks of their letters (``<column>_0`` is a length), numbers and first two words, made once for each record."""
    of = {"brand": "core_brand", "addr": "norm_addr", "ns": "no_space"}
    out = records.withColumns({f"_{c}": letter_marks_udf(n)(of[c]) for c, n in MARKS.items()})
    out = out.withColumns({f"{c}_{i}": F.get(f"_{c}", F.lit(i)) for c, n in MARKS.items() for i in range(n + 1)}).drop(*[f"_{c}" for c in MARKS])
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.xxhash64(x), F.lit(64)).cast("int"))
    two = F.slice(X.tokens(F.col("core_brand")), 1, 2)
    return out.withColumn("nums_mark", F.aggregate("nums", F.lit(0).cast("bigint"), lambda s, x: s.bitwiseOR(bit(x)))).withColumn(
        "two_mark", F.when(F.size(two) >= 2, F.xxhash64(two)).otherwise(0)
    )


def may_score(profile: str) -> Column:
    """False only where the pair's score is 0, from the columns ``LIGHT`` of both records (``a_`` and ``b_``) and without any string being aligned.

    Ratios are bounded by the letters that one side lacks and by the lengths. All conditions of the tiers are lower
    limits, so a bound that misses one decides. What it lets through is compared exactly.
    """
    t = PROFILES[profile]

    def reaches(column: str, least: float) -> Column:
        if least <= 0:
            return F.lit(True)
        a, b = ([F.col(f"{side}_{column}_{i}") for i in range(MARKS[column] + 1)] for side in "ab")
        lacks = [F.bit_count(x.bitwiseXOR(y)) for x, y in zip(a[1:], b[1:], strict=True)]
        room = F.lit(100 - int(least)) * (a[0] + b[0])
        return (100 * F.abs(a[0] - b[0]) <= room) & (100 * sum(lacks[1:], lacks[0]) <= room)

    inside = F.col("a_ns_1").bitwiseAND(F.col("b_ns_1")).isin(F.col("a_ns_1"), F.col("b_ns_1"))  # one joined name may contain the other
    two = (F.col("a_two_mark") != 0) & (F.col("a_two_mark") == F.col("b_two_mark"))

    def brand(least: float) -> Column:
        out = reaches("brand", least)
        if 0 < least <= t.contained:
            out |= inside
        return out | two if t.two_words and 0 < least <= 88 else out

    def address(least: float) -> Column:
        return F.lit(True) if t.wide_address else reaches("addr", least)

    meet = F.col("a_nums_mark").bitwiseAND(F.col("b_nums_mark")) != 0
    has = (F.col("a_nums_mark") != 0) & (F.col("b_nums_mark") != 0)
    overlap = meet & F.arrays_overlap("a_nums", "b_nums")
    fits = F.lit(False)
    for x in t.tiers:
        fits |= (meet if x.overlap else (meet | ~has) if x.agree else F.lit(True)) & brand(x.b) & address(x.a)
    if t.indic:
        fits = F.when(F.col("b_is_indic") & ~F.col("a_is_indic"), address(min(t.indic))).otherwise(fits)
    if t.prune:
        fits = (meet | brand(t.prune)) & fits
    other = (F.col("a_geo") != "") & (F.col("b_geo") != "") & (F.col("a_geo") != F.col("b_geo"))
    return ~other & F.when(F.col("b_is_addr_empty"), brand(t.empty_gate)).otherwise((~has | brand(t.conflict_gate) | overlap) & fits)


def rule_scores(pairs: DataFrame, profile: str) -> DataFrame:
    """s1_id, t_id, score, is_auto of the pairs (both records' columns, see ``features.pairs_of``).

    Of records with marks (``with_marks``) the pairs that can't score are left out before any UDF.

    First the brand ratio is made (once for the pairs of a batch that repeat) and everything
    decided by cheap columns is dropped; addresses are compared for the rest only.
    """
    t = PROFILES[profile]
    both = (F.col("a_geo") != "") & (F.col("b_geo") != "")
    has = (F.size("a_nums") > 0) & (F.size("b_nums") > 0)
    overlap = F.coalesce(F.arrays_overlap("a_nums", "b_nums"), F.lit(False))
    p = pairs.where((F.col("a_country") == F.col("b_country")) & ~(both & (F.col("a_geo") != F.col("b_geo"))))
    if "a_nums_mark" in pairs.columns:
        p = p.where(may_score(profile))
    p = p.withColumn("_has", has).withColumn("_overlap", overlap)
    b = F.col("_b")
    jaro = (F.when(F.col("b_is_addr_empty"), F.col(f"{side}_core_brand")) for side in "ab")  # only targets without address ask for it
    p = p.withColumn("_sort", token_sort_udf("a_core_brand", "b_core_brand")).withColumn("_jw", jaro_winkler_udf(*jaro))
    floor = F.when(no_space_contained(), F.greatest("_sort", F.lit(t.contained))).otherwise(F.col("_sort"))
    if t.two_words:
        w, v = F.slice(X.tokens(F.col("a_core_brand")), 1, 2), F.slice(X.tokens(F.col("b_core_brand")), 1, 2)
        floor = F.when((F.size(w) >= 2) & (w == v), F.greatest(floor, F.lit(88.0))).otherwise(floor)
    p = p.withColumn("_b", floor)
    conflict = F.col("_has") & ~F.col("_overlap") & (b < t.conflict_gate)
    keep = F.col("b_is_addr_empty") | ~(conflict | ((b < t.prune) & ~(F.col("_has") & F.col("_overlap"))))
    p = p.where(keep).withColumn("_a", token_sort_udf("a_norm_addr", "b_norm_addr"))
    if t.wide_address:
        p = p.withColumn("_a", F.greatest("_a", token_set_udf("a_norm_addr", "b_norm_addr")))
    veto = (F.col("a_is_generic") | F.col("b_is_generic")) & ((F.col("a_core_brand") != F.col("b_core_brand")) | ~F.col("_overlap")) if t.generic_veto else None
    score, auto = tier_score(
        t, b, F.col("_jw"), F.col("_a"), F.col("_overlap"), F.col("_has"), F.col("b_is_addr_empty"), F.lit(False), F.col("b_is_indic") & ~F.col("a_is_indic"), veto
    )
    return p.select("s1_id", "t_id", score.alias("score"), auto.alias("is_auto")).where("score > 0")
