"""Audits of sources, truth and results (E-5 to E-9). Profiles are one aggregation for each table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def source_profiles(entities: DataFrame, source: Column) -> DataFrame:
    """A row for each source: rows, duplicate ids, bad prefixes, empties, lengths and word counts (E-5).

    One aggregate over all sources; ``source`` says which one a row is of. The median of lengths is
    exact and needs no sort: what is merged is a count of each length, and lengths are few.
    """
    name, addr = F.coalesce("business_name", F.lit("")), F.coalesce("business_address", F.lit(""))
    words = lambda c: F.size(F.filter(F.split(F.trim(c), r"\s+"), lambda t: t != ""))
    blank = lambda c: F.count_if(F.trim(c) == "")
    return entities.withColumn("source", source).groupBy("source").agg(
        F.count(F.lit(1)).alias("n_rows"),
        (F.count("entity_id") - F.countDistinct("entity_id")).alias("duplicate_ids"),
        F.count_if(~F.col("entity_id").startswith(F.concat("source", F.lit("-")))).alias("bad_prefix"),
        blank(name).alias("empty_names"),
        blank(addr).alias("empty_addresses"),
        blank(F.coalesce("country", F.lit(""))).alias("empty_countries"),
        F.countDistinct("country").alias("countries"),
        F.avg(F.length(name)).alias("avg_name_length"),
        F.percentile(F.length(name), 0.5).alias("median_name_length"),
        F.min(F.length(name)).alias("min_name_length"),
        F.max(F.length(name)).alias("max_name_length"),
        F.avg(words(name)).alias("avg_name_words"),
        F.avg(F.length(addr)).alias("avg_address_length"),
        F.avg(words(addr)).alias("avg_address_words"),
    )


def source_profile(entities: DataFrame, source: str) -> DataFrame:
    """The row of one source; none for an empty table."""
    return source_profiles(entities, F.lit(source))


def name_quantiles(entities: DataFrame, source: Column, shares: Sequence[float] = (0.5, 0.9, 0.99), accuracy: int = 1000) -> DataFrame:
    """source, quantiles: of the name lengths of each source, by a mergeable summary whose rank error is at most 1 / ``accuracy`` of the rows."""
    length = F.length(F.coalesce("business_name", F.lit("")))
    return entities.withColumn("source", source).groupBy("source").agg(F.percentile_approx(length, list(shares), accuracy).alias("quantiles"))


def country_counts(entities: DataFrame) -> DataFrame:
    return entities.groupBy("country").agg(F.count(F.lit(1)).alias("n"))


def truth_profile(truth: DataFrame, s1: DataFrame) -> DataFrame:
    """One row about the numbers of matches (E-6). ``truth`` is long."""
    per = s1.select(F.col("entity_id").alias("s1_id")).join(
        truth.groupBy("s1_id").agg(
            F.count(F.lit(1)).alias("n"), F.count_if(F.col("t_id").startswith("S2-")).alias("n2"), F.count_if(F.col("t_id").startswith("S3-")).alias("n3")
        ),
        "s1_id",
        "left",
    )
    per = per.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n", "n2", "n3")})
    a = per.agg(
        F.count(F.lit(1)).alias("entities"),
        F.count_if(F.col("n") == 0).alias("singletons"),
        F.count_if(F.col("n") == 1).alias("singles"),
        F.count_if(F.col("n") > 1).alias("multis"),
        F.count_if((F.col("n2") > 0) & (F.col("n3") == 0)).alias("s2_only"),
        F.count_if((F.col("n3") > 0) & (F.col("n2") == 0)).alias("s3_only"),
        F.count_if((F.col("n2") > 0) & (F.col("n3") > 0)).alias("both"),
        F.sum("n").alias("pairs"),
        F.max("n").alias("most"),
    )
    b = truth.agg(F.countDistinct("t_id").alias("distinct_targets"))
    return a.crossJoin(b)  # one row each


def match_histogram(truth: DataFrame, s1: DataFrame) -> DataFrame:
    per = s1.select(F.col("entity_id").alias("s1_id")).join(truth.groupBy("s1_id").agg(F.count(F.lit(1)).alias("n")), "s1_id", "left")
    return per.groupBy(F.coalesce("n", F.lit(0)).alias("matches")).agg(F.count(F.lit(1)).alias("entities"))


def match_noise(truth: DataFrame, s1: DataFrame, targets: DataFrame) -> DataFrame:
    """One row: how true pairs differ (E-7)."""
    a = s1.select(F.col("entity_id").alias("s1_id"), *[F.col(c).alias(f"a_{c}") for c in ("business_name", "business_address", "country")])
    b = targets.select(F.col("entity_id").alias("t_id"), *[F.col(c).alias(f"b_{c}") for c in ("business_name", "business_address", "country")])
    p = truth.join(a, "s1_id").join(b, "t_id")
    pct = lambda cond: (100 * F.avg(cond.cast("double")))
    return p.agg(
        F.count(F.lit(1)).alias("pairs"),
        F.count_if(F.col("a_country") != F.col("b_country")).alias("cross_country"),
        pct(F.col("a_business_name") == F.col("b_business_name")).alias("exact_name_pct"),
        pct(F.lower("a_business_name") == F.lower("b_business_name")).alias("same_name_pct"),
        pct(F.col("a_business_address") == F.col("b_business_address")).alias("exact_address_pct"),
    )


def noise_examples(truth: DataFrame, s1: DataFrame, targets: DataFrame, n: int = 50) -> DataFrame:
    """The first n true pairs with both texts and three flags (E-8)."""
    a = s1.select(F.col("entity_id").alias("s1_id"), "country", F.col("business_name").alias("s1_name"), F.col("business_address").alias("s1_address"))
    b = targets.select(F.col("entity_id").alias("target_id"), F.col("business_name").alias("target_name"), F.col("business_address").alias("target_address"))
    p = truth.select("s1_id", F.col("t_id").alias("target_id")).join(a, "s1_id").join(b, "target_id")
    return (
        p.select(
            "s1_id", "target_id", "country", "s1_name", "target_name", "s1_address", "target_address",
            (F.col("s1_name") == F.col("target_name")).alias("exact_name"),
            (F.lower("s1_name") == F.lower("target_name")).alias("same_name"),
            (F.col("s1_address") == F.col("target_address")).alias("exact_address"),
        )
        .orderBy("s1_id", "target_id")
        .limit(n)
    )


def validate(results: DataFrame, s1: DataFrame, candidates: DataFrame | None = None, targets: DataFrame | None = None) -> DataFrame:
    """rule, severity, n, examples (five at most) of a result table (E-9).

    ``results``: source1_entity_id, matched_entity_ids (comma list); ``candidates`` likewise with candidate_entity_ids.
    """
    from pyspark.sql import Window

    ids = lambda c: F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    flagged = lambda df, key: df.select(F.col("entity_id").alias(key)).distinct().withColumn("known", F.lit(True))
    said = lambda rule, cond, who: F.when(cond, F.struct(F.lit(rule).alias("rule"), who.alias("offender")))
    rows = results.select(F.col("source1_entity_id").alias("s1_id"), ids("matched_entity_ids").alias("ids"))

    # by entity: how often it has a row, how many of its lists repeat an id, whether source 1 has it
    twice = F.count_if(F.size("ids") != F.size(F.array_distinct("ids")))
    per = rows.groupBy("s1_id").agg(F.count(F.lit(1)).alias("n"), twice.alias("twice")).join(flagged(s1, "s1_id"), "s1_id", "full")
    who = F.col("s1_id")
    entity = F.array_compact(
        F.concat(
            F.array(said("duplicate_row", F.col("n") > 1, who), said("missing_s1", F.col("n").isNull(), who)),
            F.array_repeat(said("duplicate_id_in_list", F.col("twice") > 0, who), F.coalesce(F.col("twice").cast("int"), F.lit(0))),
            F.array_repeat(said("foreign_s1", F.col("known").isNull(), who), F.coalesce(F.col("n").cast("int"), F.lit(0))),
        )
    )
    # by listed id: its prefix, whether there is such a target, whether it is a candidate
    each = rows.select("s1_id", F.explode("ids").alias("t_id"))
    target, prefix = F.col("t_id"), F.substring("t_id", 1, 3)
    more = [said("self_match", prefix == "S1-", target), said("bad_prefix", ~prefix.isin("S1-", "S2-", "S3-"), target)]
    if targets is not None:
        each = each.join(flagged(targets, "t_id"), "t_id", "left")
        more.append(said("unknown_id", prefix.isin("S2-", "S3-") & F.col("known").isNull(), target))
    if candidates is not None:
        pairs = candidates.select(F.col("source1_entity_id").alias("s1_id"), F.explode(ids("candidate_entity_ids")).alias("t_id")).distinct()
        each = each.join(pairs.withColumn("asked", F.lit(True)), ["s1_id", "t_id"], "left")
        more.append(said("match_not_candidate", F.col("asked").isNull(), F.concat_ws("/", "s1_id", "t_id")))
    found = per.select(F.explode(entity).alias("x")).unionByName(each.select(F.explode(F.array_compact(F.array(*more))).alias("x")))
    found = found.groupBy("x.rule", "x.offender").agg(F.count(F.lit(1)).alias("n"))
    counts = found.groupBy("rule").agg(F.sum("n").alias("n"))
    few = found.withColumn("r", F.row_number().over(Window.partitionBy("rule").orderBy("offender"))).where("r <= 5")
    few = few.groupBy("rule").agg(F.concat_ws(",", F.array_sort(F.collect_list("offender"))).alias("examples"))
    severity = F.when(F.col("rule") == "match_not_candidate", "warning").otherwise("error").alias("severity")
    return counts.join(few, "rule").select("rule", severity, "n", "examples")


def validate_files(spark, matching: str, s1: DataFrame, candidate: str | None = None, targets: DataFrame | None = None) -> DataFrame:
    """The checks of files: existence, emptiness, header, separators; then those of ``validate``. Adds what can't be checked as warnings."""
    from kinweave.sources.readers import raw_lines

    def said(rule: str, severity: str, n: int = 1, examples: str = "") -> DataFrame:
        return spark.createDataFrame([(rule, severity, n, examples)], "rule string, severity string, n bigint, examples string")

    def load(path: str, second: str) -> tuple[DataFrame | None, list[DataFrame]]:
        lines = raw_lines(spark, path)
        if lines is None:
            return None, [said("missing_file", "error", 1, path)]
        head = lines.limit(1).collect()
        if not head:
            return None, [said("empty_file", "error", 1, path)]
        header = head[0]["value"].rstrip("\r\n")
        if header.lower() != f"source1_entity_id\t{second}":
            return None, [said("comma_header" if "," in header and "\t" not in header else "wrong_header", "error", 1, header)]
        body = lines.where(F.lower(F.rtrim("value")) != header.lower())
        bad = body.where(~F.col("value").contains("\t")).count()
        parts = F.split("value", "\t", 2)
        table = body.where(F.col("value").contains("\t")).select(F.trim(parts[0]).alias("source1_entity_id"), F.trim(parts[1]).alias(second))
        return table, [said("row_without_tab", "error", bad)] if bad else []

    results, notes = load(matching, "matched_entity_ids")
    cands = None
    if candidate is None or raw_lines(spark, candidate) is None:
        notes.append(said("no_candidate_file", "warning"))
    else:
        cands, more = load(candidate, "candidate_entity_ids")
        notes += more
    if targets is None:
        notes.append(said("id_check_off", "warning"))
    out = validate(results, s1, cands, targets) if results is not None else None
    for x in notes:
        out = x if out is None else out.unionByName(x)
    return out
