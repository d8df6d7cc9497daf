"""Enriched records: the modular one (N-6) and the rich one of the rule and GBDT profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.functions import text as X


def normalize_records(entities: DataFrame) -> DataFrame:
    """N-6: the four inputs, normalised texts, three token lists, the empty-address flag."""
    raw = F.coalesce("business_address", F.lit(""))
    out = entities.select(
        "entity_id",
        F.coalesce("business_name", F.lit("")).alias("business_name"),
        raw.alias("business_address"),
        F.trim(F.coalesce("country", F.lit(""))).alias("country"),
    )
    # both foldings are one Arrow stage; everything else stays in generated code
    out = out.withColumn("_n", X.fold("business_name")).withColumn("_a", X.fold("business_address"))
    out = out.withColumn("norm_name", X.business_name(F.col("_n"))).withColumn("norm_address", X.address(F.col("_a"))).drop("_n", "_a")
    return out.withColumns(
        {
            "name_tokens": X.tokens(F.col("norm_name")),
            "address_tokens": X.tokens(F.col("norm_address")),
            "address_numbers": X.numbers(F.col("business_address")),
            "is_address_empty": X.empty_address(F.col("norm_address"), F.col("business_address"), "raw"),
        }
    )


def rich_records(entities: DataFrame, profile: str = "champion") -> DataFrame:
    """entity_id, country, norm_name, norm_addr, core_brand, nums, raw_nums, geo, addr_tokens, stems, no_space and flags, by profile."""
    name, addr = F.coalesce("business_name", F.lit("")), F.coalesce("business_address", F.lit(""))
    out = entities.select("entity_id", F.trim(F.coalesce("country", F.lit(""))).alias("country"), name.alias("raw_name"), addr.alias("raw_addr"))
    country = F.col("country")
    if profile == "turbo":
        out = out.withColumn("norm_name", X.columnar(F.col("raw_name"), country, False)).withColumn("norm_addr", X.columnar(F.col("raw_addr"), country, True))
    else:
        kind = {"production": "states", "champion": "plain", "v5": "plain", "train": "train"}.get(profile, "base")
        out = out.withColumn("_n", X.fold("raw_name")).withColumn("_a", X.fold("raw_addr"))
        out = out.withColumn("norm_name", X.cleaner(F.col("_n"), country, kind)).withColumn("norm_addr", X.cleaner(F.col("_a"), country, kind)).drop("_n", "_a")
    new = profile in ("champion", "v5", "train")
    words = X.LEGAL_WORDS if new else X.TRADE_WORDS if profile in ("production", "turbo") else None
    out = out.withColumn("core_brand", X.core_brand(F.col("norm_name"), words, fallback=profile != "train"))
    raw, addr = F.col("raw_addr"), F.col("norm_addr")
    nums = {"champion": X.number_set(raw), "train": X.number_set(raw), "v5": X.number_set(raw, 8, None), "production": X.small_integers(raw), "turbo": F.array_distinct(X.plain_integers(addr))}
    return out.withColumns(
        {
            "nums": nums.get(profile, F.array_distinct(X.plain_integers(raw))),
            "raw_nums": X.raw_numbers(raw),
            "pins": X.postal_codes(raw),
            "geo": X.geo_code(addr, raw, country, france=profile != "train") if new else X.us_state(addr, last=False),
            "addr_tokens": X.address_tokens(addr, *((4, X.STOP_ADDRESS_LONG) if new else (3, X.STOP_ADDRESS))),
            "stems": X.stems(F.col("core_brand")),
            "no_space": X.no_space(F.col("core_brand") if new else F.col("norm_name")),
            "is_addr_empty": X.empty_address(addr, raw, "words" if new else "normal"),
            "is_indic": X.is_indic(F.col("raw_name")),
            "is_generic": X.is_generic(F.col("core_brand")),
        }
    )
