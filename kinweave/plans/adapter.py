"""The driver's ``documents`` as linkage tables: the same derivation is in ``plans.sql``.

Sources 1 to 3 by id modulo 3; four words are the name, six more with a number and the
source the address; the language gives the country. A target's true match is the first
source-1 row with its text and language, so every target has one match at most.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Tables(NamedTuple):
    s1: DataFrame
    targets: DataFrame
    truth: DataFrame


def entities(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    # the ten words that make an entity, without going over the rest of a long text
    blank = r" \t\n\r\f\x0B"
    head = F.regexp_extract(F.coalesce("text", F.lit("")), rf"^[{blank}]*+([^{blank}]++(?:[{blank}]++[^{blank}]++){{0,9}}+)", 1)
    words = F.split(head, rf"[{blank}]+")
    take = lambda a, n: F.array_join(F.slice("w", a, n), " ")
    address = F.concat(F.coalesce(F.col("n_chars").cast("string"), F.lit("")), F.lit(" "), take(5, 6), F.lit(", "), F.coalesce("source", F.lit("")))
    country = F.when(F.col("lang") == "en", "US").when(F.col("lang") == "fr", "France").when(F.col("lang") == "es", "India").otherwise(F.coalesce(F.upper("lang"), F.lit("")))
    return docs.withColumn("w", words).select(
        F.concat(F.lit("S"), (F.col("doc_id") % 3 + 1).cast("string"), F.lit("-"), F.col("doc_id").cast("string")).alias("entity_id"),
        take(1, 4).alias("business_name"),
        F.when(F.col("doc_id") % 31 == 1, "").otherwise(address).alias("business_address"),
        country.alias("country"),
        F.col("doc_id").alias("ord"),
        *more,
    )


def tables(spark: SparkSession, sf_dir: str) -> Tables:
    every = entities(spark, sf_dir, "text", "lang")
    is_s1 = F.col("entity_id").startswith("S1-")
    keyed = every.select("entity_id", "ord", "lang", F.sha2("text", 256).alias("sha"))
    first = keyed.where(is_s1).groupBy("sha", "lang").agg(F.min_by("entity_id", "ord").alias("s1_id"))
    true = keyed.where(~is_s1).join(first, ["sha", "lang"]).select("s1_id", F.col("entity_id").alias("t_id"))
    plain = every.drop("text", "lang")
    return Tables(plain.where(is_s1), plain.where(~is_s1), true)
