"""The corpus pipeline: from ``documents`` to encoded documents of a mix.

Each stage is a function of (spark, docs, sf_dir). Its result is written as Parquet and
read again as the next one's ``docs``, so a stage's lineage is a table that all executors
can read, and a stage can be run again from there.

1. ``language``: documents in which no language can be found (null, or no letter) go. The
   model is trained on a bounded sample of the labelled documents; its class and score reject
   nothing, and without labelled documents those with letters stay.
2. ``exact``: of documents that are equal after lower-casing A-Z the one with the largest id stays.
3. ``near``: of documents connected by Jaccard similarity of at least 0.8 on five-word
   shingles the one with the smallest id stays.
4. ``mix``: sources are brought to their targets. A document that the mix takes twice is two
   rows; one that it takes in part is cut after the words taken; one not taken goes. Rows are
   in the order of the schedule's slots.
5. ``encode``: every document's token ids, their number and digests, and the decoded text's digest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinweave.llm import bpe, exact, jaccard, langid, mixing
from kinweave.llm.common import drop, table, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.accepted(docs, langid.train(docs))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact.survivors(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each(docs, n=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digests(docs, bpe.vocabulary(), ids=True)


STAGES = [("language", language), ("exact", exact_copies), ("near", near_copies), ("mix", mix), ("encode", encode)]

#: language identification has no SQL; see tests/llm/test_pipeline.py for the brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        if last is not None:
            drop(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
