"""The command line.

``generate`` links source 1 to the targets with the modular pipeline (trained on a truth
file, or loaded) and writes candidates and matches. ``worker`` links one part of one
country's source 1 by a rule profile; ``merge`` puts workers' parts together in the order
of source 1. ``validate`` checks result files; its exit code is 1 if a check fails.
Paths may be of any file system that Spark knows.
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.checkpoint import written
from kinweave.operators import audit, models
from kinweave.plans import linkage
from kinweave.plans.profiles import PROFILES
from kinweave.sources import readers, writers

COUNTRIES = ("France", "US", "India")


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="kinweave", description="Record linkage on Spark")
    sub = top.add_subparsers(dest="command", required=True)
    folder = argparse.ArgumentParser(add_help=False)
    folder.add_argument("--data", required=True, help="folder with <prefix>_source1.tsv, _source2.tsv and _source3.tsv")
    folder.add_argument("--prefix", default="test")

    g = sub.add_parser("generate", parents=[folder], help="candidates and matches by the modular pipeline")
    g.add_argument("--out", default="outputs")
    g.add_argument("--limit", type=int, help="only so many source-1 entities of each country")
    g.add_argument("--countries", nargs="+", default=list(COUNTRIES))
    g.add_argument("--threshold", type=float, default=0.80)
    g.add_argument("--append", action="store_true", help="add to the output instead of replacing it")
    g.add_argument("--model", help="a saved model; without it one is trained")
    g.add_argument("--train", help="folder with the training sources and ground_truth.tsv, for training")
    g.add_argument("--train-prefix", default="train")
    g.add_argument("--save", help="where to save the trained model")

    w = sub.add_parser("worker", parents=[folder], help="one part of one country by a rule profile")
    w.add_argument("--country", required=True)
    w.add_argument("--part", type=int, default=0)
    w.add_argument("--num-parts", "--num_parts", type=int, default=1)
    w.add_argument("--out", "--output_dir", default="outputs/parts")
    w.add_argument("--profile", default="turbo", choices=sorted(p for p in PROFILES if p != "champion"))

    m = sub.add_parser("merge", parents=[folder], help="workers' parts in the order of source 1")
    m.add_argument("--parts", default="outputs/parts")
    m.add_argument("--out", default="outputs")

    v = sub.add_parser("validate", help="check result files")
    v.add_argument("--test-dir", "-t", "--data", dest="data", default="dataset/test", help="folder with the three sources")
    v.add_argument("--prefix", default="test")
    v.add_argument("--matching", "-m", default="output/matching_results.tsv")
    v.add_argument("--candidate", "-c", default="output/candidate_pairs.tsv", help="a missing file is a warning")
    v.add_argument("--check-ids", action="store_true", help="also look up every id in sources 2 and 3")
    return top


def _sources(spark: SparkSession, folder: str, prefix: str) -> tuple[DataFrame, DataFrame]:
    one, two, three = (readers.entities(spark, f"{folder}/{prefix}_source{i}.tsv") for i in (1, 2, 3))
    return one, two.unionByName(three)


def _of(df: DataFrame, countries: Sequence[str]) -> DataFrame:
    return df.where(F.trim("country").isin(list(countries)))


def generate(spark: SparkSession, a: argparse.Namespace) -> int:
    s1, targets = _sources(spark, a.data, a.prefix)
    pipe = linkage.ERPipeline(threshold=a.threshold)
    if a.model:
        pipe.classifier = models.MatchClassifier(linkage.features.FEATURES14).load(a.model)
    else:
        known, true = readers.truth(spark, f"{a.train}/ground_truth.tsv")
        x, y = _sources(spark, a.train, a.train_prefix)
        pipe.train(readers.needed(x, known), y, true)
        if a.save:
            pipe.classifier.save(a.save)
    s1, targets = _of(s1, a.countries), _of(targets, a.countries)
    if a.limit is not None:
        parts = [readers.sample(_of(s1, [c]), a.limit) for c in a.countries]
        s1 = parts[0]
        for p in parts[1:]:
            s1 = s1.unionByName(p)
        s1 = written(s1)
    cands, matches = pipe.predict(s1, targets)
    place = matches.withColumn("idx", -F.col("score"))
    for name, column, rows, order in (("candidate_pairs", "candidate_entity_ids", cands, "rank"), ("matching_results", "matched_entity_ids", place, "idx")):
        writers.write_tsv(writers.wide(s1, rows, column, order), f"{a.out}/{name}", "append" if a.append else "overwrite")
    return 0


def worker(spark: SparkSession, a: argparse.Namespace) -> int:
    if not 0 <= a.part < a.num_parts:
        raise SystemExit("--part must be below --num-parts")
    s1, targets = (_of(x, [a.country]) for x in _sources(spark, a.data, a.prefix))
    total = s1.count()
    first, last = total * a.part // a.num_parts, total * (a.part + 1) // a.num_parts
    own = written(readers.row_range(s1, first, last - first))
    cands, matches = linkage.rule_linkage(own, targets, a.profile)
    folder = f"{a.out}/{a.country}_{a.part}"
    writers.write_tsv(writers.wide(own, cands.withColumn("idx", F.lit(0)), "candidate_entity_ids"), f"{folder}/candidate_pairs")
    writers.write_tsv(writers.wide(own, matches.withColumn("idx", -F.col("score"))), f"{folder}/matching_results")
    return 0


def merge(spark: SparkSession, a: argparse.Namespace) -> int:
    s1 = readers.entities(spark, f"{a.data}/{a.prefix}_source1.tsv", ordered=True)
    for name, column in (("candidate_pairs", "candidate_entity_ids"), ("matching_results", "matched_entity_ids")):
        rows = readers.results(spark, f"{a.parts}/*/{name}").where(F.col("t_id").isNotNull())
        writers.write_tsv(writers.wide(s1, rows, column), f"{a.out}/{name}", ordered=True)
    return 0


def validate(spark: SparkSession, a: argparse.Namespace) -> int:
    s1, targets = _sources(spark, a.data, a.prefix)
    found = audit.validate_files(spark, a.matching, s1, a.candidate, targets if a.check_ids else None).orderBy("severity", "rule").collect()
    for r in found:
        print(f"{r.severity.upper()} {r.rule}: {r.n}{f' ({r.examples})' if r.examples else ''}")
    failed = any(r.severity == "error" for r in found)
    print("FAILED" if failed else "PASSED")
    return int(failed)


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    args = _parser().parse_args(argv)
    if args.command == "generate" and not (args.model or args.train):
        raise SystemExit("generate needs --model or --train")
    session = spark or SparkSession.builder.appName("kinweave").getOrCreate()
    return {"generate": generate, "worker": worker, "merge": merge, "validate": validate}[args.command](session, args)
