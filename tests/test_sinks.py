import json
import os

import pytest
from pyspark.sql import functions as F

from kinweave import cli
from kinweave.operators import audit, blocking, evaluation, features, models, selection
from kinweave.plans import linkage
from kinweave.sources import readers, writers

from .test_linkage import ents, greedy, ids


def lines(path):
    out = []
    for p in sorted(os.listdir(path)):
        if p.startswith("part-"):
            out += (path / p).read_text(encoding="utf-8").splitlines()
    return out


def matches(spark):
    return spark.createDataFrame([("S1-1", "S2-2", 1), ("S1-1", "S2-1", 0), ("S1-3", "S3-9", 0)], "s1_id string, t_id string, idx int")


def numbered(spark, n=4):
    return spark.createDataFrame([(f"S1-{i}", n - i) for i in range(n)], "entity_id string, ord int")


def test_ordered_tsv_is_in_the_order_of_source_1(spark, tmp_path):
    writers.write_tsv(writers.wide(numbered(spark), matches(spark)).coalesce(1), str(tmp_path / "o"), ordered=True)
    got = [x for x in lines(tmp_path / "o") if x != "source1_entity_id\tmatched_entity_ids"]
    assert got == ["S1-3\tS3-9", "S1-2\t", "S1-1\tS2-1,S2-2", "S1-0\t"]


def test_append_adds_rows_without_a_header(spark, tmp_path):
    table = writers.wide(numbered(spark), matches(spark))
    writers.write_tsv(table.where("source1_entity_id < 'S1-2'"), str(tmp_path / "o"))
    writers.write_tsv(table.where("source1_entity_id >= 'S1-2'"), str(tmp_path / "o"), mode="append")
    assert sorted(r.s1_id for r in readers.results(spark, str(tmp_path / "o")).select("s1_id").distinct().collect()) == ["S1-0", "S1-1", "S1-2", "S1-3"]
    assert sum(x.startswith("source1") for x in lines(tmp_path / "o")) <= 2


def test_csv_with_and_without_quotes(spark, tmp_path):
    table = writers.wide(numbered(spark), matches(spark)).coalesce(1)
    writers.write_csv(table, str(tmp_path / "q"), quoted=True)
    writers.write_csv(table, str(tmp_path / "p"))
    assert 'S1-1,"S2-1,S2-2"' in lines(tmp_path / "q") and "S1-1,S2-1,S2-2" in lines(tmp_path / "p")
    for kind in ("q", "p"):
        got = {(r.s1_id, r.t_id) for r in readers.results(spark, str(tmp_path / kind), comma=True).collect()}
        assert got >= {("S1-1", "S2-1"), ("S1-1", "S2-2"), ("S1-3", "S3-9")}


def test_promotion_keeps_what_was_current(spark, tmp_path):
    for name in ("new", "newer", "newest"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "x").write_text(name)
        writers.promote(spark, str(tmp_path / name), str(tmp_path / "current"))
    assert (tmp_path / "current" / "x").read_text() == "newest" and (tmp_path / "current.previous" / "x").read_text() == "newer"


def test_log_reports_and_splits(spark, tmp_path):
    for f in (0.5, 0.7):
        writers.log_experiment(spark, {"id": "EXP", "f05": f}, str(tmp_path / "log"))
    log = spark.read.option("header", True).csv(str(tmp_path / "log")).collect()
    assert sorted(r.f05 for r in log) == ["0.5", "0.7"] and all(r.logged_at for r in log)
    writers.write_report(spark.createDataFrame([(1, "a")], "n int, s string"), str(tmp_path / "r"))
    assert [json.loads(x) for x in lines(tmp_path / "r")] == [{"n": 1, "s": "a"}]
    assert "| f05 | 0.5 |" in writers.markdown("T", {"f05": 0.5})
    s1, t = ents(spark, [("S1-1", "a", "b", "US")]), ents(spark, [("S2-1", "a", "b", "US")])
    writers.write_validation_split(s1, t, spark.createDataFrame([("S1-1", "S2-1")], "s1_id string, t_id string"), str(tmp_path / "v"))
    assert "S1-1\tS2-1" in lines(tmp_path / "v" / "val_gt") and "S2-1\ta\tb\tUS" in lines(tmp_path / "v" / "val_targets")


def test_partitioned_parquet_prunes_countries_and_columns(spark, tmp_path):
    rows = ents(spark, [("S1-1", "a", "b", "US"), ("S1-2", "c", "d", "France")])
    writers.write_partitioned(rows, str(tmp_path / "p"))
    got = readers.parquet(spark, str(tmp_path / "p")).where("country = 'US'").select("entity_id")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert [r.entity_id for r in got.collect()] == ["S1-1"] and "PartitionFilters: [isnotnull(country" in plan and "business_name" not in plan


def test_samples_ranges_and_first_rows(spark):
    rows = spark.createDataFrame([(f"S1-{i}", i % 3) for i in (5, 3, 1, 4, 2)] + [("S1-1", 9)], "entity_id string, ord int")
    assert [r.entity_id for r in readers.sample(rows.where("ord < 9"), 2).collect()] == ["S1-1", "S1-2"]
    assert [r.entity_id for r in readers.row_range(rows.where("ord < 9"), 1, 2).collect()] == ["S1-2", "S1-3"]
    assert sorted((r.entity_id, r.ord) for r in readers.keep_first(rows).collect())[0] == ("S1-1", 1)


def test_truth_files_keep_singletons(spark, tmp_path):
    (tmp_path / "gt.tsv").write_text("source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1, S3-2\nS1-2\t\n", encoding="utf-8")
    s1, truth = readers.truth(spark, str(tmp_path / "gt.tsv"))
    assert sorted(r.entity_id for r in s1.collect()) == ["S1-1", "S1-2"] and ids(truth) == [("S1-1", "S2-1"), ("S1-1", "S3-2")]


def test_splits_and_validation_sets(spark):
    s1 = spark.range(200).selectExpr("concat('S1-', id) AS entity_id")
    a, b = evaluation.split(s1, 80)
    assert a.count() + b.count() == 200 and 130 < a.count() < 190 and a.join(b, "entity_id").count() == 0
    targets = spark.range(300).selectExpr("concat('S', 2 + id % 2, '-', lpad(id, 3, '0')) AS entity_id")
    truth = spark.createDataFrame([("S1-1", "S2-298"), ("S1-99", "S3-299")], "s1_id string, t_id string")
    head, pool = evaluation.validation_set(s1, truth, targets, entities=5, distractors=4)
    assert head.count() == 5 and sorted(r.entity_id for r in pool.collect()) == ["S2-000", "S2-002", "S2-004", "S2-006", "S2-298", "S3-001", "S3-003", "S3-005", "S3-007"]


def companies(spark, n=24):
    names = ["payne", "acme", "zenith", "orion", "delta", "quartz", "maple", "cobalt"]
    kinds = ["bakery", "motors", "clinic"]
    s1 = [(f"S1-{i}", f"{names[i % 8]} {kinds[i // 8]} inc", f"{100 + i} Main Street, Town {i % 5}", "US") for i in range(n)]
    t = [(f"S{2 + i % 2}-{i}", f"{names[i % 8].title()} {kinds[i // 8]}", f"{100 + i} Main St, Town {i % 5}", "US") for i in range(n)]
    t += [(f"S{2 + i % 2}-{100 + i}", f"{names[i % 8]} logistics", f"{900 + i} Side Road", "US") for i in range(n)]
    return ents(spark, s1), ents(spark, t), spark.createDataFrame([(f"S1-{i}", f"S{2 + i % 2}-{i}") for i in range(n)], "s1_id string, t_id string")


@pytest.mark.parametrize("hard", [False, True])
def test_the_pipeline_trains_predicts_and_tunes(spark, tmp_path, hard):
    s1, t, truth = companies(spark)
    pipe = linkage.ERPipeline(threshold=0.5, hard_negatives=hard, overrides={"maxIter": 5, "stepSize": 0.9})
    cands, got = pipe.train(s1, t, truth).predict(s1, t)
    assert ids(got) == ids(truth) and set(ids(got)) <= set(ids(cands))
    sweep = pipe.tune(s1, t, truth, taus=(0.1, 0.5, 0.9))
    best = max(r.macro_f05 for r in sweep.collect())
    assert pipe.threshold == min(r.tau for r in sweep.collect() if r.macro_f05 == best) and best == 1.0
    pipe.classifier.save(str(tmp_path / "m"))
    again = models.MatchClassifier(features.FEATURES17 if hard else features.FEATURES14).load(str(tmp_path / "m"))
    _, rows = pipe.pairs(s1, t)
    score = lambda m: sorted((r.s1_id, r.t_id, r.score) for r in m.score(rows).collect())
    assert score(again) == score(pipe.classifier)
    with pytest.raises(Exception, match="(?i)exist|path"):
        models.MatchClassifier(["x"]).load(str(tmp_path / "none"))


def test_unique_sweep_is_the_greedy_at_each_threshold(spark):
    import random

    random.seed(3)
    rows = [(f"S1-{random.randint(1, 9)}", f"S{random.randint(2, 3)}-{random.randint(1, 9)}") for _ in range(80)]
    rows = [(*k, round(random.uniform(0.5, 1), 2)) for k in sorted(set(rows))]
    s = spark.createDataFrame(rows, "s1_id string, t_id string, score double")
    each = s.crossJoin(spark.createDataFrame([(0.5,), (0.8,)], "tau double")).where("score >= tau")
    for rounds in (50, 1):
        got = selection.unique_assignment(each, 0.0, 0.2, 2, rounds=rounds, by=["tau"]).collect()
        for tau in (0.5, 0.8):
            assert sorted((r.s1_id, r.t_id) for r in got if r.tau == tau) == greedy(rows, tau, 0.2, 2)


def test_large_components_go_on_in_rounds(spark, monkeypatch):
    rows = [(f"S1-{i:03}", f"S2-{i:03}", 1 - i / 1000) for i in range(12)] + [(f"S1-{i:03}", f"S2-{i - 1:03}", 1.0005 - i / 1000) for i in range(1, 12)]
    s = spark.createDataFrame(rows, "s1_id string, t_id string, score double")
    want = greedy(rows, 0.5, 1, 3)
    for most in (0, 1000):
        monkeypatch.setattr(selection, "SEQUENTIAL", most)
        assert ids(selection.unique_assignment(s, 0.5, 1, 3, rounds=2)) == want


def write_sources(folder, prefix, s1, t):
    rows = lambda df: [tuple(r) for r in df.collect()]
    parts = {1: rows(s1), 2: [r for r in rows(t) if r[0].startswith("S2")], 3: [r for r in rows(t) if r[0].startswith("S3")]}
    for i, p in parts.items():
        text = "entity_id\tbusiness_name\tbusiness_address\tcountry\n" + "".join("\t".join(r) + "\n" for r in p)
        (folder / f"{prefix}_source{i}.tsv").write_text(text, encoding="utf-8")


def test_command_line(spark, tmp_path, monkeypatch, capsys):
    s1, t, truth = companies(spark)
    write_sources(tmp_path, "test", s1, t)
    write_sources(tmp_path, "train", s1, t)
    gt = {}
    for r in truth.collect():
        gt.setdefault(r.s1_id, []).append(r.t_id)
    (tmp_path / "ground_truth.tsv").write_text("source1_entity_id\tmatched_entity_ids\n" + "".join(f"{k}\t{','.join(v)}\n" for k, v in gt.items()), encoding="utf-8")
    d, out = str(tmp_path), str(tmp_path / "out")
    monkeypatch.setitem(models.SETTINGS, "gbdt", {"maxIter": 5, "stepSize": 0.9})
    assert cli.main(["generate", "--data", d, "--train", d, "--save", f"{d}/model", "--out", out, "--threshold", "0.5"], spark) == 0
    got = readers.results(spark, f"{out}/matching_results")
    assert ids(got.where("t_id is not null")) == ids(truth) and got.select("s1_id").distinct().count() == 24
    check = ["validate", "--data", d, "-m", f"{out}/matching_results", "-c", f"{out}/candidate_pairs", "--check-ids"]
    assert cli.main(check, spark) == 0 and "PASSED" in capsys.readouterr().out
    assert cli.main(["generate", "--data", d, "--model", f"{d}/model", "--out", f"{d}/some", "--limit", "3", "--countries", "US"], spark) == 0
    assert readers.results(spark, f"{d}/some/matching_results").select("s1_id").distinct().count() == 3
    assert cli.main(["validate", "--data", d, "-m", f"{d}/some/matching_results"], spark) == 1
    said = capsys.readouterr().out
    assert "ERROR missing_s1: 21" in said and "FAILED" in said
    for part in ("0", "1"):
        assert cli.main(["worker", "--data", d, "--country", "US", "--part", part, "--num_parts", "2", "--output_dir", f"{d}/parts"], spark) == 0
    assert cli.main(["merge", "--data", d, "--parts", f"{d}/parts", "--out", f"{d}/merged"], spark) == 0
    order = [x.split("\t")[0] for x in lines(tmp_path / "merged" / "matching_results") if x.startswith("S1")]
    assert order == [r.entity_id for r in s1.collect()]
    merged = ids(readers.results(spark, f"{d}/merged/matching_results").where(F.col("t_id").isNotNull()))
    assert merged == ids(linkage.rule_linkage(s1, t, "turbo")[1]) and set(ids(truth)) <= set(merged)
    with pytest.raises(SystemExit):
        cli.main(["generate", "--data", d], spark)


def test_true_matches_join_the_candidates_if_their_target_is_there(spark):
    frame = lambda rows: spark.createDataFrame(rows, "s1_id string, t_id string")
    pool = spark.createDataFrame([("S2-1",), ("S2-2",), ("S2-3",)], "entity_id string")
    got = blocking.with_true_matches(frame([("S1-1", "S2-1")]), frame([("S1-1", "S2-1"), ("S1-1", "S2-2"), ("S1-2", "S2-9")]), pool)
    assert ids(got) == [("S1-1", "S2-1"), ("S1-1", "S2-2")]


def test_labels_and_limited_negatives(spark):
    pairs = [(f"S1-{i % 3}", f"S2-{i}") for i in range(60)]
    rows = spark.createDataFrame(pairs, "s1_id string, t_id string")
    truth = spark.createDataFrame([pairs[0], pairs[3], pairs[0], ("S1-9", "S2-9")], "s1_id string, t_id string")
    data = models.labelled(rows, truth)
    assert sorted((r.s1_id, r.t_id) for r in data.where("label = 1").collect()) == sorted([pairs[0], pairs[3]]) and data.count() == 60
    few = models.limit_negatives(data, 5).collect()
    assert sum(r.label for r in few) == 2 and all(sum(r.s1_id == f"S1-{k}" and not r.label for r in few) == 5 for k in range(3))
    assert sorted(map(str, few)) == sorted(map(str, models.limit_negatives(data.repartition(3), 5).collect()))


def test_archives_are_read_by_others(spark, tmp_path):
    import subprocess
    import zipfile

    from kinweave.sources import writers

    table = spark.createDataFrame([(f"S1-{i}", "S2-ä,S3-漢" * (i % 5)) for i in range(3000)], "source1_entity_id string, matched_entity_ids string").repartition(6)
    writers.write_tsv(table, str(tmp_path / "out folder"))
    archive = writers.package(spark, str(tmp_path / "out folder"), str(tmp_path / "o.zip"))
    with zipfile.ZipFile(archive) as z:
        assert z.testzip() is None and len(z.namelist()) == 6
        held = {n: z.read(n) for n in z.namelist()}
    parts = {p.name: p.read_bytes() for p in (tmp_path / "out folder").glob("part-*")}
    assert held == parts
    java = spark.sparkContext._jvm.java.util.zip.ZipFile(archive)  # another reader
    assert java.size() == 6
    java.close()
    writers.write_tsv(table.limit(0).coalesce(1), str(tmp_path / "none"))
    with zipfile.ZipFile(writers.package(spark, str(tmp_path / "none"), str(tmp_path / "n.zip"))) as z:
        assert b"".join(map(z.read, z.namelist())) in (b"", b"source1_entity_id\tmatched_entity_ids\n")
    assert subprocess.run(["python", "-m", "zipfile", "-t", archive], capture_output=True).returncode == 0


def test_the_validator_has_default_paths(spark, tmp_path, monkeypatch):
    from kinweave import cli

    args = cli._parser().parse_args(["validate"])
    assert (args.data, args.prefix, args.matching, args.candidate, args.check_ids) == ("dataset/test", "test", "output/matching_results.tsv", "output/candidate_pairs.tsv", False)
    assert cli._parser().parse_args(["validate", "--test-dir", "d"]).data == cli._parser().parse_args(["validate", "-t", "d"]).data == "d"
    (tmp_path / "r.tsv").write_text("source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1\n")
    s1 = spark.createDataFrame([("S1-1",)], "entity_id string")
    said = {r.rule: r.severity for r in audit.validate_files(spark, f"file://{tmp_path}/r.tsv", s1, f"file://{tmp_path}/none.tsv").collect()}
    assert said["no_candidate_file"] == "warning" and "error" not in said.values()
