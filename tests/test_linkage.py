import random
import zipfile
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from kinweave.operators import audit, blocking, evaluation, features, models, refine, scoring, selection
from kinweave.operators.records import normalize_records, rich_records
from kinweave.plans import catalogue, linkage
from kinweave.schema import ENTITY
from kinweave.sources import readers, writers

TARGETS = [
    ("S2-001", "Payne Enterprises Inc", "3315 Fremont St, Peoria, IL", "US"),
    ("S2-002", "Random Bakery", "123 Main St, Chicago, IL", "US"),
    ("S3-003", "Payne Enterpires", "Peoria, IL, 3315 Fremont St", "US"),
]
QUERY = [("S1-999", "Payne Énterprises", "3315 Fremont Street, Peoria, IL", "US")]


def ents(spark, rows):
    return spark.createDataFrame(rows, ENTITY)


def pairs(spark, rows):
    return spark.createDataFrame(rows, "s1_id string, t_id string, score double")


def ids(df):
    return sorted((r.s1_id, r.t_id) for r in df.collect())


def test_blocking(spark):
    a, b = normalize_records(ents(spark, QUERY)), normalize_records(ents(spark, TARGETS))
    assert sorted((r.key_type, r.key) for r in blocking.blocking_keys(a).collect()) == sorted(
        [("w1", "payne"), ("pfx3", "pay"), ("pfx", "payn"), ("w2", "enterprises"), ("num", "3315"), ("addr", "fremont")]
    )
    assert ids(blocking.candidates(a, b)) == [("S1-999", "S2-001"), ("S1-999", "S3-003")]
    assert ids(blocking.candidates(a, b, max_posting=1)) == [("S1-999", "S2-001")]  # only w2 has one posting
    assert ids(blocking.candidates(a, b, top=1)) == [("S1-999", "S2-001")]


def test_posting_limit_is_inclusive(spark):
    a = normalize_records(ents(spark, [("S1-1", "abc", "", "US")]))
    b = normalize_records(ents(spark, [(f"S2-{i}", "abc", "", "US") for i in range(5)]))
    assert len(ids(blocking.candidates(a, b, max_posting=5))) == 5
    assert ids(blocking.candidates(a, b, max_posting=4)) == []


def test_features(spark):
    q = [("S1-100", "Payne Enterprises Inc", "3315 Fremont St, Peoria, IL", "US")]
    t = [("S2-200", "Payne Enterpires", "3315 Fremont Street, Peoria, IL", "US"), ("S2-300", "Payne Medical Clinic", "900 Main St, Chicago, IL", "US")]
    a, b = (features.with_grams(normalize_records(ents(spark, x)), "norm_name", "norm_address") for x in (q, t))
    p = features.pairs_of(spark.createDataFrame([("S1-100", "S2-200"), ("S1-100", "S2-300")], "s1_id string, t_id string"), a, b)
    f = {r.t_id: r for r in features.features14(p).collect()}
    assert f["S2-200"].name_char_cosine > 0.6 and f["S2-200"].addr_num_match == 1
    assert f["S2-200"].name_jaccard == 0.25 and f["S2-200"].combined_jaccard == pytest.approx(0.55)
    assert f["S2-200"].combined_jaccard > f["S2-300"].combined_jaccard


@pytest.mark.parametrize(
    ("b", "jw", "a", "overlap", "has", "empty", "geo", "indic", "want"),
    [
        (70, 1, 50, False, False, False, False, False, 0.960),
        (52, 1, 68, False, False, False, False, False, 0.9416),
        (30, 1, 80, True, True, False, False, False, 0.960),
        (90, 1, 40, False, False, False, False, False, 0.955),
        (88, 0.88, 0, False, False, True, False, False, 1.008),
        (94, 1, 100, False, True, False, False, False, 0),
        (95, 1, 100, False, True, False, False, False, 0.9975),
        (0, 0, 78, True, True, False, False, True, 0.988),
        (0, 0, 88, False, False, False, False, True, 0.988),
        (100, 1, 100, True, True, False, True, False, 0),
    ],
)
def test_v5_tiers(spark, b, jw, a, overlap, has, empty, geo, indic, want):
    lit = F.lit
    score, _ = scoring.tier_score(scoring.PROFILES["v5"], lit(float(b)), lit(float(jw)), lit(float(a)), lit(overlap), lit(has), lit(empty), lit(geo), lit(indic))
    # 90/40 also fits the first tier's address gate only from 50 on; its own tier gives 0.86 + 0.09
    assert spark.range(1).select(score.alias("s")).collect()[0].s == pytest.approx(0.950 if (b, a) == (90, 40) else want)


def greedy(rows, low, margin, cap):
    best, count, taken, out = {}, defaultdict(int), set(), []
    for s, t, p in sorted(rows, key=lambda r: (-r[2], r[0], r[1])):
        if p < low or t in taken:
            continue
        best.setdefault(s, p)
        if best[s] - p <= margin and count[s, t[:2]] < cap:
            count[s, t[:2]] += 1
            taken.add(t)
            out.append((s, t))
    return sorted(out)


def test_unique_assignment(spark):
    rows = [("a", "S2-1", 0.99), ("b", "S2-1", 0.98), ("b", "S2-2", 0.95), ("a", "S2-2", 0.94), ("a", "S3-9", 0.90)]
    assert ids(selection.unique_assignment(pairs(spark, rows))) == [("a", "S2-1"), ("b", "S2-2")]


@pytest.mark.parametrize("rounds", [50, 1])
def test_unique_assignment_is_the_greedy(spark, rounds):
    random.seed(rounds)
    rows = list({(f"S1-{random.randint(1, 9)}", f"S{random.randint(2, 3)}-{random.randint(1, 9)}"): round(random.uniform(0.8, 1), 2) for _ in range(90)}.items())
    rows = [(*k, v) for k, v in rows]
    assert ids(selection.unique_assignment(pairs(spark, rows), 0.85, 0.08, 2, rounds=rounds)) == greedy(rows, 0.85, 0.08, 2)


def test_margin_cap(spark):
    rows = [("a", "S2-1", 0.95), ("a", "S2-2", 0.95), ("a", "S2-3", 0.94), ("a", "S3-1", 0.90), ("a", "S3-2", 0.899), ("a", "X-1", 0.95)]
    assert ids(selection.margin_cap(pairs(spark, rows), 0.8, 0.05, 2)) == [("a", "S2-1"), ("a", "S2-2"), ("a", "S3-1")]


@pytest.mark.parametrize(
    ("truth", "pred", "want"),
    [("", "", (1, 1, 1)), ("", "x", (0, 0, 0)), ("x", "", (0, 0, 0)), ("xy", "xyz", (2 / 3, 1, 0.714286)), ("xy", "x", (1, 0.5, 0.833333)), ("x", "z", (0, 0, 0))],
)
def test_f_beta(spark, truth, pred, want):
    s1 = spark.createDataFrame([("a",)], "entity_id string")
    long = lambda s: spark.createDataFrame([("a", c) for c in s], "s1_id string, t_id string")
    r = evaluation.entity_scores(s1, long(pred), long(truth)).collect()[0]
    assert (r.precision, r.recall, r.f_beta) == pytest.approx(want, abs=1e-5)


def test_rerank_and_third(spark):
    m = spark.createDataFrame([("a", "S2-1", 0), ("a", "S2-2", 1), ("a", "S2-3", 2)], "s1_id string, t_id string, idx int")
    facts = spark.createDataFrame([], "entity_id string, nums array<string>, pins array<string>")
    none = m.limit(0)
    assert [(r.t_id, r.score) for r in refine.rerank(m, facts, none).orderBy("idx").collect()] == [("S2-1", 100), ("S2-2", 95), ("S2-3", 90)]
    assert ids(refine.cap(refine.rerank(m, facts, none), 2, 120)) == [("a", "S2-1"), ("a", "S2-2")]
    both = m.where("idx = 2")
    assert ids(refine.cap(refine.rerank(m, facts, both), 2, 120)) == [("a", "S2-1"), ("a", "S2-3")]


def test_rescue(spark):
    addr = "12 long street name, springfield"
    s1 = spark.createDataFrame([("S1-1", "x", addr, "US", 0), ("S1-2", "y", addr, "US", 1), ("S1-3", "z", "1 a", "US", 2)], "entity_id string, business_name string, business_address string, country string, ord bigint")
    t = spark.createDataFrame([(f"S2-{i}", "n", addr.upper(), "US", i) for i in range(5)] + [("S3-1", "n", addr, "FR", 9), ("S3-2", "n", "1 a", "US", 9)], s1.schema)
    none = spark.createDataFrame([], "s1_id string, t_id string")
    assert ids(refine.rescue(s1, t, none)) == [("S1-1", "S2-0"), ("S1-1", "S2-1"), ("S1-2", "S2-2"), ("S1-2", "S2-3")]
    one = spark.createDataFrame([("S1-1", "S2-0")], "s1_id string, t_id string")
    assert ids(refine.rescue(s1, t, one)) == [("S1-1", "S2-1"), ("S1-2", "S2-2"), ("S1-2", "S2-3")]


def test_validator(spark):
    s1 = ents(spark, [(f"S1-{i}", "", "", "") for i in range(1, 4)])
    bad = spark.createDataFrame([("S1-1", "S2-1,S2-1"), ("S1-1", ""), ("S1-2", "S1-3,X-1"), ("S1-9", "S2-7")], "source1_entity_id string, matched_entity_ids string")
    got = {r.rule: r.n for r in audit.validate(bad, s1, None, ents(spark, [("S2-1", "", "", "")])).collect()}
    assert got == {"duplicate_row": 1, "duplicate_id_in_list": 1, "self_match": 1, "bad_prefix": 1, "missing_s1": 1, "foreign_s1": 1, "unknown_id": 1}


def test_files(spark, tmp_path):
    p = tmp_path / "s2.tsv"
    p.write_text("entity_id\tbusiness_name\tbusiness_address\tcountry\nS2-1\tA \"b\" null\t\tUS\nS2-2\tC\td\n", encoding="utf-8")
    rows = {r.entity_id: tuple(r) for r in readers.entities(spark, str(p)).collect()}
    assert rows == {"S2-1": ("S2-1", 'A "b" null', "", "US"), "S2-2": ("S2-2", "C", "d", "")}
    s1 = spark.createDataFrame([("S1-1",), ("S1-2",)], "entity_id string")
    m = spark.createDataFrame([("S1-1", "S2-2", 1), ("S1-1", "S2-1", 0)], "s1_id string, t_id string, idx int")
    writers.write_tsv(writers.wide(s1, m), str(tmp_path / "out"))
    back = readers.results(spark, str(tmp_path / "out"))
    assert sorted(map(str, map(tuple, back.collect()))) == ["('S1-1', 0, 'S2-1')", "('S1-1', 1, 'S2-2')", "('S1-2', None, None)"]
    said = {r.rule for r in audit.validate_files(spark, str(tmp_path / "none"), s1).collect()}
    assert said == {"missing_file", "no_candidate_file", "id_check_off"}
    archive = writers.package(spark, str(tmp_path / "out"), str(tmp_path / "o.zip"))
    with zipfile.ZipFile(archive) as z:
        names = z.namelist()
        text = b"".join(map(z.read, names)).decode()
    assert names and all(n.startswith("part-") for n in names)
    assert sorted(x for x in text.splitlines() if x.startswith("S1")) == ["S1-1\tS2-1,S2-2", "S1-2\t"]


def test_models(spark):
    rows = [(f"S1-{i}", f"S2-{i}", float(i % 2), float((i * 7) % 5), i % 2) for i in range(80)]
    df = spark.createDataFrame(rows, "s1_id string, t_id string, x double, y double, label int")
    for kind, more in (("logreg", {}), ("gbdt", {"maxIter": 3})):
        m = models.MatchClassifier(["x", "y"], kind, overrides=more).fit(df)
        s = m.score(df).collect()
        assert len(s) == 80 and all(0 <= r.score <= 1 for r in s)
        assert sum(m.importances().values()) == pytest.approx(1)
        assert m.score(df.limit(0)).collect() == []
    with pytest.raises(ValueError, match="unknown"):
        models.MatchClassifier(["x"], "forest")


@pytest.mark.parametrize("profile", ["v2", "production", "v5"])
def test_rule_linkage(spark, profile):
    _, got = linkage.rule_linkage(ents(spark, QUERY), ents(spark, TARGETS), profile)
    assert ("S1-999", "S2-001") in ids(got) and ("S1-999", "S2-002") not in ids(got)


def test_gated_stop(spark):
    t = rich_records(ents(spark, [(f"S2-{i:02}", f"alpha w{i}", "", "US") for i in range(30)] + [("S2-99", "beta", "", "US")]))
    q = rich_records(ents(spark, [("S1-1", "alpha beta", "", "US")]))
    g = blocking.Gate(200, 40, 40, stop=1)
    assert ids(blocking.gated_candidates(q, t, g)) == [("S1-1", "S2-99")]  # the rarest stem is enough
    assert len(ids(blocking.gated_candidates(q, t, blocking.Gate(200, 40, 40, stop=40)))) == 31
    assert len(ids(blocking.gated_candidates(q, t, blocking.Gate(10, 5, 7)))) == 8  # a long posting gives its first 7


def test_stream(spark, tmp_path):
    from kinweave.streaming.linkage import StreamLinker

    ents(spark, TARGETS).write.parquet(str(tmp_path / "in"))
    link = StreamLinker(ents(spark, QUERY), str(tmp_path / "out"), 0.3)
    q = link.start(spark.readStream.schema(ENTITY).parquet(str(tmp_path / "in")), str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert ids(spark.read.parquet(str(tmp_path / "out"))) == [("S1-999", "S2-001"), ("S1-999", "S3-003")]


@pytest.mark.parametrize("query, kind", [("er_gbdt_scores", "gbdt"), ("er_logreg_scores", "logreg"), ("er_linkage_champion", "champion")])
def test_registered_scorers_train_on_the_whole_job(spark, monkeypatch, query, kind):
    class Seen(Exception):
        pass

    def fit(self, data):
        raise Seen(self.kind, self.overrides, data.count())

    asked = []
    limit = models.limit_negatives
    monkeypatch.setattr(models.MatchClassifier, "fit", fit)
    monkeypatch.setattr(models, "limit_negatives", lambda rows, *a: asked.append(a) or limit(rows, *a))
    with pytest.raises(Seen) as e:
        catalogue.QUERIES[query](spark, "/root/testdata/sf0.001")
    assert e.value.args[:2] == (kind, {})  # the settings of the profile, all rounds
    assert bool(asked) == (kind == "champion")
    if kind != "champion":
        assert e.value.args[2] == catalogue._Work(spark, "/root/testdata/sf0.001").candidates().count()


def test_hot_postings_are_cut_before_they_are_sorted(spark):
    t = rich_records(ents(spark, [(f"S2-{i:02}", f"alpha w{i}", "1 A St, Town TX", "US") for i in range(30)]))
    q = rich_records(ents(spark, [("S1-1", "alpha", "1 A St, Town TX", "US")]))
    plan = blocking.gated_candidates(q, t, blocking.GATES["champion"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 4  # a partial and a final limit for each of the two ranks


def test_streams_cut_hot_keys(spark, tmp_path):
    from kinweave.streaming.linkage import StreamLinker

    s1 = ents(spark, [(f"S1-{i}", f"alpha beta{i}", "", "US") for i in range(6)])
    link = StreamLinker(s1, str(tmp_path), 0.0, max_posting=5, top=2)
    got = link.score(ents(spark, [("S2-1", "alpha beta3", "", "US"), ("S2-2", "alpha gamma", "", "US")]))
    assert ids(got) == [("S1-3", "S2-1")]  # the first word is hot, the second isn't
    link = StreamLinker(s1, str(tmp_path), 0.0, top=2)
    assert ids(link.score(ents(spark, [("S2-1", "alpha beta3", "", "US")]))) == [("S1-0", "S2-1"), ("S1-3", "S2-1")]
