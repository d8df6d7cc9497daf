"""Top-k blocking against a plain version that looks at every pair of a key."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from kinweave.operators import blocking
from kinweave.operators.records import normalize_records, rich_records

from .test_linkage import ents


def plain(keys, names, max_posting, top):
    """{s1: [(t, jaccard)]}"""
    posts = defaultdict(set)
    for country, i, kind, key in keys:
        if not i.startswith("S1"):
            posts[country, kind, key].add(i)
    found = defaultdict(set)
    for country, i, kind, key in keys:
        p = posts.get((country, kind, key), ())
        if i.startswith("S1") and len(p) <= max_posting:
            found[i] |= set(p)
    jaccard = lambda x, y: len(x & y) / len(x | y) if x and y else 0.0
    return {i: sorted(((t, jaccard(names[i], names[t])) for t in ts), key=lambda r: (-r[1], r[0]))[:top] for i, ts in found.items()}


def tables(spark, seed, n=260):
    rng = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "etas", "theta"]

    def name():
        first = rng.choices(words, [9, 3, 1, 1, 1, 1, 1, 1])[0]  # one first word is in half of all names
        return " ".join([first, *rng.choices(words + ["iota", "kappa", "lambda"], k=rng.randint(0, 4))])

    row = lambda i, s: (f"S{s}-{i:03}", name(), f"{rng.randint(1, 4)} {rng.choice(['main', 'side'])} road", rng.choice(["US", "US", "France"]))
    own = [row(i, 1) for i in range(n // 2)]
    own += [(f"S1-9{i:02}", *own[0][1:]) for i in range(30)]  # equal records ask once
    return ents(spark, own), ents(spark, [row(i, 2 + i % 2) for i in range(n)] + [(f"S2-9{i:02}", "alpha beta gamma delta", "", "US") for i in range(40)])


@pytest.mark.parametrize("top,max_posting", [(3, 400), (10, 400), (4, 60), (1, 400), (30, 2000)])
def test_the_best_are_those_of_all_pairs(spark, top, max_posting):
    s1, t = (normalize_records(x) for x in tables(spark, top))
    rows = s1.unionByName(t)
    keys = [tuple(r) for r in blocking.blocking_keys(rows).collect()]
    names = {r.entity_id: set(r.name_tokens) for r in rows.collect()}
    want = plain(keys, names, max_posting, top)
    got = defaultdict(list)
    for r in sorted(blocking.candidates(s1, t, max_posting, top).collect(), key=lambda r: (r.s1_id, r["rank"])):
        got[r.s1_id].append((r.t_id, r.jaccard))
    assert {i: [(t, pytest.approx(j)) for t, j in rows] for i, rows in want.items()} == dict(got)


def test_few_pairs_meet_on_a_hot_key(spark):
    rng = random.Random(1)
    words = [f"w{i:03}" for i in range(300)]
    name = lambda: "alpha " + " ".join(rng.sample(words, 3))
    s1 = normalize_records(ents(spark, [(f"S1-{i}", name(), "", "US") for i in range(150)]))
    t = normalize_records(ents(spark, [(f"S2-{i:04}", name(), "", "US") for i in range(1500)]))
    own = s1.select(F.col("entity_id").alias("s1_id"), "country", blocking._keys().alias("keys"), F.array_sort("name_tokens").alias("s1_words"))
    posts = blocking.postings(t, 2000)
    met = blocking.met_pairs(own, posts, 30).count()
    kinds = Counter(r.key_type for r in posts.collect())
    every = 150 * sum(kinds[k] for k in ("w1", "pfx3", "pfx"))
    assert met < every / 10


def test_subsets(spark):
    df = spark.createDataFrame([(["a", "b", "c", "d"],), (["a"],), ([],)], "w array<string>")
    got = [[sorted(x) for x in r] for r in df.select(*[blocking._subsets(F.col("w"), n) for n in (1, 2, 3)]).collect()]
    assert got[0] == [["a", "b", "c", "d"], ["a b", "a c", "a d", "b c", "b d", "c d"], ["a b c", "a b d", "a c d", "b c d"]]
    assert got[1] == [["a"], [], []] and got[2] == [[], [], []]


def test_pairs_that_meet_are_dealt_out_by_the_number_of_asking_records(spark, monkeypatch):
    monkeypatch.setattr(blocking, "ASKING", 4)
    s1, t = (normalize_records(x) for x in tables(spark, 5))
    distinct = len({(r.country, r.business_name, r.business_address) for r in tables(spark, 5)[0].collect()})
    plan = blocking.candidates(s1, t)._jdf.queryExecution().executedPlan().toString()
    dealt = [int(n) for n in re.findall(r"hashpartitioning\(s1_id#\d+, (\d+)\), REPARTITION_BY_NUM", plan)]
    assert dealt and distinct // 8 < dealt[0] <= -(-distinct // 4)


@pytest.mark.parametrize("gate", ["v4", "turbo"])
def test_gated_pairs_are_dealt_out_before_they_are_made_distinct(spark, monkeypatch, gate):
    monkeypatch.setattr(blocking, "DEALT", 100)
    q = rich_records(ents(spark, [(f"S1-{i:02}", "alpha beta", f"{i} main road", "US") for i in range(20)]), gate.replace("v4", "v2"))
    t = rich_records(ents(spark, [(f"S2-{i:02}", f"alpha w{i}", f"{i} main road", "US") for i in range(40)]), gate.replace("v4", "v2"))
    got = blocking.gated_candidates(q, t, blocking.GATES[gate])
    plan = got._jdf.queryExecution().executedPlan().toString()
    dealt = [int(n) for n in re.findall(r"hashpartitioning\(s1_id#\d+, (\d+)\), REPARTITION_BY_NUM", plan)]
    assert dealt and dealt[0] >= 20 * 40 // 100  # 800 pairs meet on the first word
    assert {(r.s1_id, r.t_id) for r in got.collect()} == {(f"S1-{i:02}", f"S2-{j:02}") for i in range(20) for j in range(40)}
