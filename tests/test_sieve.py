"""What is left out before pairs are compared: nothing that scores, and no target that counts."""

import random

import pytest
from pyspark.sql import functions as F

from kinweave.checkpoint import written
from kinweave.functions.similarity import letter_marks, token_sort_ratio
from kinweave.operators import blocking, features, scoring
from kinweave.operators.records import rich_records
from kinweave.plans import catalogue, linkage
from kinweave.plans.adapter import Tables
from kinweave.plans.profiles import PROFILES

from .test_linkage import ents, ids


@pytest.mark.parametrize("words", [1, 2, 4])
def test_marks_bound_the_ratio(words):
    rng = random.Random(words)
    texts = ["".join(rng.choices("aabcz ß1ü९  ", k=rng.randint(0, 40))) for _ in range(150)] + ["", " "]
    for x, a in zip(texts, letter_marks(texts, words), strict=True):
        for y, b in zip(texts, letter_marks(texts, words), strict=True):
            lacks = max(abs(a[0] - b[0]), sum(((p ^ q) & (1 << 64) - 1).bit_count() for p, q in zip(a[1:], b[1:], strict=True)))
            assert token_sort_ratio(x, y) * (a[0] + b[0]) <= 100 * (a[0] + b[0] - lacks) + 1e-6


def tables(spark, seed, n=150):
    rng = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "shop", "कमल"]

    def place():
        return rng.choice(["", f"{rng.randint(1, 6)} {rng.choice(['main', 'side', 'long'])} road, {rng.choice(['Austin, TX', 'Boston, MA', 'town'])} {rng.choice(['', '75001'])}"])

    row = lambda i, s: (f"S{s}-{i:03}", " ".join(rng.choices(words, k=rng.randint(1, 4))), place(), rng.choice(["US", "US", "India"]))
    return ents(spark, [row(i, 1) for i in range(n)]), ents(spark, [row(i, 2 + i % 2) for i in range(n)])


@pytest.mark.parametrize("profile", sorted(scoring.PROFILES))
def test_what_is_sifted_scores_as_before(spark, profile):
    p = PROFILES[profile]
    plain = [written(rich_records(x, p.records)) for x in tables(spark, 7)]
    marked = [written(scoring.with_marks(x)) for x in plain]
    gate = blocking.GATES[p.gate]
    every = blocking.gated_candidates(*plain, gate)
    want = scoring.rule_scores(features.pairs_of(every, *plain), p.scorer)
    sifted = blocking.gated_candidates(*marked, gate, blocking.Sieve(scoring.LIGHT, scoring.may_score(p.scorer)))
    got = scoring.rule_scores(features.pairs_of(sifted, *marked), p.scorer)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(want) and rows(got) == rows(want)
    if not gate.stop:
        assert sifted.count() < every.count() / 2


@pytest.mark.parametrize("profile", ["v2", "v4", "v5", "refined"])
def test_matches_alone_are_those_of_the_plan(spark, monkeypatch, profile):
    s1, t = tables(spark, 11)
    _, want = linkage.rule_linkage(s1, t, profile)
    compared, make = [], features.pairs_of
    monkeypatch.setattr(features, "pairs_of", lambda pairs, a, b: compared.append((pairs.count(), a.columns)) or make(pairs, a, b))
    got = catalogue_matches(spark, monkeypatch, s1, t, profile)
    rows = lambda df: sorted((r.s1_id, r.t_id, round(r.score, 9), r.rank) for r in df.collect())
    assert rows(want) and rows(got) == rows(want)
    assert "nums_mark" in compared[0][1]


def catalogue_matches(spark, monkeypatch, s1, t, profile):
    """What ``er_linkage_<profile>`` gives on these tables."""
    monkeypatch.setattr(catalogue, "tables", lambda *_: Tables(s1, t, None))
    return catalogue._linked(profile)(spark, "")


def test_stems_after_one_that_gives_enough_meet_nothing(spark, monkeypatch):
    rich = lambda rows: rich_records(ents(spark, [(i, n, "", "US") for i, n in rows]), "champion")
    t = rich([(f"S2-{i:03}", "alpha beta" if i < 60 else f"alpha word{i}") for i in range(120)])
    q = rich([("S1-1", "alpha beta"), ("S1-2", "alpha word61")])
    seen, write = {}, blocking.written
    monkeypatch.setattr(blocking, "written", lambda df, name="part": seen.setdefault(name, write(df, name)))
    got = ids(blocking.gated_candidates(q, t, blocking.GATES["champion"]))
    stems = {(r.s1_id, r.key) for r in seen["needed"].where(F.col("kind") == "stem").collect()}
    assert stems == {("S1-1", "beta"), ("S1-2", "word61"), ("S1-2", "alpha")}  # 60 targets of "beta" are over the limit of 40
    assert [t for s, t in got if s == "S1-1"] == [f"S2-{i:03}" for i in range(60)] and ("S1-2", "S2-061") in got
