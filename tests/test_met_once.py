"""Pairs of gates that keep all that meet: each once, without a distinct, also where postings are long, regions differ and asks are split."""

import random
from collections import Counter, defaultdict

import pytest

from kinweave.operators import blocking
from kinweave.operators.records import rich_records

from .test_linkage import ents


def tables(spark, seed, n=120):
    rng = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "alphabet"]
    place = lambda: f"{rng.randint(1, 9)} {rng.choice(['main', 'side'])} {rng.choice(['hill', 'park'])}, {rng.choice(['austin tx', 'boston ma', 'town'])} {rng.choice(['', '75001'])}"
    row = lambda i, s: (f"S{s}-{i:03}", " ".join(rng.choices(words, [9, 3, 2, 1, 1, 3], k=rng.randint(1, 4))), rng.choice(["", place()]), rng.choice(["US", "US", "France"]))
    return [rich_records(ents(spark, [row(i, s) for i in range(n)]), "v2") for s in (1, 2)]


def plain(asks, posts, gate):
    """Every pair that meets, by lists."""
    by = defaultdict(list)
    for p in sorted(posts, key=lambda p: p.id):
        by[p.country, p.kind, p.key].append(p)
    out = set()
    for a in asks:
        every = by[a.country, a.kind, a.key]
        if a.kind in ("stem", "pfx"):
            if a.kind == "stem" and a.place is None or a.kind == "pfx" and not gate.prefix:
                continue
            if len(every) > (gate.take if a.kind == "stem" else gate.prefix_take):
                every = [p for p in every if p.geo == a.geo][: gate.geo] if a.geo else every[: gate.any]
        elif len(every) > gate.numbers:
            continue
        out |= {(a.id, p.id) for p in every}
    return out


@pytest.mark.parametrize("gate", [blocking.Gate(10, 6, 8, prefix=blocking.ALWAYS, prefix_take=12, numbers=5), blocking.Gate(15, 0, 0, prefix=blocking.ALWAYS, prefix_take=15, geo_numbers=False), blocking.Gate(4, 9, 3), blocking.GATES["v3"]])
def test_each_pair_meets_once(spark, monkeypatch, gate):
    monkeypatch.setattr(blocking, "MEETING", 50)
    a, b = tables(spark, gate.take)
    want = plain(blocking._postings(a, gate).collect(), blocking._postings(b, gate).collect(), gate)
    df = blocking.gated_candidates(a, b, gate, by_s1=False)
    got = Counter((r.s1_id, r.t_id) for r in df.collect())
    assert set(got) == want and set(got.values()) == {1}
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    top = plan.index("Join Inner")
    assert "Aggregate" not in plan[:top] and "Repartition" not in plan[:top]  # nothing is shuffled after pairs have met
