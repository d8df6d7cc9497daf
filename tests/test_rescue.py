"""The rescue by equal address against a walk over all targets."""

import random

import pytest

from kinweave.operators import refine

SCHEMA = "entity_id string, business_name string, business_address string, country string, ord bigint"


def walk(s1, targets, held, most=2):
    """s1 and targets: (id, numbers, group, ord)."""
    taken = {t for _, t in held}
    have = {(s, src): sum(a == s and t[:2] == src for a, t in held) for s, *_ in s1 for src in ("S2", "S3")}
    out = []
    for t, nums, group, _ in sorted(targets, key=lambda r: (r[0][:2], r[3], r[0])):
        if t in taken:
            continue
        for s, own, place, _ in sorted(s1, key=lambda r: (r[3], r[0])):
            if place == group and have[s, t[:2]] < most and not (nums and own and not set(nums) & set(own)):
                have[s, t[:2]] += 1
                out.append((s, t))
                break
    return sorted(out)


def place(group, nums):
    # equal address keys with other numbers: digits of seven places and more are no street numbers, but part of the key
    return f"{group} long street name of a town"


def frame(spark, monkeypatch, rows):
    """Entities whose number sets are given, as the address key would hold the numbers."""
    return spark.createDataFrame([(i, "name", f"{place(g, n)}|{' '.join(n)}", "US", o) for i, n, g, o in rows], SCHEMA)


@pytest.fixture
def numbers_apart(monkeypatch):
    """Numbers stand behind a bar that is no part of the address key."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(refine.X, "number_set", lambda c: F.filter(F.split(F.element_at(F.split(c, r"\|"), -1), " "), lambda x: x != ""))
    monkeypatch.setattr(refine.X, "address_key", lambda c: F.element_at(F.split(c, r"\|"), 1))
    import kinweave.operators.blocking as blocking

    monkeypatch.setattr(blocking, "X", refine.X, raising=False)


def rows(seed, n, m):
    rng = random.Random(seed)
    nums = lambda: rng.sample(["1", "2", "3", "44", "5"], rng.choice([0, 0, 1, 1, 2, 3]))
    one = [(f"S1-{i:02}", nums(), rng.choice("ab"), rng.randint(0, n)) for i in range(n)]
    two = [(f"S{rng.randint(2, 3)}-{i:03}", nums(), rng.choice("abc"), rng.randint(0, m)) for i in range(m)]
    return one, two


@pytest.mark.parametrize("seed,turn", [(1, 1000), (2, 1000), (3, 4), (4, 1), (5, 7)])
def test_rescue_is_the_walk(spark, monkeypatch, numbers_apart, seed, turn):
    one, two = rows(seed, 14, 60)
    held = [(one[0][0], two[0][0]), (one[1][0], two[1][0]), (one[1][0], two[2][0])]
    got = refine.rescue(frame(spark, monkeypatch, one), frame(spark, monkeypatch, two), spark.createDataFrame(held, "s1_id string, t_id string"), turn=turn)
    assert sorted((r.s1_id, r.t_id) for r in got.collect()) == walk(one, two, held)


def test_a_hundred_thousand_targets_at_one_address(spark, monkeypatch, numbers_apart):
    one = [(f"S1-{i:05}", [str(i % 7)] if i % 3 else [], "a", i) for i in range(3000)]
    two = [(f"S2-{i:06}", [str(i % 11)] if i % 2 else [], "a", i) for i in range(100_000)]
    none = spark.createDataFrame([], "s1_id string, t_id string")
    got = {r.t_id: r.s1_id for r in refine.rescue(frame(spark, monkeypatch, one), frame(spark, monkeypatch, two), none, turn=60_000).collect()}
    # in order, by sets of free places
    import heapq

    lists = {k: [] for k in (None, "", *map(str, range(7)))}
    for i, (_, nums, *_) in enumerate(one):
        for k in (0, 1):
            for name in ("", nums[0] if nums else None):
                heapq.heappush(lists[name], (i, k))
    taken, want = set(), {}
    for t, nums, *_ in two:
        best = None
        for name in ([None] + [n for n in nums if n in lists]) if nums else [""]:
            while lists[name] and lists[name][0] in taken:
                heapq.heappop(lists[name])
            if lists[name] and (best is None or lists[name][0] < best):
                best = lists[name][0]
        if best is not None:
            taken.add(best)
            want[t] = one[best[0]][0]
    assert got == want and len(want) == 6000
