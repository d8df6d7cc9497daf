import hashlib

from kinweave.llm import exact

from .helpers import ODD, docs


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def test_groups(spark):
    got = exact.exact_groups(docs(spark, ODD), capacity=2).collect()
    assert len(got) == len(ODD)
    groups = {}
    for i, t, *_ in ODD:
        groups.setdefault(lower(t), []).append(i)
    by_sha = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in groups.items()}
    for r in got:
        members = by_sha[r.text_sha256]
        known = [m for m in members if m is not None]
        assert r.group_size == len(members) and r.keep_id == max(known, default=None)
        assert r.kept == (r.doc_id == r.keep_id)
    assert exact.exact_groups(docs(spark, ODD).limit(0)).collect() == []


def test_survivors(spark):
    d = docs(spark, ODD)
    kept = exact.survivors(d)
    assert kept.columns == d.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id) == [2, 3, 6, 7, 8, 9, 10]


def test_directory_splits_overfull_buckets():
    hist = {p: (10, False) for p in range(16)}
    depth, entries = exact.directory(hist, 4, 40)
    assert depth == 2 and len(entries) == 4 and all(e[1] == 2 for e in entries)
    skewed = {0: (1000, True), 1: (3, False), 12: (4, False)}
    depth, entries = exact.directory(skewed, 4, 5)
    assert depth == 4 and len(entries) == 16
    assert entries[0] != entries[1] and entries[8] == entries[15] == (1, 1)
    assert exact.directory({}, 4, 5) == (0, [(0, 0)])


def test_colliding_keys_are_chained(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(exact.F, "xxhash64", lambda *c: F.length(c[0]).cast("bigint"))
    got = {r.doc_id: r for r in exact.exact_groups(docs(spark, [(1, "ab", "", ""), (2, "cd", "", ""), (3, "AB", "", "")])).collect()}
    assert got[1].keep_id == 3 and got[2].keep_id == 2
    assert {got[1].chain, got[2].chain} == {1, 2}
