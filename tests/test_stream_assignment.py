"""Unique assignment of batches, and what it leaves in the shared folder."""

import os
import random
import uuid

import pytest

from kinweave import checkpoint
from kinweave.operators import selection
from kinweave.streaming.linkage import StreamLinker, UniqueMatches

from .test_linkage import QUERY, TARGETS, ents, greedy, ids

SCHEMA = "s1_id string, t_id string, score double"


def batches(seed, n=5):
    rng = random.Random(seed)
    out, used = [], set()
    for k in range(n):
        rows = {}
        for _ in range(25):
            pair = (f"S1-{rng.randint(1, 12)}", f"S{rng.randint(2, 3)}-{rng.randint(10 * k, 10 * k + 14)}")
            if pair not in used:
                rows[pair] = round(rng.uniform(0.8, 1), 2)
        used |= set(rows)
        out.append([(*p, s) for p, s in rows.items()])
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_each_batch_leaves_the_assignment_of_all_edges(spark, tmp_path, seed):
    log, seen = UniqueMatches(str(tmp_path / "log"), 0.82, 0.06, 2), []
    for k, rows in enumerate(batches(seed)):
        log.update(spark.createDataFrame(rows, SCHEMA), k)
        seen += rows
        assert ids(log.matches(spark)) == greedy(seen, 0.82, 0.06, 2)
        assert sorted(map(tuple, log.edges(spark).select("s1_id", "t_id", "score").collect())) == sorted(seen)
    log.update(spark.createDataFrame(rows, SCHEMA), k)  # run again after a failure
    assert ids(log.matches(spark)) == greedy(seen, 0.82, 0.06, 2)
    log.update(spark.createDataFrame([], SCHEMA), k + 1)
    assert ids(log.matches(spark)) == greedy(seen, 0.82, 0.06, 2)


def test_a_batch_writes_only_what_it_touches(spark, tmp_path):
    log = UniqueMatches(str(tmp_path / "log"))
    log.update(spark.createDataFrame([(f"S1-{i}", f"S2-{i}", 0.9) for i in range(50)], SCHEMA), 0)
    log.update(spark.createDataFrame([("S1-3", "S2-99", 0.95), ("S1-200", "S2-200", 0.9)], SCHEMA), 1)
    rows = spark.read.parquet(str(tmp_path / "log" / "batch=1")).collect()
    assert sorted((r.s1_id, r.t_id, r.kept) for r in rows if not r.dead) == [("S1-200", "S2-200", True), ("S1-3", "S2-3", True), ("S1-3", "S2-99", True)]
    assert sum(r.dead for r in rows) == 1
    log.update(spark.createDataFrame([("S1-3", "S2-3", 0.5)], SCHEMA), 2)  # a new score replaces the old one
    assert ("S1-3", "S2-3") not in ids(log.matches(spark)) and len(ids(log.matches(spark))) == 51


def test_the_stream_keeps_matches(spark, tmp_path):
    from kinweave.schema import ENTITY

    ents(spark, TARGETS).repartition(3).write.parquet(str(tmp_path / "in"))
    log = UniqueMatches(str(tmp_path / "log"), 0.3, 1.0, 3)
    link = StreamLinker(ents(spark, QUERY), str(tmp_path / "out"), 0.3, assigned=log)
    stream = spark.readStream.schema(ENTITY).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    link.start(stream, str(tmp_path / "ck")).awaitTermination(180)
    assert ids(log.matches(spark)) == [("S1-999", "S2-001"), ("S1-999", "S3-003")]


@pytest.mark.parametrize("rounds", [50, 1])
def test_scratch_tables_are_dropped(spark, tmp_path, monkeypatch, rounds):
    monkeypatch.setattr(checkpoint, "shared_dir", lambda session: f"file://{tmp_path}/shared/{uuid.uuid4().hex}")
    rows = [r for b in batches(3) for r in b]
    got = selection.unique_assignment(spark.createDataFrame(rows, SCHEMA), 0.82, 0.06, 2, rounds=rounds)
    assert len(os.listdir(tmp_path / "shared")) == 1 and ids(got) == greedy(rows, 0.82, 0.06, 2)
