"""Row ranges without a task that sees all rows."""

import random

import pytest

from kinweave.sources import readers


def frame(spark, values, parts=5):
    return spark.createDataFrame([(v, i, "x") for i, v in enumerate(values)], "entity_id string, n int, c string").repartition(parts)


@pytest.mark.parametrize("offset,length", [(0, 10), (990, 100), (400, 1), (1, 998), (5000, 4), (0, 0), (333, 333)])
def test_ranges_inside_a_table(spark, offset, length):
    values = [f"S1-{i:04}" for i in range(1000)]
    random.Random(1).shuffle(values)
    got = readers.row_range(frame(spark, values), offset, length)
    assert [r.entity_id for r in got.collect()] == sorted(values)[offset : offset + length]
    assert got.columns == ["entity_id", "n", "c"]


@pytest.mark.parametrize("offset,length", [(0, 7), (3, 5), (10, 25), (35, 30), (61, 3), (0, 200)])
def test_equal_and_null_values(spark, offset, length):
    rng = random.Random(2)
    rows = [(rng.choice([None, "a", "b", "c"]), rng.choice([1, 2]), "x") for _ in range(64)]
    df = spark.createDataFrame(rows, "entity_id string, n int, c string")
    got = [tuple(r) for r in readers.row_range(df, offset, length).collect()]
    assert len(got) == len(rows[offset : offset + length])
    keys = [(r[0] is not None, r[0] or "") for r in got]
    assert keys == sorted((r[0] is not None, r[0] or "") for r in rows)[offset : offset + length]
    whole = [tuple(r) for k in range(0, 64, 9) for r in readers.row_range(df, k, 9).collect()]
    assert sorted(map(str, whole)) == sorted(map(str, rows))  # slices that follow each other hold every row once


def test_the_plan_has_no_single_task(spark):
    got = readers.row_range(frame(spark, [f"S1-{i:04}" for i in range(500)]), 100, 50, by="n")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Limit" not in plan and [r.n for r in got.collect()] == list(range(100, 150))
    assert readers.row_range(frame(spark, []), 0, 5).collect() == []


def test_file_order_over_many_splits(spark, tmp_path):
    from kinweave.sources import writers

    ids = [f"S1-{i * 7919 % 1000:03}" for i in range(1000)]
    (tmp_path / "in.tsv").write_text("entity_id\tbusiness_name\tbusiness_address\tcountry\n" + "".join(f"{i}\tname {i}\t{'x' * (int(i[3:]) % 50)}\tUS\n" for i in ids))
    was = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        rows = readers.entities(spark, str(tmp_path / "in.tsv"), ordered=True)
        assert rows.rdd.getNumPartitions() > 8
        assert [r.entity_id for r in rows.orderBy("ord").collect()] == ids
        none = spark.createDataFrame([], "s1_id string, t_id string, idx int")
        writers.write_tsv(writers.wide(rows, none), str(tmp_path / "out"), ordered=True)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was[0])
        spark.conf.set("spark.sql.files.openCostInBytes", was[1])
    lines = [x for p in sorted((tmp_path / "out").glob("part-*")) for x in p.read_text().splitlines()]
    assert [x.split("\t")[0] for x in lines if x.startswith("S1-")] == ids
