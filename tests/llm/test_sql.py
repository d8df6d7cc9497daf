import os

import duckdb
import pytest

from kinweave.llm import catalogue

DIR = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_query_is_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    got = catalogue.QUERIES[name](spark, DIR)
    cols = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({catalogue.ORACLE[name]})").fetchall()
    assert sorted(map(str, map(tuple, got.select(cols).collect()))) == sorted(map(str, want))
