"""Stages of long conditions stay within what the JVM compiles."""

import pytest

from kinweave.operators import blocking, features
from kinweave.operators.records import rich_records
from kinweave.session import COMPILED

from .test_sieve import tables

KEY = "spark.sql.codegen.hugeMethodLimit"


@pytest.mark.parametrize("least", ["65535", "4000"])
def test_pairs_and_candidates_lower_the_limit(spark, least):
    a, b = (rich_records(x, "champion") for x in tables(spark, 3, 5))
    before = spark.conf.get(KEY)
    try:
        for plan in (lambda: features.pairs_of(spark.createDataFrame([("S1-000", "S2-000")], "s1_id string, t_id string"), a, b), lambda: blocking.gated_candidates(a, b, blocking.GATES["v4"])):
            spark.conf.set(KEY, least)
            plan()
            assert int(spark.conf.get(KEY)) == min(COMPILED, int(least))
    finally:
        spark.conf.set(KEY, before)
