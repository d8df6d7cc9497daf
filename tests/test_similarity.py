"""Kernels over whole batches against those over one pair."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kinweave.functions import similarity as S

KERNELS = [(S.lcs, S.lcs_all), (S.ratio, S.ratio_all), (S.token_sort_ratio, S.token_sort_all), (S.token_set_ratio, S.token_set_all), (S.jaro_winkler, S.jaro_winkler_all)]
TEXT = st.text("ab éß漢😀", max_size=12) | st.text("abc ", min_size=55, max_size=75)


@pytest.mark.parametrize("one, every", KERNELS)
@settings(max_examples=80, deadline=None)
@given(pairs=st.lists(st.tuples(TEXT, TEXT), max_size=12))
def test_a_batch_is_its_pairs(one, every, pairs):
    a, b = [p for p, _ in pairs], [q for _, q in pairs]
    assert list(every(a, b)) == [pytest.approx(one(p, q), abs=1e-12) for p, q in pairs]


@pytest.mark.parametrize("one, every", KERNELS)
def test_many_pairs_and_word_edges(one, every, monkeypatch):
    monkeypatch.setattr(S, "CHUNK", 64)
    rng = random.Random(5)
    text = lambda: "".join(rng.choice("abcde ") for _ in range(rng.choice([0, 1, 2, 31, 63, 64, 65, 130])))
    a = [text() for _ in range(700)]
    b = [text() if rng.random() < 0.5 else x[: rng.randint(0, len(x))] + rng.choice(["", "a", "z b"]) for x in a]
    assert list(every(a, b)) == [pytest.approx(one(p, q), abs=1e-12) for p, q in zip(a, b, strict=True)]


def test_columns_with_nulls_and_repeats(spark):
    rows = [("alpha beta", "beta alpha"), (None, "x"), (None, None), ("x", ""), ("alpha beta", "beta alpha")]
    df = spark.createDataFrame(rows, "a string, b string").coalesce(1)
    got = df.select("a", "b", S.ratio_udf("a", "b").alias("r"), S.token_sort_udf("a", "b").alias("o"), S.token_set_udf("a", "b").alias("t"), S.jaro_winkler_udf("a", "b").alias("j")).collect()
    for r in got:
        x, y = r.a or "", r.b or ""
        assert (r.r, r.o, r.t, r.j) == pytest.approx((S.ratio(x, y), S.token_sort_ratio(x, y), S.token_set_ratio(x, y), S.jaro_winkler(x, y)), abs=1e-12)
    assert df.limit(0).select(S.ratio_udf("a", "b")).collect() == []
