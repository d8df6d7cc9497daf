import random

import pytest
from pyspark.sql import functions as F

from kinweave.functions import similarity as S
from kinweave.functions import text as X


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "v string").select(expr(F.col("v")).alias("o")).collect()[0].o


@pytest.mark.parametrize(
    ("value", "expected"),
    [
        ("Acme Incorporated", "acme inc"),
        ("Ss Food Private Limited", "ss food pvt ltd"),
        ("Dréxkor International Ltd.", "drexkor international ltd"),
        ("Acme Inc Foo", "acme incfoo"),
        ("A Co Op", "a coop"),
        ("limited liability company", "ltdliability co"),  # the rule for ltd takes the blank, as in the other glued cases
        ("साई केयर प्राइवेट", "स ई क यर पर इव ट"),
        ("", ""),
        (None, ""),
    ],
)
def test_business_names(spark, value, expected):
    assert one(spark, value, lambda c: X.business_name(X.fold(c))) == expected


@pytest.mark.parametrize(
    ("value", "expected"),
    [
        ("630 45th Terrace, Kansas City, MO, null", "630 45th terrace kansas city mo"),
        ("3315 Fremont Street, Peoria, IL", "3315 fremont st peoria il"),
        ("85 Wayne Avenue, Ticonderoga, NY", "85 wayne ave ticonderoga ny"),
    ],
)
def test_addresses(spark, value, expected):
    assert one(spark, value, lambda c: X.address(X.fold(c))) == expected


def test_fold(spark):
    assert one(spark, "Payne Énterprises", X.fold) == "payne enterprises"


def test_numbers(spark):
    assert one(spark, "45th 630", X.numbers) == ["630"]
    assert one(spark, None, X.numbers) == []
    assert one(spark, "Sector 12, plot 7, no 0042, PIN 600026, 1234567", X.number_set) == ["42", "600026"]
    assert one(spark, "no 007 000 12", X.plain_integers) == ["7", "0", "12"]
    assert one(spark, "a 12345 b 123456 c 1234567", X.postal_codes) == ["12345", "123456"]


def test_geo(spark):
    rows = [("1 main st chicago il us in", "", "US", "IN"), ("flat 2 andheri mumbai maharashtra up", "", "India", "MH"), ("3 rue x", "3 rue X 75011 Paris", "France", "75"), ("x", "x", "DE", ""), ("", "y 75011", "France", "")]
    df = spark.createDataFrame(rows, "a string, raw string, c string, want string")
    for r in df.select("want", X.geo_code(F.col("a"), F.col("raw"), F.col("c")).alias("got")).collect():
        assert r.got == r.want


def test_ngrams(spark):
    assert one(spark, "ab", X.ngrams) == [" ab", "ab "]
    assert one(spark, "", X.ngrams) == []
    assert one(spark, "ab", lambda c: X.ngrams(c, pad=False)) == []
    assert one(spark, "aaaa", lambda c: X.ngrams(c, pad=False)) == ["aaa"]


def test_core_brand(spark):
    assert one(spark, "acme pvt ltd", lambda c: X.core_brand(c, X.LEGAL_WORDS)) == "acme"
    assert one(spark, "pvt ltd", lambda c: X.core_brand(c, X.LEGAL_WORDS)) == "pvt ltd"
    assert one(spark, "pvt ltd", lambda c: X.core_brand(c, X.LEGAL_WORDS, fallback=False)) == ""
    assert one(spark, "payne holdings group", lambda c: X.core_brand(c)) == "payne"


def test_lcs_is_that_of_the_table():
    random.seed(2)
    for _ in range(400):
        a, b = ("".join(random.choices("abcé ", k=random.randint(0, 12))) for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        assert S.lcs(a, b) == best[-1][-1]


def test_ratios():
    assert S.ratio("", "") == 100 and S.ratio("a", "") == 0
    assert S.token_sort_ratio("b a", "a b") == 100
    assert S.token_set_ratio("a b", "a b c") == 100 and S.token_set_ratio("", "a") == 0
    assert S.jaro_winkler("", "") == 1 and S.jaro_winkler("a", "") == 0
    assert S.jaro_winkler("martha", "marhta") == pytest.approx(0.961111, abs=1e-6)
