"""Patterns as they are given to Java: the same matches as with plain boundaries, and no boundary looked at before a letter."""

import random

from pyspark.sql import functions as F

from kinweave.functions import text as X

PATTERNS = [
    *(p for t in (X.LEGAL_SUFFIXES, X.ADDRESS_SHORT, X.FRANCE, X.INDIA, X.INDIA_STATE_NAMES) for p, _ in t),
    *X.SUFFIX_PATTERNS, *(rf"\b{n}\b" for n, _ in X.INDIAN_STATES), X.TLD, r"(?i)\b(null|none)\b", "(?i)" + X.SECTOR, "(?i)" + X.SECTOR_WIDE,
    rf"\b({'|'.join(X.TRADE_WORDS)})\b", r"\b\d+\b", r"\b\d{5,6}\b", r"\b(\d{5})\b", r"\binc(?:\.|\b)",
]


def plain(pattern):
    return pattern.replace(r"\b", X.BOUND).replace(r"\d", r"\p{Nd}")


def test_patterns_match_as_before(spark):
    rng = random.Random(5)
    words = ["st", "street", "inc", "inc.", "co", "pvt", "ltd", ".", "tamil nadu", "ts", "tg", "sector", "sec", "12", "75001", "750012", "٣", "null", "NONE", "n°", "bis", "private  limited", "limited liability company", "é", "कमल", "_", "𐐷", ".com", "-#", "up", "a"]
    texts = ["".join(w + rng.choice(["", " ", " ", ", "]) for w in rng.choices(words, k=rng.randint(0, 9))) for _ in range(400)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for lo in range(0, len(PATTERNS), 20):
        some = PATTERNS[lo : lo + 20]
        got = df.select(*[F.regexp_replace("t", f(p), "<>") for f in (plain, X.java) for p in some]).collect()
        for r in got:
            assert list(r[: len(some)]) == list(r[len(some) :])


def test_no_boundary_is_tried_at_every_character():
    left = [p for p in PATTERNS if X.java(p).startswith((X.BOUND, "(?i)" + X.BOUND))]
    assert left == [r"\b(\d{5})\b"]
