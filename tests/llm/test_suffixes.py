import hashlib
import os
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinweave.llm import suffixes

from .helpers import ODD, docs

DIR = "/root/testdata/sf0.001"


def brute(texts, length):
    """(removed bytes, spans, kept bytes) of each text, by counting all strings."""
    data = [(t or "").encode() for t in texts]
    count = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if count[d[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = list(zip(*[x.tolist() for x in suffixes.runs(gone)], strict=True))
        out.append((len(d), int(gone.sum()), spans, bytes(np.frombuffer(d, np.uint8)[~gone])))
    return out


def check(spark, rows, length, **options):
    d = docs(spark, rows)
    got = suffixes.repeats(d, length, **options)
    want = sorted(map(str, ((i, n, r, len(s), [a for a, _ in s], [b for _, b in s], hashlib.sha256(k).hexdigest()) for (i, *_), (n, r, s, k) in zip(rows, brute([t for _, t, *_ in rows], length), strict=True))))
    assert sorted(str(tuple(r)) for r in got.collect()) == want
    return got


def test_covers_are_perfect():
    for v, d in suffixes.COVERS.items():
        assert {(a - b) % v for a in d for b in d} == set(range(v))
    assert suffixes.period(200) == 133 and suffixes.period(50) == 31 and suffixes.period(2) == 1


@pytest.mark.parametrize("length,block,bucket", [(200, 1 << 20, 1 << 20), (50, 2000, 300), (12, 300, 50), (2, 1, 40)])
def test_equals_counting(spark, length, block, bucket):
    rng = random.Random(length)
    word = lambda: "".join(rng.choice("abcdeéß漢") for _ in range(rng.randint(1, 9)))
    passages = [" ".join(word() for _ in range(rng.randint(length // 6, length))) for _ in range(5)]
    rows = []
    for i in range(60):
        parts = [" ".join(word() for _ in range(rng.randint(0, 60)))]
        for _ in range(rng.randint(0, 2)):
            p = rng.choice(passages)
            cut = rng.randint(0, len(p) // 2)
            parts += [p[cut : rng.randint(cut, len(p))], word()]
        rows.append((i, " ".join(parts), "en", "a"))
    rows += [(100, rows[3][1], "en", "a"), (101, rows[3][1], "en", "b"), (None, rows[4][1] + "x", "en", "b"), (102, "ab" * (2 * length), "en", "b"), (103, "z" * (length + 1), "en", "b")]
    rows += [(104, "q" * length, "en", "b"), (105, "y" * (length - 1), "en", "b"), (106, "y" * (length - 1), "en", "b")]
    check(spark, rows, length, block=block, bucket=bucket)


def test_odd_rows(spark):
    check(spark, [r for r in ODD if len(r[1] or "") < 10_000] + [(9, "word " * 900, "en", "a")], 20)
    assert suffixes.repeats(docs(spark, ODD).limit(0)).collect() == []
    assert suffixes.repeats(docs(spark, [(1, "short", "en", "a")])).first().n_removed == 0


def test_kept_bytes(spark):
    rows = [(1, "head one " + "shared passage of words " * 3 + "tail", "en", "a"), (2, "other " + "shared passage of words " * 3, "en", "a"), (3, None, "en", "a")]
    got = check(spark, rows, 30)
    held = docs(spark, rows).join(got, "doc_id").select("doc_id", suffixes.kept(F.col("text"), F.col("starts"), F.col("ends")).alias("kept"))
    want = {i: k for (i, *_), (*_, k) in zip(rows, brute([t for _, t, *_ in rows], 30), strict=True)}
    assert {r.doc_id: bytes(r.kept) for r in held.collect()} == want


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
def test_query_on_its_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()]
    got = sorted(str(tuple(r)) for r in suffixes.op12_suffixes(spark, DIR).collect())
    want = [str((i, n, r, len(s), hashlib.sha256(k).hexdigest())) for (i, _), (n, r, s, k) in zip(rows, brute([t for _, t in rows], 200), strict=True)]
    assert got == sorted(want)
