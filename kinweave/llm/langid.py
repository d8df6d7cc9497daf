"""Language identification with string kernels.

The kernel counts the character n-grams of 1 to 4 characters that two texts both have
(presence, not frequency), divided by the geometric mean of their numbers. N-grams are
hashed to ``DIMS`` places. A Nystrom map over landmark texts makes the kernel a finite
feature space, in which one ridge regression for each language, against the rest, is
solved. A text's scores are k(text, landmarks) A; since the kernel is linear in presence
vectors, landmarks times A is one matrix of DIMS x languages, and a batch of texts is
scored by one product of its presence matrix with it.

Training reads a bounded sample: about ``SAMPLE`` labelled rows in all, an equal part for
each language, chosen by a hash of id and text (so rows that repeat both count once), and
never more than twice as many; ``LANDMARKS`` of them are landmarks. Held-out rows (crc32 of
the id modulo 5 is 0) are never read for it. The driver holds the sample's places and a model
of ``DIMS`` x languages; more than ``LANGUAGES`` of them are an error, as the model is broadcast.

Input cases. Text that is null or has no letter gives ``und`` with score 0; so does any
text if no row is labelled. Whole texts are read, of any length. Repeated rows get the
same answer; a null id is neither held out nor learned from; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinweave.llm.common import arrow_map, bounded_batches, freed, table

DIMS = 1 << 17
ORDERS = 4
SAMPLE = 1600
LANDMARKS = 256
LANGUAGES = 500  # a model of 250 MB
UNKNOWN = "und"
RIDGE = 1e-3
SHARPNESS = 3.0
CHUNK = 1 << 20  # characters of a text hashed at once

_ASCII = np.array([c | 32 if chr(c).isalpha() else 32 for c in range(128)], np.uint32)
_LETTER = re.compile("[A-Za-z]")


def has_letter(text: str | None) -> bool:
    return bool(text) and (bool(_LETTER.search(text)) or any(map(str.isalpha, text)))


class Presence:
    """The places of the n-grams that a text has."""

    def __init__(self) -> None:
        self.flags = np.zeros(DIMS, bool)

    def __call__(self, text: str) -> np.ndarray:
        flags = self.flags
        for lo in range(0, len(text), CHUNK):
            codes = np.frombuffer(text[lo : lo + CHUNK + ORDERS - 1].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
            low = codes < 128
            codes = np.where(low, _ASCII[np.where(low, codes, 0)], codes)
            h = np.zeros(len(codes), np.uint32)
            for n in range(1, ORDERS + 1):
                if len(codes) < n:
                    break
                h = h[: len(codes) - n + 1] * np.uint32(0x01000193) + codes[n - 1 :] + np.uint32(n)
                flags[(h * np.uint32(0x9E3779B1)) >> np.uint32(32 - 17)] = True
        out = np.flatnonzero(flags)
        flags[out] = False
        return out


class Model(NamedTuple):
    languages: list[str]
    weights: np.ndarray  # DIMS x languages

    def scores(self, places: list[np.ndarray]) -> np.ndarray:
        """The batch's presence matrix times the weights: rows of ones at ``places``."""
        sizes = np.array([len(p) for p in places])
        sums = np.add.reduceat(self.weights[np.concatenate(places)], np.concatenate(([0], np.cumsum(sizes)[:-1])), axis=0)
        return sums / np.sqrt(sizes)[:, None]


def fit(places: list[np.ndarray], labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    languages = sorted(set(labels))
    y = np.where(np.array(labels)[:, None] == np.array(languages)[None, :], 1.0, -1.0)
    # landmarks: every language in turn, in the order of the sample
    turn: dict[str, int] = {}
    order = []
    for i, x in enumerate(labels):
        order.append((turn.setdefault(x, 0), i))
        turn[x] += 1
    chosen = [i for _, i in sorted(order)[:landmarks]]
    v = np.zeros((DIMS, len(chosen)), np.uint8)
    for k, i in enumerate(chosen):
        v[places[i], k] = 1
    norm = np.sqrt([len(p) for p in places])
    k_nm = np.array([v[p].sum(0, dtype=np.int64) for p in places]) / norm[:, None] / norm[chosen][None, :]
    values, vectors = np.linalg.eigh(k_nm[chosen])
    values = np.maximum(values, 1e-9)
    root = vectors / np.sqrt(values)[None, :] @ vectors.T
    phi = k_nm @ root
    w = np.linalg.solve(phi.T @ phi + ridge * len(places) * np.eye(len(chosen)), phi.T @ y)
    a = (root @ w) / norm[chosen][:, None]
    weights = np.zeros((DIMS, len(languages)), np.float32)
    for lo in range(0, DIMS, 1 << 14):
        weights[lo : lo + (1 << 14)] = v[lo : lo + (1 << 14)].astype(np.float64) @ a
    return Model(languages, weights)


def _held_out(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string")) % 5 == 0


def train(docs: DataFrame, sample: int = SAMPLE) -> Model | None:
    """From ``docs`` (doc_id, text, lang). The driver gets one row for each language, then the sample's places."""
    rows = docs.where(~_held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().limit(LANGUAGES + 1).collect()}
    if not counts:
        return None
    if len(counts) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    each = max(1, sample // len(counts))
    place = F.pmod(F.xxhash64(F.lit(5), F.col("doc_id").cast("string"), F.col("text")), F.lit(1 << 40))
    share = F.create_map(*[F.lit(x) for k, n in sorted(counts.items()) for x in (k, int((1 << 40) * min(1.0, each / n)))])
    picked = rows.select("lang", "text", place.alias("place")).where(F.col("place") < F.element_at(share, F.col("lang")))
    # what the driver takes has a bound: the window sees a language's sample only, and keeps its first rows
    order = F.row_number().over(Window.partitionBy("lang").orderBy("place"))
    picked = picked.groupBy("lang", "place").agg(F.first("text").alias("text")).withColumn("n", order).where(F.col("n") <= 2 * each).select("lang", "text", "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        presence = Presence()
        for b in batches:
            own = [presence(t).astype(np.int32).tobytes() if has_letter(t) else None for t in b.column(1).to_pylist()]
            out = pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(own, pa.binary())], ["lang", "place", "p"])
            yield out.filter(out.column(2).is_valid())

    got = sorted(arrow_map(picked, run, "lang string, place bigint, p binary").collect(), key=lambda r: (r["place"], r["lang"], bytes(r["p"])))
    if not got:
        return None
    model = fit([np.frombuffer(bytes(r["p"]), np.int32) for r in got], [r["lang"] for r in got])
    freed()
    return model


def predict(model: Model | None, texts: Iterable[str | None]) -> tuple[list[str], list[float]]:
    """Languages and scores; 256 texts make one product."""
    presence, lang, score, at, places = Presence(), [], [], [], []

    def flush() -> None:
        if at:
            f = SHARPNESS * model.scores(places)
            p = np.exp(f - f.max(1, keepdims=True))
            best = f.argmax(1)
            for i, k, s in zip(at, best, p[np.arange(len(at)), best] / p.sum(1), strict=True):
                lang[i], score[i] = model.languages[k], float(s)
        at.clear()
        places.clear()

    for i, t in enumerate(texts):
        lang.append(UNKNOWN)
        score.append(0.0)
        if model is not None and has_letter(t):
            at.append(i)
            places.append(presence(t))
            if len(at) == 256:
                flush()
    flush()
    return lang, score


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, score = predict(shared.value, (t.as_py() for t in b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    held = F.coalesce(_held_out(), F.lit(False)).alias("held_out")
    return arrow_map(docs.select("doc_id", "text", held), run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


#: how far above chance the best language's score has to be, as a part of the way to 1
ABOVE_CHANCE = 0.01


def least_score(model: Model) -> float:
    """Below it no language stands out: n languages that are all the same to a text have 1 / n each."""
    chance = 1 / len(model.languages)
    return chance + ABOVE_CHANCE * (1 - chance)


def accepted(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of ``docs`` in which a language is found, with their columns. No shuffle: rows are kept or dropped in the scan.

    A text goes if it is null or has no letter, or if its best language's score is below
    ``least_score``: it has next to no n-gram of any language that the model knows. With one
    language the score is 1 and rejects nothing. Without a model texts with a letter stay.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def kept(text: pd.Series) -> pd.Series:
        if shared.value is None:
            return pd.Series([has_letter(t) for t in text], dtype=bool)
        least = least_score(shared.value)
        return pd.Series([lang != UNKNOWN and score >= least for lang, score in zip(*predict(shared.value, text), strict=True)], dtype=bool)

    return docs.where(kept("text"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs))
