"""Personal data: regular expressions propose spans, checksums confirm, context adjusts the score.

Base spans (email, ip, card, phone) always stay; their rules are in ``base_spans``. The
method adds spans of other shapes when their score reaches ``THRESHOLD``:

* ``iban``: country, check digits and account, confirmed by mod-97 (0.9); a candidate that
  fails is tried again without its last words, as the pattern may have taken in what follows;
* ``card``: 13 to 15 digits that pass Luhn (0.4), only beside a word like "card" (+0.3);
* ``phone``: national numbers of 9 to 11 digits in groups (0.3), only beside a word like "phone" (+0.4);
* ``ssn``: 3-2-4 digits (0.4), only beside a word like "ssn" (+0.4).

An added span that touches a base span, or an earlier added one, is dropped.

All scans are linear in the text: addresses are sought from their ``@``, and a run of
digits is tried at its first digit only, which finds the same leftmost matches.

Input cases. Null text counts as empty: no spans. Positions are code points, end
exclusive. Repeated rows are mapped alike; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from kinweave.llm.common import arrow_map, table

KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE = KINDS[:4]
THRESHOLD = 0.6
NEAR = 40  # characters before and after a span in which context words count

DIGIT = re.compile("[0-9]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
NATIONAL = re.compile(r"(?<![0-9+(.-])\(?[0-9]{2,4}\)?[ .-][0-9]{2,4}(?:[ .-][0-9]{2,4}){1,3}(?![0-9.-])")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
# fixed values: words that support a kind
CONTEXT = {
    "card": re.compile(r"\b(?:card|visa|mastercard|amex|credit|debit|carte|tarjeta|karte)\b", re.I),
    "phone": re.compile(r"\b(?:phone|tel|telephone|call|mobile|fax|telefon|teléfono|téléphone)\b", re.I),
    "ssn": re.compile(r"\b(?:ssn|social security)\b", re.I),
    "iban": re.compile(r"\b(?:iban|account|konto|compte|cuenta)\b", re.I),
}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    s = iban.replace(" ", "")
    rest = 0
    for c in s[4:] + s[:4]:
        v = int(c, 36)
        rest = (rest * (100 if v > 9 else 10) + v) % 97
    return 15 <= len(s) <= 34 and rest == 1


def ibans(text: str) -> list[tuple[int, int]]:
    """The longest valid prefix of each candidate that ends with a word; the search goes on behind it, or at the next word if none is valid."""
    out, m = [], IBAN.search(text)
    while m:
        start, end = m.span()
        while end > start and not mod97(text[start:end]):
            end = max(start, text.rfind(" ", start, end))
        if end > start:
            out.append((start, end))
        m = IBAN.search(text, end if end > start else start + 1)
    return out


def _digits(s: str) -> str:
    return "".join([c for c in s if "0" <= c <= "9"])


def emails(text: str) -> list[tuple[int, int]]:
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL_CHARS:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            done = m.end()
        else:
            done = max(done, at)  # what lies before this sign was tried
        at = text.find("@", max(at + 1, done))
    return out


def _octet(s: str) -> bool:
    s = s.lstrip("0")
    return len(s) <= 3 and int(s or 0) <= 255


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in BASE}
    if "@" in text:
        out["email"] = emails(text)
    out["ip"] = [m.span() for m in IP.finditer(text) if all(map(_octet, m[0].split(".")))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out["card"].append(m.span())
    if "+" in text:
        out["phone"] = [m.span() for m in PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return out


class _Taken:
    """What base spans and added ones cover. The former may overlap, as kinds are found apart, so they are united."""

    def __init__(self, spans):
        self.starts, self.ends = [], []
        for a, b in sorted(spans):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)
        self.more: dict[int, list[tuple[int, int]]] = {}

    def take(self, a: int, b: int) -> bool:
        """Whether a to b was free; it is taken then."""
        i = bisect_left(self.starts, b) - 1  # the last base span that begins before b
        if i >= 0 and self.ends[i] > a:
            return False
        cells = range(a >> 8, (b - 1 >> 8) + 1)
        if any(a < y and x < b for c in cells for x, y in self.more.get(c, ())):
            return False
        for c in cells:
            self.more.setdefault(c, []).append((a, b))
        return True


def added_spans(text: str, base: dict[str, list[tuple[int, int]]]) -> dict[str, list[tuple[int, int]]]:
    proposed: list[tuple[str, int, int, float]] = []
    for span in ibans(text):
        proposed.append(("iban", *span, 0.9))
    for m in SSN.finditer(text):
        if m[0][:3] not in ("000", "666") and m[0][0] != "9":
            proposed.append(("ssn", *m.span(), 0.4))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m[0])) <= 15 and luhn(d):
            proposed.append(("card", *m.span(), 0.4))
    for m in NATIONAL.finditer(text):
        if 9 <= len(_digits(m[0])) <= 11:
            proposed.append(("phone", *m.span(), 0.3))
    out: dict[str, list[tuple[int, int]]] = {}
    taken = _Taken(s for spans in base.values() for s in spans)
    for kind, a, b, score in proposed:
        around = text[max(0, a - NEAR) : a] + " " + text[b : b + NEAR]
        if CONTEXT[kind].search(around):
            score += {"card": 0.3, "phone": 0.4, "ssn": 0.4, "iban": 0.1}[kind]
        if score >= THRESHOLD and taken.take(a, b):
            out.setdefault(kind, []).append((a, b))
    return out


def _join(spans: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in kinds for a, b in sorted(spans.get(k, ())))


def find(text: str | None) -> tuple[int, int, int, int, str, str]:
    """The four counts of base spans, the digest of the base spans, all spans."""
    text = text or ""
    base = base_spans(text)
    spans = dict(base)
    if DIGIT.search(text):
        for k, more in added_spans(text, base).items():
            spans[k] = spans.get(k, []) + more
    digest = hashlib.sha256(_join(base, BASE).encode()).hexdigest()
    return *(len(base[k]) for k in BASE), digest, _join(spans, KINDS)


def pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    kinds = [pa.int64()] * 4 + [pa.string()] * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = list(zip(*(find(t.as_py()) for t in b.column(1)), strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names)

    kind = docs.schema[id_col].dataType.simpleString()
    return arrow_map(docs.select(id_col, text_col), run, f"doc_id {kind}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string")


def masked(docs: DataFrame, text_col: str = "text", out: str = "masked") -> DataFrame:
    """All columns of ``docs`` and the text with each span replaced by its kind in angle brackets."""
    from pyspark.sql import functions as F

    @F.pandas_udf("string")
    def mask(text):
        def one(t):
            if t is None:
                return None
            spans = [(int(a), int(b), k) for k, a, b in (s.split(":") for s in find(t)[5].split(",") if s)]
            done, parts = 0, []
            for a, b, k in sorted(spans):
                if a < done:
                    continue
                parts += [t[done:a], f"<{k}>"]
                done = b
            return "".join([*parts, t[done:]])

        return text.map(one)

    return docs.withColumn(out, mask(F.col(text_col)))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii(table(spark, sf_dir, "documents"))
