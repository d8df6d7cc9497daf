"""String similarities that Spark has no built-in for, as Arrow UDFs over pairs of columns.

The kernels are exact: Indel similarity from the longest common subsequence, Jaro-Winkler with the
prefix bonus above 0.7. Two empty strings are equal: ratio 100, Jaro 1; a token set ratio with an
empty side is 0. Pairs that repeat in a batch are compared once.

A batch is compared as a whole: one machine word for each pair, and numpy steps over the characters
of all pairs at once (``lcs_all``, ``jaro_winkler_all``). Strings of more than ``WORD`` characters
on the side that the word stands for are compared one pair at a time, by big integers and lists.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence."""
    if a == b:
        return len(a)
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    state = full
    for c in b:
        hit = state & where.get(c, 0)
        state = (state + hit | state - hit) & full
    return len(a) - state.bit_count()


def ratio(a: str, b: str) -> float:
    return 200.0 * lcs(a, b) / (len(a) + len(b)) if a or b else 100.0


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = x & y
    if both and (x <= y or y <= x):
        return 100.0
    common = " ".join(sorted(both))
    left = " ".join(filter(None, (common, " ".join(sorted(x - y)))))
    right = " ".join(filter(None, (common, " ".join(sorted(y - x)))))
    best = ratio(left, right)
    return max(best, ratio(common, left), ratio(common, right)) if common else best


def jaro_winkler(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    used = [False] * len(b)
    mine = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                mine.append(c)
                break
    m = len(mine)
    if not m:
        return 0.0
    swaps = sum(x != y for x, y in zip(mine, (c for c, u in zip(b, used, strict=True) if u), strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    if jaro <= 0.7:
        return jaro
    prefix = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro)


#: characters that a machine word stands for
WORD = 64
_ONE = np.uint64(1)
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
#: pairs compared at once, which bounds the table of match words
CHUNK = 4096


class _Codes:
    """Distinct strings of a batch: ``text`` (their characters numbered, padded with -1), ``size``, and match words: of each string and character the places where it stands."""

    def __init__(self, strings: Sequence[str]):
        self.size = np.array([len(s) for s in strings], np.int64)
        flat = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds, code = np.unique(flat, return_inverse=True)
        row = np.repeat(np.arange(len(strings)), self.size)
        place = np.arange(len(flat)) - np.repeat(np.cumsum(self.size) - self.size, self.size)
        self.text = np.full((len(strings), max(1, int(self.size.max(initial=0)))), -1, np.int64)
        self.text[row, place] = code
        self.words = np.zeros((len(strings), len(kinds) + 1), np.uint64)  # the last column is that of the padding
        fits = place < WORD
        np.bitwise_or.at(self.words, (row[fits], code[fits]), _ONE << place[fits].astype(np.uint64))


def _below(n: np.ndarray) -> np.ndarray:
    """Words with the lowest ``n`` bits set."""
    return np.where(n >= WORD, _FULL, (_ONE << np.minimum(n, WORD - 1).astype(np.uint64)) - _ONE)


def _distinct(a: Sequence[str], b: Sequence[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    known: dict[str, int] = {}
    x = np.fromiter((known.setdefault(s, len(known)) for s in a), np.int64, len(a))
    y = np.fromiter((known.setdefault(s, len(known)) for s in b), np.int64, len(b))
    return list(known), x, y


def lcs_all(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    """``lcs`` of each pair."""
    strings, x, y = _distinct(a, b)
    sizes = np.array([len(s) for s in strings], np.int64)
    x, y = np.where(sizes[x] <= sizes[y], x, y), np.where(sizes[x] <= sizes[y], y, x)  # the word stands for the shorter one
    out = np.zeros(len(x), np.int64)
    long = sizes[x] > WORD
    for i in np.flatnonzero(long):
        out[i] = lcs(strings[x[i]], strings[y[i]])
    todo = np.flatnonzero(~long & (sizes[x] > 0))
    todo = todo[np.argsort(-sizes[y[todo]], kind="stable")]  # those that still have characters stand first
    for lo in range(0, len(todo), CHUNK):
        at = todo[lo : lo + CHUNK]
        used, own = np.unique(np.concatenate([x[at], y[at]]), return_inverse=True)
        c = _Codes([strings[i] for i in used])
        p, q = own[: len(at)], own[len(at) :]
        left = np.searchsorted(-c.size[q], -np.arange(int(c.size[q].max())), side="left")
        state = np.full(len(at), _FULL)
        for j, n in enumerate(left.tolist()):
            s = state[:n]
            hit = s & c.words[p[:n], c.text[q[:n], j]]
            state[:n] = (s + hit) | (s - hit)
        out[at] = c.size[p] - np.bitwise_count(state & _below(c.size[p]))
    return out


def ratio_all(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    """``ratio`` of each pair."""
    total = np.array([len(s) + len(t) for s, t in zip(a, b, strict=True)], np.int64)
    return np.where(total > 0, 200.0 * lcs_all(a, b) / np.maximum(total, 1), 100.0)


def token_sort_all(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    order = {s: " ".join(sorted(s.split())) for s in {*a, *b}}
    return ratio_all([order[s] for s in a], [order[s] for s in b])


def token_set_all(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    """``token_set_ratio`` of each pair. What is common begins both sides, so only the rests are compared."""
    words = {s: frozenset(s.split()) for s in {*a, *b}}
    out, some = np.zeros(len(a)), []
    for i, (s, t) in enumerate(zip(a, b, strict=True)):
        x, y = words[s], words[t]
        if x and y:
            both = x & y
            if both and (len(both) == len(x) or len(both) == len(y)):
                out[i] = 100.0
            else:
                some.append((i, sum(map(len, both)) + len(both), " ".join(sorted(x - y)), " ".join(sorted(y - x))))
    if some:
        at, head = np.array([r[0] for r in some]), np.array([r[1] for r in some])  # the common words with a blank after each
        m, n = np.array([len(r[2]) for r in some]), np.array([len(r[3]) for r in some])
        best = 200.0 * (head + lcs_all([r[2] for r in some], [r[3] for r in some])) / (2 * head + m + n)
        common = np.maximum(head - 1, 0)
        out[at] = np.maximum(best, 200.0 * common / (common + head + np.minimum(m, n)))
    return out


def jaro_winkler_all(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    """``jaro_winkler`` of each pair."""
    strings, x, y = _distinct(a, b)
    sizes = np.array([len(s) for s in strings], np.int64)
    out = np.where(x == y, 1.0, 0.0)
    some = (x != y) & (sizes[x] > 0) & (sizes[y] > 0)
    long = some & (np.maximum(sizes[x], sizes[y]) > WORD)
    for i in np.flatnonzero(long):
        out[i] = jaro_winkler(strings[x[i]], strings[y[i]])
    todo = np.flatnonzero(some & ~long)
    todo = todo[np.argsort(-sizes[x[todo]], kind="stable")]
    for lo in range(0, len(todo), CHUNK):
        at = todo[lo : lo + CHUNK]
        used, own = np.unique(np.concatenate([x[at], y[at]]), return_inverse=True)
        c = _Codes([strings[i] for i in used])
        p, q = own[: len(at)], own[len(at) :]
        reach = np.maximum(0, np.maximum(c.size[p], c.size[q]) // 2 - 1)
        left = np.searchsorted(-c.size[p], -np.arange(int(c.size[p].max())), side="left")
        taken, mine = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)
        for i, n in enumerate(left.tolist()):
            r = reach[:n]
            window = _below(i + r + 1) & ~_below(np.maximum(0, i - r))
            hit = c.words[q[:n], c.text[p[:n], i]] & window & ~taken[:n]
            low = hit & (~hit + _ONE)  # the first free place
            taken[:n] |= low
            mine[:n] |= np.where(low > 0, _ONE << np.uint64(i), np.uint64(0))
        m = np.bitwise_count(mine).astype(np.int64)
        swaps, s, t = np.zeros(len(at), np.int64), mine.copy(), taken.copy()
        for _ in range(int(m.max(initial=0))):
            have = np.flatnonzero(s)
            one, two = s[have] & (~s[have] + _ONE), t[have] & (~t[have] + _ONE)
            swaps[have] += c.text[p[have], np.bitwise_count(one - _ONE)] != c.text[q[have], np.bitwise_count(two - _ONE)]
            s[have] ^= one
            t[have] ^= two
        k = np.maximum(m, 1)
        jaro = np.where(m > 0, (m / c.size[p] + m / c.size[q] + (m - swaps // 2) / k) / 3, 0.0)
        width = min(4, c.text.shape[1])
        same = (c.text[p, :width] == c.text[q, :width]) & (c.text[p, :width] >= 0)
        prefix = np.cumprod(same, axis=1).sum(1)
        out[at] = np.where(jaro > 0.7, jaro + prefix * 0.1 * (1 - jaro), jaro)
    return out


def _pairwise(kernel):
    @F.pandas_udf(DoubleType())
    def udf(a: pd.Series, b: pd.Series) -> pd.Series:
        pairs = pd.MultiIndex.from_arrays([a.fillna(""), b.fillna("")])
        place, distinct = pairs.factorize()  # a brand meets the same brand again and again: each pair of a batch is compared once
        return pd.Series(kernel(list(distinct.get_level_values(0)), list(distinct.get_level_values(1)))[place])

    return udf


ratio_udf = _pairwise(ratio_all)
token_sort_udf = _pairwise(token_sort_all)
token_set_udf = _pairwise(token_set_all)
jaro_winkler_udf = _pairwise(jaro_winkler_all)


#: letters' places in a string's marks: a to z have one each, other characters share the rest
KINDS = 32


def letter_marks(strings: Sequence[str], words: int) -> list[list[int]]:
    """Of each string with its words sorted the length, then ``words`` 64-bit words of marks.

    A kind of character that occurs n times sets the lowest n of its bits, so the bits that differ between two strings
    are at most the characters that one of them lacks, which is at most the Indel distance of their sorted words.
    """
    parts = [s.split() for s in strings]
    joined = ["".join(p) for p in parts]
    flat = np.frombuffer("".join(joined).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    row = np.repeat(np.arange(len(parts)), [len(j) for j in joined])
    kind = np.where((flat >= 97) & (flat <= 122), flat - 97, 26 + flat % (KINDS - 26))
    levels = 64 * words // KINDS
    n = np.minimum(np.bincount(row * KINDS + kind, minlength=len(parts) * KINDS).reshape(len(parts), words, KINDS // words), levels).astype(np.uint64)
    bits = ((_ONE << n) - _ONE) << (np.arange(KINDS // words, dtype=np.uint64) * np.uint64(levels))
    marks = np.bitwise_or.reduce(bits, axis=2).view(np.int64)
    size = [max(0, len(j) + len(p) - 1) for j, p in zip(joined, parts, strict=True)]
    return [[n, *m] for n, m in zip(size, marks.tolist(), strict=True)]


def letter_marks_udf(words: int):
    @F.pandas_udf("array<bigint>")
    def udf(a: pd.Series) -> pd.Series:
        return pd.Series(letter_marks(list(a.fillna("")), words), dtype=object)

    return udf
