"""BPE encoding and decoding by an automaton compiled from the merge list.

The automaton's states are "the last token read"; its arcs are tokens. It is built by one
gadget for each merge (u, v) -> w, in order of rank:

* wherever a path u v exists, an arc w is added beside it that ends in a *copy* of the
  state behind v (``right``: copy of which state, ``birth``: taken when);
* the state behind u loses its arc v (``cuts``: at which rank).

A copy shares its original's arcs as of the time of copying, so the compiled automaton is
as small as the merge list. It is flat arrays, made once by the driver and broadcast: the
transitions (trie state, byte) -> trie state of the labels, the label of each trie state,
and the gadgets. Arcs (state, token) are worked out from the gadgets when first met and
kept in a direct-mapped table. What it accepts is exactly the set of BPE tokenisations:
for every byte string there is one accepted path.

Encoding takes all new words of a batch at once. Trie transitions give every arc that the
bytes could take; then, from the first byte on, the state behind each byte is the one whose
arc leads there from a state already known. No place is visited twice and nothing is ever
taken back, so the walk is linear in the bytes times the labels that end at one byte.
Decoding emits the labels of the arcs.

Input cases. Null text counts as empty: no tokens, digests of the empty string. Any text
length works; texts are taken in slices of ``SLICE_CHARS`` characters in all, which bounds
a worker's memory by that or by one text. Repeated rows and ties don't matter, as each row
is mapped by itself; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm.common import arrow_map, freed, table

NEVER = 1 << 30
#: words that a worker keeps with their ids; beyond, it starts anew
CACHE_WORDS = 150_000
#: ids of those words, and of long words that have been met since
CACHE_IDS = 1_500_000
#: nor does it keep anything beside a word longer than this
CACHE_WORD_BYTES = 64
#: characters of the texts that are encoded together
SLICE_CHARS = 1 << 19
#: bytes of words that are walked together
WALK_BYTES = 1 << 20
#: places of the table of arcs
ARCS = 1 << 18

_U = np.uint64


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of the 256 bytes in byte-level vocabularies."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Flat:
    """A map of non-negative integers to int32, as an open-addressing table: lookups of whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.shift = 64 - max(4, (2 * len(keys) - 1).bit_length() if len(keys) else 4)
        size = 1 << (64 - self.shift)
        self.keys, self.values, self.mask = np.full(size, -1, np.int64), np.full(size, -1, np.int32), size - 1
        at = self._place(keys)
        left = np.arange(len(keys))
        while len(left):
            spots, first = np.unique(at[left], return_index=True)
            free = self.keys[spots] < 0
            won = left[first[free]]
            self.keys[at[won]], self.values[at[won]] = keys[won], values[won]
            rest = np.ones(len(keys), bool)
            rest[won] = False
            left = left[rest[left]]
            taken = self.keys[at[left]] >= 0
            at[left[taken]] = (at[left[taken]] + 1) & self.mask

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(_U) * _U(0x9E3779B97F4A7C15)) >> _U(self.shift)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The values, -1 for keys that aren't there."""
        at = self._place(keys)
        held = self.keys[at]
        out = np.where(held == keys, self.values[at], np.int32(-1))
        open_ = np.flatnonzero((held != keys) & (held >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & self.mask
            held = self.keys[at[open_]]
            hit = held == keys[open_]
            out[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (held >= 0)]
        return out


class MergeAutomaton:
    """See the module. ``vocab``: token (as bytes) to id; ``merges``: pairs of tokens, by rank."""

    def __init__(self, vocab: dict[bytes, int], merges: Sequence[tuple[bytes, bytes]]):
        top = max(vocab.values(), default=0) + 1
        self._gadgets(vocab, merges, top)
        #: of the ids that some path can have: the label, and the rank of the gadget that made the arc (-1: a byte)
        self.birth = {i: int(self.born[i]) for i in vocab.values() if self.born[i] < NEVER}
        self.label = {i: t for t, i in vocab.items() if i in self.birth}
        self._labels()
        self._forget()

    def _gadgets(self, vocab: dict[bytes, int], merges: Sequence[tuple[bytes, bytes]], top: int) -> None:
        left, right, birth, cuts = [-1] * top, [-1] * top, [NEVER] * top, {}
        for t, i in vocab.items():
            if len(t) == 1:
                birth[i] = -1

        def arc(u: int, v: int, time: int) -> bool:
            while True:
                if cuts.get((u, v), NEVER) < time:
                    return False
                if birth[u] > birth[v]:
                    time, u = birth[u], right[u]
                elif birth[v] >= 0:
                    time, v = birth[v] + 1, left[v]
                else:
                    return True

        for rank, (x, y) in enumerate(merges):
            u, v, w = vocab[x], vocab[y], vocab[x + y]
            if birth[u] == NEVER or birth[v] == NEVER or birth[w] < NEVER or not arc(u, v, rank):
                continue  # no path u v at this time: the gadget adds nothing
            left[w], right[w], birth[w], cuts[u, v] = u, v, rank, rank
        self.left, self.right, self.born = (np.array(x, np.int32) for x in (left, right, birth))
        self.cuts = Flat(np.array([u << 32 | v for u, v in cuts], np.int64), np.array(list(cuts.values()), np.int32))

    def _labels(self) -> None:
        labels = self.label
        nodes: dict[bytes, int] = {b"": 0}
        edges: dict[int, int] = {}
        of = {}
        for i, t in labels.items():
            for k in range(1, len(t) + 1):
                if t[:k] not in nodes:
                    nodes[t[:k]] = len(nodes)
                    edges[nodes[t[: k - 1]] << 8 | t[k - 1]] = nodes[t[:k]]
            of[nodes[t]] = i
        self.token = np.full(len(nodes), -1, np.int32)
        self.token[list(of)] = list(of.values())
        self.first = np.full(256, -1, np.int32)
        for b in range(256):
            self.first[b] = edges.get(b, -1)
        self.next = Flat(np.array(list(edges), np.int64), np.array(list(edges.values()), np.int32))
        self.longest = max(map(len, labels.values()), default=1)

    def _forget(self) -> None:
        self.arc_keys, self.arc_is = np.full(ARCS, -1, np.int64), np.zeros(ARCS, bool)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if not k.startswith("arc_") and k not in ("birth", "label")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._forget()

    def compiled(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Whether the states behind ``u`` have arcs ``v``, from the gadgets."""
        out, open_ = np.zeros(len(u), bool), np.arange(len(u))
        u, v, time = u.astype(np.int64), v.astype(np.int64), np.full(len(u), NEVER, np.int64)
        while len(open_):
            cut = self.cuts.get(u << 32 | v)
            lost = (cut >= 0) & (cut < time)
            bu, bv = self.born[u], self.born[v]
            done = ~lost & (bu <= bv) & (bv < 0)
            out[open_[done]] = True
            go = ~(lost | done)
            open_, u, v, bu, bv = open_[go], u[go], v[go], bu[go], bv[go]
            up = bu > bv  # the younger side is a copy or a gadget's arc: look at what it was made of
            time = np.where(up, bu, bv + 1).astype(np.int64)
            u, v = np.where(up, self.right[u], u), np.where(up, v, self.left[v])
        return out

    def arcs(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """The same by the table of arcs, which is filled on the way."""
        key = u.astype(np.int64) << 32 | v
        at = ((key.astype(_U) * _U(0x9E3779B97F4A7C15)) >> _U(64 - ARCS.bit_length() + 1)).astype(np.int64)
        new = np.flatnonzero(self.arc_keys[at] != key)
        out = self.arc_is[at]
        if len(new):
            out[new] = found = self.compiled(u[new], v[new])
            self.arc_keys[at[new]] = key[new]
            # places that two new arcs share keep the last one written: the same order for both arrays
            self.arc_is[at[new]] = found
        return out

    def arc(self, u: int, v: int) -> bool:
        return bool(self.arcs(np.array([u]), np.array([v]))[0])

    def walk(self, words: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, one after another, and how many each has."""
        size = np.array([len(w) for w in words], np.int64)
        if not len(size) or not size.sum():
            return np.zeros(0, np.int32), np.zeros(len(size), np.int64)
        data = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(size)
        base = ends - size
        word = np.repeat(np.arange(len(size)), size)
        # every arc that the bytes could take: (its first byte, its length, its token)
        at, node = np.arange(len(data)), self.first[data]
        found = []
        stop = ends[word]
        for k in range(1, self.longest + 1):
            ok = node >= 0
            at, node = at[ok], node[ok]
            token = self.token[node]
            hit = token >= 0
            found.append((at[hit], np.full(hit.sum(), k, np.int64), token[hit]))
            on = at + k < stop[at]
            at, node = at[on], node[on].astype(np.int64)
            if not len(at):
                break
            node = self.next.get(node << 8 | data[at + k])
        start, length, token = (np.concatenate(x) for x in zip(*found, strict=True))
        behind = start - base[word[start]] + length  # bytes of the word up to the arc's end
        order = np.argsort(behind, kind="stable")
        start, length, token, behind = start[order], length[order], token[order], behind[order]
        steps = np.searchsorted(behind, np.arange(1, size.max() + 2))
        # state, length of its arc and number of arcs, at the last byte of each arc; a word's first byte has no state before it
        state, back, count = np.full(len(data), -1, np.int32), np.zeros(len(data), np.int32), np.zeros(len(data), np.int32)
        begins = start == base[word[start]]
        for k in range(len(steps) - 1):
            own = slice(steps[k], steps[k + 1])
            s, n, t, from_start = start[own], length[own], token[own], begins[own]
            u = np.where(from_start, -1, state[s - 1])
            mid = np.flatnonzero(u >= 0)
            ok = from_start.copy()
            if len(mid):
                ok[mid] = self.arcs(u[mid], t[mid])
            # a whole label is its own path, other arcs from the start are only part of one if the rest accepts them
            e = (s + n - 1)[ok]
            state[e], back[e] = t[ok], n[ok]
            count[e] = np.where(from_start[ok], 1, count[np.maximum(s[ok] - 1, 0)] + 1)
        has = size > 0
        last = (ends - 1)[has]
        counts = np.zeros(len(size), np.int64)
        counts[has] = count[last]
        if not counts[has].all():
            raise ValueError("a byte has no token")
        into = (np.cumsum(counts) - 1)[has]
        out = np.empty(counts.sum(), np.int32)
        at, first = last, base[has]
        while len(at):
            out[into] = state[at]
            at = at - back[at]
            on = at >= first
            at, first, into = at[on], first[on], into[on] - 1
        return out, counts

    def encode(self, word: bytes) -> list[int]:
        return self.walk([word])[0].tolist()


#: how byte-level BPE splits a text into words, and the same over Latin blocks only, where `re` is twice as fast
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LATIN = 0x250


class Splitter:
    def __init__(self) -> None:
        kinds = {"L": "", "N": "", "S": ""}
        for c in map(chr, range(LATIN)):
            k = "S" if re.match(r"[\t-\r \x85\xa0]", c) else unicodedata.category(c)[0]
            if k in kinds:
                kinds[k] = kinds[k] + re.escape(c) if k != "S" or c in "\t\n\x0b\x0c\r \x85\xa0" else kinds[k]
        a, d, s = kinds["L"], kinds["N"], kinds["S"]
        self.latin = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{a}]+| ?[{d}]+| ?[^{s}{a}{d}]+|[{s}]+(?![^{s}])|[{s}]+")
        self.beyond = re.compile(f"[^\\x00-{chr(LATIN - 1)}]")
        self._wide = None

    def wide(self):
        """For other scripts. Code points newer than Python's tables have other classes in other libraries: those texts go through the tokenizer's own splitter."""
        if self._wide is None:
            import regex
            from tokenizers import pre_tokenizers

            runs: list[list[int]] = []
            for c in range(0x110000):
                if unicodedata.category(chr(c)) == "Cn":
                    if runs and runs[-1][1] == c - 1:
                        runs[-1][1] = c
                    else:
                        runs.append([c, c])
            unsure = re.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs) + "]")
            self._wide = regex.compile(SPLIT), unsure, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
        return self._wide

    def split(self, text: str) -> list[str]:
        if not self.beyond.search(text):
            return self.latin.findall(text)
        words, unsure, own = self.wide()
        if unsure.search(text):
            return [text[a:b] for _, (a, b) in own.pre_tokenize_str(text)]
        return words.findall(text)


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places starts[i], starts[i] + 1, ... of all runs, one run after another."""
    return np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


class _Words(dict):
    """word -> its number. New words wait in ``new`` until ``settle`` walks them all at once."""

    def __init__(self, automaton: MergeAutomaton):
        self.automaton = automaton
        self.start()

    def start(self) -> None:
        self.clear()
        self.new: list[str] = []
        self.long: list[str] = []
        self.count = 0
        self.ids, self.begin, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        self[word] = n = self.count
        self.count += 1
        return n

    def settle(self) -> None:
        if not self.new:
            return
        parts, sizes = [self.ids], [self.size]
        raw = list(map(str.encode, self.new))
        upto = np.cumsum(list(map(len, raw)))
        self.long += [w for w, b in zip(self.new, raw, strict=True) if len(b) > CACHE_WORD_BYTES]
        lo = 0
        while lo < len(raw):
            hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + WALK_BYTES, "right")))
            ids, n = self.automaton.walk(raw[lo:hi])
            parts.append(ids)
            sizes.append(n)
            lo = hi
        self.ids, self.size = np.concatenate(parts), np.concatenate(sizes)
        self.begin = np.cumsum(self.size) - self.size
        self.new = []

    def bound(self) -> None:
        """Forget long words, which rarely come again; start anew beyond the limits, which count them as well."""
        for word in self.long:
            del self[word]
        self.long = []
        if self.count > CACHE_WORDS or len(self.ids) > CACHE_IDS:
            self.start()


class Codec:
    """Encoding and decoding of whole texts with a vocabulary file of the tokenizers library (byte-level BPE)."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        alphabet = byte_alphabet()
        raw = lambda t: bytes(map(alphabet.__getitem__, t))
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        vocab = {raw(t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        self.automaton = MergeAutomaton(vocab, [(raw(a), raw(b)) for a, b in pairs])
        label = {i: t for t, i in vocab.items()} | {i: t.encode() for t, i in self.special.items()}
        self.label = [label.get(i, b"") for i in range(max(label) + 1)]
        self._ready()

    def _ready(self) -> None:
        self._special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.splitter, self.words = Splitter(), _Words(self.automaton)
        # an id's label, and its decimal digits before a comma: what ids spell is one ``take``
        self.labels = pa.array(self.label, pa.large_binary())
        self.digits = pa.array([b"%d," % i for i in range(len(self.label))], pa.large_binary())

    def __getstate__(self):
        return self.automaton, self.special, self.label

    def __setstate__(self, state):
        self.automaton, self.special, self.label = state
        self._ready()

    def _numbers(self, text: str) -> np.ndarray:
        """The text's words by number; special tokens are negative: -1 - id."""
        number, split = self.words.__getitem__, self.splitter.split
        if self._special is None or not self._special.search(text):
            words = split(text)
            return np.fromiter(map(number, words), np.int64, len(words))
        out: list[int] = []
        for part in self._special.split(text):
            if part in self.special:
                out.append(-1 - self.special[part])
            elif part:
                out += map(number, split(part))
        return np.array(out, np.int64)

    def encode_all(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and where each text's end."""
        words = self.words
        found = [self._numbers(t) for t in texts]
        words.settle()
        n = np.array([len(x) for x in found], np.int64)
        at = np.concatenate([*found, np.zeros(0, np.int64)])
        plain = at >= 0
        size = np.ones(len(at), np.int64)
        size[plain] = words.size[at[plain]]
        if plain.all():
            ids = words.ids[_spread(words.begin[at], size)]
        else:
            pool = np.concatenate([words.ids, (-1 - at[~plain]).astype(np.int32)])
            begin = np.empty(len(at), np.int64)
            begin[plain] = words.begin[at[plain]]
            begin[~plain] = len(words.ids) + np.arange((~plain).sum())
            ids = pool[_spread(begin, size)]
        upto = np.concatenate(([0], np.cumsum(size)))
        words.bound()
        return ids, upto[np.cumsum(n)]

    def encode(self, text: str | None) -> list[int]:
        return self.encode_all([text or ""])[0].tolist()

    def decode(self, ids: Sequence[int]) -> str:
        return b"".join(map(self.label.__getitem__, ids)).decode("utf-8", "replace")

    def _spelt(self, ids: np.ndarray, with_: pa.Array) -> tuple[memoryview, np.ndarray]:
        """What the ids spell, and where each one's part begins (one more place at the end)."""
        out = with_.take(pa.array(ids, pa.int32()))
        offsets = np.frombuffer(out.buffers()[1], np.int64)[: len(ids) + 1]
        return memoryview(out.buffers()[2] or b""), offsets

    def digests(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, list[str], list[str]]:
        """The ids of all texts, where each text's end, SHA-256 of the ids, SHA-256 of the decoded text."""
        ids, ends = self.encode_all(texts)
        listed, li = self._spelt(ids, self.digits)
        spelt, si = self._spelt(ids, self.labels)
        sha, decoded, a = [], [], 0
        for b in ends.tolist():
            sha.append(hashlib.sha256(listed[li[a] : max(li[a], li[b] - 1)]).hexdigest())
            text = spelt[si[a] : si[b]]
            try:
                str(text, "utf-8")
            except UnicodeDecodeError:
                text = str(text, "utf-8", "replace").encode()
            decoded.append(hashlib.sha256(text).hexdigest())
            a = b
        return ids, ends, sha, decoded


@cache
def codec(path: str) -> Codec:
    """Compiled once in a process: by the driver, which sends its flat arrays to the workers."""
    out = Codec(path)
    freed()
    return out


def slices(sizes: Sequence[int], most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows that have ``most`` characters at most, or one row."""
    lo, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > most:
            yield lo, i
            lo, held = i, 0
        held += n
    if lo < len(sizes):
        yield lo, len(sizes)


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """n_tokens, ids_sha256 and decoded_sha256 for every row, and the ids themselves if wanted; no shuffle, a task holds one Arrow batch."""
    fields = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: 4 + ids]
    shared = docs.sparkSession.sparkContext.broadcast(codec(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for whole in batches:
            sizes = whole.column(2).to_pylist()
            for lo, hi in slices(sizes, SLICE_CHARS):
                b = whole.slice(lo, hi - lo)
                flat, ends, sha, decoded = own.digests([t or "" for t in b.column(1).to_pylist()])
                offsets = np.concatenate(([0], ends))
                out = [b.column(0), pa.array(np.diff(offsets), pa.int64()), pa.array(sha, pa.string()), pa.array(decoded, pa.string())]
                if ids:
                    out.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32())))
                yield pa.RecordBatch.from_arrays(out, fields)

    kinds = [docs.schema[id_col].dataType.simpleString(), "bigint", "string", "string", "array<int>"]
    size = F.coalesce(F.length(text_col), F.lit(0)).alias("size")
    return arrow_map(docs.select(id_col, text_col, size), run, ", ".join(map(" ".join, zip(fields, kinds, strict=False))))


def encoded(docs: DataFrame, path: str, text_col: str = "text", out: str = "ids") -> DataFrame:
    """All columns of ``docs`` and the ids of the text as array<int> (empty for null)."""
    from pyspark.sql.types import ArrayType, IntegerType

    shared = docs.sparkSession.sparkContext.broadcast(codec(path))

    @F.pandas_udf(ArrayType(IntegerType()))
    def ids(text):
        return text.map(shared.value.encode)

    return docs.withColumn(out, ids(F.coalesce(F.col(text_col), F.lit(""))))


def decoded(tokens: DataFrame, path: str, ids_col: str = "ids", out: str = "text") -> DataFrame:
    """All columns of ``tokens`` and the text that its ids spell (null ids: empty)."""
    shared = tokens.sparkSession.sparkContext.broadcast(codec(path))

    @F.pandas_udf("string")
    def text(ids):
        return ids.map(lambda x: "" if x is None else shared.value.decode(list(x)))

    return tokens.withColumn(out, text(F.col(ids_col)))


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), vocabulary())
