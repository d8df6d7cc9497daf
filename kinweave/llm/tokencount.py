"""Token counts under a unigram vocabulary, by dynamic programming over a trie.

The model: a vocabulary of pieces, each with a log score. A word's tokens are those of
its best-scored split into pieces; of equal scores the one with fewer tokens. Characters
that no piece covers cost one token for each UTF-8 byte, at a score below all pieces.

Words of a task go into a trie. A trie node stands for a prefix that words share; its
forward score, the best score of any split of the prefix, is computed once, when the node
is made, from the nodes above it. A word's count is stored at its last node.

Bounds. A worker's trie has at most ``NODES`` nodes; then it starts anew, which costs
time and not results. Words over ``LONG`` characters are scored outside the trie, in
memory linear in their length. The corpus is never gathered: counts are made in the scan.

Input cases. Null and empty texts have no words and no tokens. Words are what ASCII white
space separates. Repeated rows are mapped alike; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from kinweave.llm.common import arrow_map, table

NODES = 400_000
WORDS = 400_000
LONG = 64
MARK = "▁"  # stands before a word


class Unigram:
    """Piece -> log score."""

    def __init__(self, pieces: dict[str, float]):
        self.pieces = pieces
        self.floor = min(pieces.values(), default=0.0) - 10.0
        #: every ending of a piece: the score where the ending is a piece itself
        self.tails: dict[str, float | None] = {}
        for p in pieces:
            for k in range(1, len(p)):
                self.tails.setdefault(p[k:], None)
            self.tails[p] = pieces[p]
        self.clear()

    def clear(self) -> None:
        self.child: dict[tuple[int, str], int] = {}
        self.score: list[float] = [0.0]
        self.count: list[int] = [0]

    def step(self, word: str, j: int, path: list[int], score: list[float], count: list[int]) -> tuple[float, int]:
        """Forward score and count of word[:j]; ``path[i]`` is where those of word[:i] are."""
        at = path[j - 1]
        size = len(word[j - 1].encode("utf-8", "surrogatepass"))
        best, n = score[at] + size * self.floor, count[at] + size
        tails = self.tails
        for i in range(j - 1, -1, -1):
            s = tails.get(word[i:j], 0)
            if s is None:
                continue
            if s == 0:  # no piece ends so
                break
            at = path[i]
            s += score[at]
            if s > best or s == best and count[at] + 1 < n:
                best, n = s, count[at] + 1
        return best, n

    def tokens(self, word: str) -> int:
        """The number of tokens of one marked word."""
        if len(word) > LONG:
            score, count, path = [0.0], [0], list(range(len(word) + 1))
            for j in range(1, len(word) + 1):
                s, n = self.step(word, j, path, score, count)
                score.append(s)
                count.append(n)
            return count[-1]
        if len(self.score) > NODES:
            self.clear()
        child, score, count = self.child, self.score, self.count
        path, node = [0], 0
        for j, c in enumerate(word, 1):
            below = child.get((node, c))
            if below is None:
                s, n = self.step(word, j, path, score, count)
                below = child[node, c] = len(score)
                score.append(s)
                count.append(n)
            node = below
            path.append(node)
        return count[node]


class Counter(dict):
    """word (bytes) -> tokens, for words met so far; the older half goes when it is full."""

    def __init__(self, model: Unigram):
        self.model, self.old = model, {}

    def __missing__(self, word: bytes) -> int:
        if (n := self.old.get(word)) is None:
            n = self.model.tokens(MARK + word.decode("utf-8", "surrogatepass"))
        if len(word) <= LONG:
            if len(self) >= WORDS:
                self.old = dict(self)
                self.clear()
            self[word] = n
        return n

    def text(self, data: bytes | None) -> tuple[int, int]:
        words = (data or b"").split()
        return len(words), sum(map(self.__getitem__, words))


def zipf(pieces: list[str]) -> dict[str, float]:
    """Log scores for a vocabulary in order of frequency: the r-th piece has a share in proportion to 1 / (r + 1)."""
    total = sum(1 / (r + 2) for r in range(len(pieces)))
    return {p: -log((r + 2) * total) for r, p in enumerate(pieces)}


@cache
def counter(path: str) -> Counter:
    """One for each Python worker. ``path``: a sentencepiece model; its ordinary pieces are the vocabulary."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    return Counter(Unigram(zipf(plain)))


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_tokens for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for b in batches:
            rows = [own.text(t) for t in b.column(1).cast(pa.binary()).to_pylist()]
            words, tokens = zip(*rows, strict=True) if rows else ((), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], ["doc_id", "n_words", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    return arrow_map(docs.select(id_col, text_col), run, f"doc_id {kind}, n_words bigint, n_tokens bigint")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
