import hashlib
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from kinweave.llm import bpe

from .helpers import ODD, docs

PATH = bpe.vocabulary()
LIBRARY = Tokenizer.from_file(PATH)
CODEC = bpe.codec(PATH)


def library(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text_is_encoded_as_by_the_library(text):
    assert CODEC.encode(text) == library(text)
    assert CODEC.decode(CODEC.encode(text)) == text


def test_awkward_pieces():
    random.seed(1)
    bits = ["a", "b", "e", "r", " ", "  ", "\n", "1", "-", "=", "é", "漢", "🙂", "'s", "'", "the", "\t", "\u0085", "\x1c", "<|endoftext|>", "\u0558", "\u3000", "_", "ing", "aaaa", "----"]
    for _ in range(3000):
        t = "".join(random.choices(bits, k=random.randint(0, 25)))
        assert CODEC.encode(t) == library(t), t


def test_long_words():
    for t in ("a" * 20_000, "-" * 20_000, " " * 20_000, "ab" * 10_000, "é" * 5_000):
        assert CODEC.encode(t) == library(t)


def test_arcs_are_the_valid_pairs():
    """The automaton has an arc u v exactly if the library encodes the two labels' bytes as u v."""
    a = CODEC.automaton
    random.seed(4)
    ids = sorted(a.birth)
    for _ in range(4000):
        u, v = random.choice(ids[:3000]), random.choice(ids[:3000])
        assert a.arc(u, v) == (a.encode(a.label[u] + a.label[v]) == [u, v])


def test_overlapping_merges():
    a = bpe.MergeAutomaton({b"a": 0, b"aa": 1, b"aaaa": 2}, [(b"a", b"a"), (b"aa", b"aa")])
    assert [a.encode(b"a" * n) for n in range(1, 8)] == [[0], [1], [1, 0], [2], [2, 0], [2, 1], [2, 1, 0]]


def test_table(spark):
    rows = bpe.digests(docs(spark, ODD), PATH, ids=True).collect()
    assert len(rows) == len(ODD)
    want = {(i, t or "") for i, t, *_ in ODD}
    for r in rows:
        text = next(t for i, t in want if i == r.doc_id)
        ids = library(text)
        assert (r.n_tokens, r.ids) == (len(ids), ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.digests(docs(spark, ODD).limit(0), PATH).collect() == []
    back = bpe.decoded(bpe.encoded(docs(spark, ODD), PATH), PATH, out="again").collect()
    assert all(r.again == (r.text or "") for r in back)


def test_the_walk_goes_by_the_compiled_tables(monkeypatch):
    a = bpe.MergeAutomaton({b"a": 0, b"b": 1, b"c": 2, b"ab": 3, b"bc": 4}, [(b"a", b"b"), (b"b", b"c")])
    assert a.encode(b"abc") == [3, 2] and a.arc(3, 2) and not a.arc(0, 4) and not a.arc(0, 1)
    a.cuts = bpe.Flat(np.zeros(0, np.int64), np.zeros(0, np.int32))
    a._forget()
    assert a.arc(0, 1) and a.encode(b"abc") != [3, 2]  # without the gadgets' cuts other paths are accepted


def test_flat_maps():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 40, 5000))
    m = bpe.Flat(keys, np.arange(len(keys), dtype=np.int32))
    assert (m.get(keys) == np.arange(len(keys))).all()
    other = rng.integers(1 << 41, 1 << 42, 5000)
    assert (m.get(other) == -1).all()


def test_bounds_and_slices_do_not_change_results(monkeypatch):
    random.seed(5)
    texts = [" ".join("".join(random.choices("abcdefé漢", k=random.randint(1, 9))) for _ in range(random.randint(0, 60))) + random.choice(["", "<|endoftext|> x", "z" * 80]) for _ in range(60)]
    for words, chars in ((30_000, 1 << 19), (5, 200), (1, 1)):
        monkeypatch.setattr(bpe, "CACHE_WORDS", words)
        monkeypatch.setattr(bpe, "WALK_BYTES", chars)
        own, got = bpe.Codec(PATH), []
        for lo, hi in bpe.slices(list(map(len, texts)), chars):
            ids, ends, _, _ = own.digests(texts[lo:hi])
            got += [x.tolist() for x in np.split(ids, ends[:-1])]
        assert got == list(map(library, texts))


def test_long_words_leave_the_table_and_the_others_stay(monkeypatch):
    own = bpe.Codec(PATH)
    texts = ["plain words here", "x" * 200 + " and more plain words " + "y" * 90, "plain words here again"]
    sizes = []
    for t in texts:
        assert own.encode(t) == library(t)
        sizes.append(len(own.words))
    assert sizes == [3, 6, 7] and not any(len(w) > bpe.CACHE_WORD_BYTES for w in own.words)
    monkeypatch.setattr(bpe, "CACHE_IDS", 20)
    assert own.encode("z" * 300) == library("z" * 300) and len(own.words) == 0  # their ids are bounded too
    assert [own.encode(t) for t in texts] == [library(t) for t in texts]
