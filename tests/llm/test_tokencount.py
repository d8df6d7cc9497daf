import random

import public_tokenizers
from tokenizers import models

from kinweave.llm import tokencount as T

from .helpers import ODD, docs

PATH = public_tokenizers.path("piece_bpe_32k.model")


def viterbi(model, word):
    best = [(0.0, 0)]
    for j in range(1, len(word) + 1):
        n = len(word[j - 1].encode())
        found = [(best[j - 1][0] + n * model.floor, best[j - 1][1] + n)]
        for i in range(j):
            if (s := model.pieces.get(word[i:j])) is not None:
                found.append((best[i][0] + s, best[i][1] + 1))
        best.append(max(found, key=lambda x: (x[0], -x[1])))
    return best[-1][1]


def test_words_are_counted_as_without_a_trie():
    own = T.counter(PATH)
    random.seed(1)
    for _ in range(1500):
        w = "".join(random.choices("abcdeinorstéß漢🙂-1", k=random.randint(1, 14)))
        assert own[w.encode()] == viterbi(own.model, T.MARK + w)
    for w in ("a" * 300, "漢" * 100):
        assert own[w.encode()] == viterbi(own.model, T.MARK + w)


def test_counts_are_those_of_the_library():
    own = T.counter(PATH)
    other = models.Unigram([("<unk>", -100.0), *own.model.pieces.items()], 0, False)
    random.seed(2)
    for _ in range(2000):
        w = "".join(random.choices("abcdefghijklmnopqrstuvwxyz", k=random.randint(1, 12)))
        assert own[w.encode()] == len(other.tokenize(T.MARK + w))


def test_bounds_do_not_change_results(monkeypatch):
    words = ["".join(random.choices("abcd", k=6)) for _ in range(500)]
    plain = T.Counter(T.counter(PATH).model)
    want = [plain[w.encode()] for w in words]
    monkeypatch.setattr(T, "NODES", 50)
    monkeypatch.setattr(T, "WORDS", 20)
    small = T.Counter(T.Unigram(plain.model.pieces))
    assert [small[w.encode()] for w in words] == want


def test_table(spark):
    got = {r.doc_id: (r.n_words, r.n_tokens) for r in T.token_counts(docs(spark, ODD), PATH).collect()}
    own = T.counter(PATH)
    for i, t, *_ in ODD:
        words = (t or "").split()
        assert got[i] == (len(words), sum(viterbi(own.model, T.MARK + w) for w in words) if len(words) < 100 else 30_000 * viterbi(own.model, T.MARK + "word"))
    assert T.token_counts(docs(spark, ODD).limit(0), PATH).collect() == []
