import random
import re

from kinweave.llm import mixing

from .helpers import ODD, docs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def water(sizes, weights, share=1.5, cap=2.0):
    """Targets by bisection on the level."""
    total = share * sum(sizes)
    lo, hi = 0.0, cap * max(sizes + [1]) / min(weights)
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(cap * s, mid * w) for s, w in zip(sizes, weights)) < total else (lo, mid)
    return [min(cap * s, lo * w) for s, w in zip(sizes, weights)]


def check(spark, rows):
    got = mixing.mix(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    size = lambda t: len(WORD.findall(t or ""))
    assert sorted((r.doc_id or -1, r.size) for r in got) == sorted((i or -1, size(t)) for i, t, *_ in rows)
    names = sorted({s for *_, s in rows if s is not None}) + [None] * any(s is None for *_, s in rows)
    sizes = [sum(size(t) for _, t, _, s in rows if s == n) for n in names]
    want = water(sizes, [(5, 2, 1)[i % 3] for i in range(len(names))])
    for n, s, w in zip(names, sizes, want):
        mine = [r for r in got if r.source == n]
        assert all(r.source_size == s and abs(r.target - w) < 1e-6 * (1 + w) for r in mine)
        assert abs(sum(r.taken for r in mine) - w) <= 1
        assert all(0 <= r.taken <= 2 * r.size for r in mine)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs(spark, rows)).collect()))


def test_odd_rows(spark):
    check(spark, ODD)
    assert mixing.mix(docs(spark, ODD).limit(0)).collect() == []


def test_many(spark):
    random.seed(5)
    check(spark, [(i, "w " * random.choice([0, 1, 7, 300]), "en", random.choice("aaaaabcdefgZ")) for i in range(400)])


def test_documents(spark):
    rows = [(i, f"a{i} b c d e f g", "en", "xyz"[i % 3]) for i in range(30)]
    d = docs(spark, rows)
    taken = {r.doc_id: r.taken for r in mixing.mix(d).collect()}
    out = mixing.mixed_documents(d)
    assert out.columns == d.columns
    words = {}
    for r in out.collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + len(r.text.split())
        assert dict((i, t) for i, t, *_ in rows)[r.doc_id].startswith(r.text)
    assert words == {k: v for k, v in taken.items() if v}


def test_the_order_is_that_of_the_schedule(spark):
    rows = [(i, "w " * 40, "en", "xyz"[i % 3]) for i in range(300)]
    d = docs(spark, rows)
    out = mixing.mixed_documents(d, order="place")
    assert out.columns == [*d.columns, "place"]
    got = sorted(out.collect(), key=lambda r: r.place)
    assert len(got) > 300 and all(r.place for r in got)
    share = {s: sum(r.source == s for r in got) / len(got) for s in "xyz"}
    for n in (len(got) // 4, len(got) // 2):  # any leading part has the shares of the whole
        assert all(abs(sum(r.source == s for r in got[:n]) / n - share[s]) < 0.1 for s in "xyz")
    for r in mixing.mix(d).collect():
        assert len(r.slots or []) == -(-r.taken // r.size)
        assert all(0 <= p.slot for p in r.slots or [])


def test_documents_of_repeated_and_null_ids(spark):
    rows = [(i // 2 if i % 5 else None, f"a{i} " * (3 + i % 4), "en", "xyz"[i % 3]) for i in range(40)] + [(7, "same text", "en", "x")] * 3
    d = docs(spark, rows)
    want = sum(r.taken for r in mixing.mix(d).collect())
    out = mixing.mixed_documents(d, order="place").collect()
    assert sum(len(r.text.split()) for r in out) == want and all(r.place for r in out)
    each = {}
    for r in mixing.mix(d).collect():
        each[r.doc_id, r.digest] = each.get((r.doc_id, r.digest), 0) + r.taken
    digest = {(r.doc_id, r.text.split()[0]): r.digest for r in d.selectExpr("doc_id", "text", "xxhash64(text) digest").collect()}
    got = {}
    for r in out:
        k = r.doc_id, digest[r.doc_id, r.text.split()[0]]
        got[k] = got.get(k, 0) + len(r.text.split())
    assert got == {k: v for k, v in each.items() if v}


def brute_schedule(spark, rows):
    """Slot by slot: the point's bits in reverse, the source that holds it, that source's next block, word by word."""
    d = docs(spark, rows).selectExpr("doc_id", "source", "text", "xxhash64(7, cast(doc_id as string)) h").collect()
    size = [len(WORD.findall(r.text or "")) for r in d]
    names = sorted({r.source for r in d if r.source is not None}) + [None] * any(r.source is None for r in d)
    want = water([sum(n for n, r in zip(size, d) if r.source == s) for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))])
    block = min(mixing.BLOCK_WORDS, max(1, int(sum(want)) // mixing.MIN_SLOTS))
    lines, points = [], []
    for s, w in zip(names, want):
        own = sorted((i for i, r in enumerate(d) if r.source == s and size[i]), key=lambda i: d[i].h)
        line = [(d[i].doc_id, k) for i in own for k in range(size[i])]
        take = min(round(w), 2 * len(line))
        n = max(1, round(take / block)) if take else 0
        lines.append([line[x % len(line)] for x in range(take)])
        points += [len(lines) - 1] * n
    bits = max(1, (len(points) - 1).bit_length())
    rank, out = [0] * len(names), []
    for slot in range(1 << bits):
        p = int(f"{slot:0{bits}b}"[::-1], 2)
        if p < len(points):
            s = points[p]
            lo = rank[s] * block
            rank[s] += 1
            hi = lo + block if rank[s] < points.count(s) else len(lines[s])
            out += [(slot, names[s], *w) for w in lines[s][lo:hi]]
    return out


def words_of(schedule):
    return sorted((r.slot, r.source or "", r.doc_id, k) for r in schedule.collect() for k in range(r.begin, r.stop))


def test_the_schedule_is_that_of_brute_force(spark, monkeypatch):
    random.seed(8)
    rows = [(i, "w " * random.choice([0, 1, 7, 30]), "en", random.choice(["a", "a", "b", "c", None])) for i in range(60)]
    for least, most in ((1 << 17, 256), (40, 256), (1, 100)):
        monkeypatch.setattr(mixing, "MIN_SLOTS", least)
        monkeypatch.setattr(mixing, "BLOCK_WORDS", most)
        want = sorted((s, n or "", i, k) for s, n, i, k in brute_schedule(spark, rows))
        assert words_of(mixing.schedule(docs(spark, rows))) == want


def test_without_the_bit_reversal_the_mix_is_another(spark, monkeypatch):
    rows = [(i, f"a{i} " * 20, "en", "xyz"[i % 3]) for i in range(60)]
    mixed = lambda: [r.doc_id for r in mixing.mixed_documents(docs(spark, rows)).collect()]
    slots = lambda: sorted((r.doc_id, str(r.slots)) for r in mixing.mix(docs(spark, rows)).collect())
    a, b = mixed(), slots()
    monkeypatch.setattr(mixing, "van_der_corput", lambda i, bits: i)
    assert mixed() != a and slots() != b


def test_documents_come_in_the_order_of_the_slots(spark):
    rows = [(i, f"a{i} b c d e f g", "en", "xyz"[i % 3]) for i in range(50)]
    d = docs(spark, rows)
    got = [(r.doc_id, r.place) for r in mixing.mixed_documents(d, order="place").collect()]
    assert got == sorted(got, key=lambda x: x[1])
    want = sorted(((s.slot, s.at), r.doc_id) for r in mixing.mix(d).collect() for s in r.slots or [])
    assert [i for i, _ in got] == [i for _, i in want]
