import hashlib
import itertools
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kinweave.llm import repair

SCHEMA = "conv_id bigint, turn bigint, role string, text string, n int, audit string, conv string"
SPACES = " \t\n\x0b\f\r"


def cheapest(rows):
    """By all edit strings: rows are (role, text, fault). Only for a few rows."""
    options = []
    for role, text, fault in rows:
        more = 5 if fault == "t" else 0
        o = [(2, "D", None)]
        if fault not in ("b", "d"):
            o += [(more, "K", (role, text)), (1 + more, "R", ("user", text)), (1 + more, "R", ("assistant", text))]
        options.append(o)
    inserts = [list(itertools.product(["user", "assistant"], repeat=k)) for k in range(3)]
    best = None
    for edits in itertools.product(*options):
        for spots in itertools.product([x for k in inserts for x in k], repeat=len(rows) + 1):
            if sum(map(len, spots)) > 2:
                continue
            out, audit, cost = [], "", 0
            for k, spot in enumerate(spots):
                for r in spot:
                    out.append((r, ""))
                    audit += "I"
                    cost += 5
                if k < len(edits):
                    cost += edits[k][0]
                    audit += edits[k][1]
                    if edits[k][2] is not None:
                        out.append(edits[k][2])
            if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in out)):
                way = (cost, audit, "\n".join(f"{r}:{t}" for r, t in out))
                best = way if best is None else min(best, way)
    return best


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        core = text.strip(SPACES)
        out.append((role, text, "b" if not core else "d" if (role, text) in seen else "t" if core[-1] not in ".!?" else ""))
        seen.add((role, text))
    return out


def after_damage(rows):
    """rows of one conversation id: (conv, turn, role, text)"""
    out = []
    for conv, turn, role, text in rows:
        word = lambda x: " " if x is None else str(x)
        role, text, k = word(role), word(text), zlib.crc32(f"{word(conv)}:{word(turn)}".encode()) % 20
        if k:
            text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
            out += [(turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))


def expected(rows):
    """Plain dynamic programming over all conversations."""
    out = {}
    for conv in {r[0] for r in rows}:
        mine = after_damage([r for r in rows if r[0] == conv])
        turns = [t for t, *_ in mine if t is not None]
        judged = faults([r[1:] for r in mine])
        best = {0: (0, "", [])}
        closure = lambda b: [
            (s2, (c + 5 * len(w), a + "I" * len(w), o + [f"{r}:" for r in w])) for s, (c, a, o) in b.items() for s2, w in [(s, ())] + {0: [(2, ("user",)), (3, ("user", "assistant"))], 1: [(2, ("user",)), (3, ("user", "assistant"))], 2: [(3, ("assistant",))], 3: [(2, ("user",))]}[s]
        ]
        for role, text, fault in judged:
            new = {}
            for s, (c, a, o) in closure(best):
                ways = [(s, (c + 2, a + "D", o))]
                more = 5 if fault == "t" else 0
                if fault not in ("b", "d"):
                    if role[:1] in repair.NEXT[s]:
                        ways.append((repair.NEXT[s][role[:1]], (c + more, a + "K", o + [f"{role}:{text}"])))
                    r = "assistant" if s == 2 else "user"
                    ways.append((repair.NEXT[s][r[0]], (c + 1 + more, a + "R", o + [f"{r}:{text}"])))
                for t, w in ways:
                    new[t] = min(new.get(t, w), w)
            best = new
        cost, audit, lines = min(w for s, w in closure(best) if s in (0, 3))
        letters = [r[1][:1] for r in mine]
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            *[sum(f == x for *_, f in judged) for x in "bdt"],
            sum(a + b not in ("su", "ua", "au") for a, b in zip(letters, letters[1:], strict=False)),
            cost,
            audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


def result(spark, rows, **options):
    df = spark.createDataFrame([(*r, 0, "audit", "conv") for r in rows], SCHEMA)
    got = repair.repaired(df, **options).collect()
    assert len({r.conv_id for r in got}) == len(got)
    return {r.conv_id: tuple(r)[1:] for r in got}


TEXTS = ["", " ", "Hello.", "What?", "well", "Yes!\n", "no end here ", None]
ROLES = ["user", "assistant", "system", "tool", "", None]


@settings(max_examples=120, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", ""]), st.sampled_from(["Yes.", "well", "", "No."])), max_size=4))
def test_search_is_the_cheapest_of_all_edits(rows):
    judged = faults(rows)
    steps = [(r[:1], {"b": repair.LOST, "d": repair.LOST, "t": repair.CUT, "": repair.FINE}[f], 1) for r, _, f in judged]
    (got,) = repair.search(steps).values()
    assert got == cheapest(judged)[:2]
    parts = [repair.matrix(steps[:2]), repair.matrix(steps[2:])]
    assert min(x for x in (repair.joined(*parts)[0][t] for t in repair.ACCEPT) if x is not None) == got


def conversations(seed, convs, most):
    rng = random.Random(seed)
    rows = []
    for conv in [None, *range(convs)]:
        n = rng.randint(1, most)
        turns = [rng.choice([None, t, t, t, t, t, t + rng.randint(0, 3)]) for t in range(n)]
        roles = ["system"] * rng.randint(0, 1) + ["user", "assistant"] * n
        rows += [(conv, t, rng.choice([r, r, r, r, rng.choice(ROLES)]), rng.choice(TEXTS + [f"Text {rng.random()}."] * 8)) for t, r in zip(turns, roles, strict=False)]
    return rows


@pytest.mark.parametrize("segment", [1, 3, 256])
def test_equals_plain_programming(spark, segment):
    rows = conversations(segment, 60, 12)
    rows += rows[:5] + [(70, 1, "user", "Hi.")] * 40 + [(71, t, "user", "ok") for t in range(30)]  # repeated rows, one text over and over
    assert result(spark, rows, segment=segment) == expected(rows)


def test_a_long_conversation(spark):
    rows = [(5, t, ("user", "assistant")[t % 2], f"Line {t}.") for t in range(2500)] + [(6, 0, "user", "Hi."), (6, 1, "assistant", "Ho.")]
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        assert result(spark, rows, segment=64) == expected(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_dropped_and_empty(spark):
    gone = next((c, t) for c in range(50) for t in range(50) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0)
    got = result(spark, [(*gone, "user", "Hello.")])
    assert got == {gone[0]: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert repair.repaired(spark.createDataFrame([], SCHEMA)).collect() == []
