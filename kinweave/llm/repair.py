"""Repair of conversations whose rows were damaged, at the least cost of edits.

The role initials of a repaired conversation follow ``(s?(ua)+)?``. Edits are Keep (0), Rerole
to user or assistant (1), Delete (2, and the only edit of blank and duplicate rows) and Insert of
an empty user or assistant turn (5); a truncated row that stays adds 5. Among the cheapest edits
those whose initials are ASCII-least are taken. The grammar and the cheapest audit determine what
a rerole or an insert becomes, so the audit determines the repaired conversation.

1. Damaged rows that are equal in conversation, turn, role and text are counted as one step, so
   a row that is repeated without end is one row. First occurrences of a role and text in a
   conversation are found by a pre-aggregated minimum.
2. Steps are sorted over the whole table by conversation and turn: a range partition holds parts
   of conversations, a long conversation lies in several. A task reads its partition as a stream.
3. Dijkstra's search over the implicit lattice of nodes (step, grammar state), by the key
   (cost, audit), solves a conversation that lies within a partition and has at most ``SEGMENT``
   steps; it ends at the first accepting end node that is popped. Equal costs at a node belong to
   audits of which none begins the other, so the order of audits survives any continuation.
4. Of longer conversations, and of those at a partition's edge, each segment is searched from
   every grammar state to every grammar state. Segments are joined in pairs, as least costs over
   the state between them, until one answer for the conversation is left; joined strings are as
   long as the audit is, one letter for each edit.
5. The text hash of such a conversation is taken over its rows as a stream, the audit before
   them. A hash has to run over a conversation in one order; nothing is collected for it.

Input cases. Null role, text, conversation or turn count as one space where they are text; null
turns come first and take no part in gaps; rows without a conversation are one conversation.
Rows of one turn are taken by role, then text. Any other role than those of the grammar, an empty
one too, has to be reroled or deleted. A conversation whose rows were all dropped has zeros, no
audit and the hash of the empty string; an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm.common import arrow_map, table, written

#: grammar states: start, after s, after u, after a; from each, the letters that may follow and the next state
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ACCEPT = (0, 3)
#: the letter that a rerole or an insert writes in each state
WRITES = ("u", "u", "a", "u")
ROLES = {"u": "user", "a": "assistant"}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: kinds of a step
FINE, CUT, LOST = 0, 1, 2
SEGMENT = 256
LEGAL = ("su", "ua", "au")
SPACES = " \t\n\x0b\f\r"

Step = tuple[str, int, int]  # role initial, kind, rows


def search(steps: list[Step], start: int = 0, whole: bool = True) -> dict[int, tuple[int, str]]:
    """Least (cost, audit) from ``start`` before the first step to end states after the last.

    ``whole``: only the first accepting end state that is popped; else every state that can be reached.
    """
    heap, closed, found = [(0, "", 0, start)], set(), {}
    while heap:
        cost, audit, i, state = heapq.heappop(heap)
        if (i, state) in closed:
            continue
        closed.add((i, state))
        if i == len(steps):
            if not whole or state in ACCEPT:
                found[state] = (cost, audit)
            if len(found) == (1 if whole else len(NEXT)):
                break
        else:
            letter, kind, n = steps[i]
            if kind == LOST:  # an insert between such rows is never ASCII-least
                heapq.heappush(heap, (cost + DELETE * n, audit + "D" * n, i + 1, state))
            else:
                heapq.heappush(heap, (cost + DELETE, audit + "D", i + 1, state))
                more = TRUNCATED if kind == CUT else 0
                if letter in NEXT[state]:
                    heapq.heappush(heap, (cost + KEEP + more, audit + "K", i + 1, NEXT[state][letter]))
                heapq.heappush(heap, (cost + REROLE + more, audit + "R", i + 1, NEXT[state][WRITES[state]]))
        heapq.heappush(heap, (cost + INSERT, audit + "I", i, NEXT[state][WRITES[state]]))
    return found


def joined(a: list, b: list) -> list:
    """The matrix of two segments in a row: ``m[s][t]`` is the least (cost, audit) from s to t, or None."""
    out = [[None] * len(NEXT) for _ in NEXT]
    for s, row in enumerate(a):
        for t in range(len(NEXT)):
            ways = [(x[0] + b[m][t][0], x[1] + b[m][t][1]) for m, x in enumerate(row) if x is not None and b[m][t] is not None]
            out[s][t] = min(ways, default=None)
    return out


def matrix(steps: list[Step]) -> list:
    return [[(found := search(steps, s, whole=False)).get(t) for t in range(len(NEXT))] for s in range(len(NEXT))]


class Writer:
    """Applies an audit to the steps as they come and hashes the repaired conversation."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state, self.sha, self.empty = audit, 0, 0, hashlib.sha256(), True

    def _line(self, role: str, text: str, letter: str) -> None:
        self.state = NEXT[self.state][letter]
        self.sha.update(f"{'' if self.empty else chr(10)}{role}:{text}".encode())
        self.empty = False

    def _inserts(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self._line(ROLES[WRITES[self.state]], "", WRITES[self.state])
            self.at += 1

    def rows(self, role: str, text: str, n: int) -> None:
        """``n`` equal rows; of those at most the first stays."""
        for _ in range(min(n, 2)):
            self._inserts()
            edit = self.audit[self.at]
            if edit == "K":
                self._line(role, text, role[0])
            elif edit == "R":
                self._line(ROLES[WRITES[self.state]], text, WRITES[self.state])
            self.at += 1
        self.at += max(0, n - 2)

    def digest(self) -> str:
        self._inserts()
        return self.sha.hexdigest()


def _steps(role: str, n: int, blank: bool, first: bool, cut: bool) -> list[Step]:
    letter = role[:1]
    if blank or not first:
        return [(letter, LOST, n)]
    return [(letter, CUT if cut else FINE, 1)] + ([(letter, LOST, n - 1)] if n > 1 else [])


def damaged(conversations: DataFrame) -> DataFrame:
    """conv, turn, role, text, n: the rows after the damage that their conversation and turn decide; n is 0 for dropped ones."""
    as_text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select(as_text("conv_id").alias("conv"), F.col("turn").cast("bigint").alias("turn"), as_text("role").alias("role"), as_text("text").alias("text"), as_text("turn").alias("at"))
    kind = F.crc32(F.concat("conv", F.lit(":"), "at").cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select("conv", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("bigint").alias("n"))


def judged(rows: DataFrame) -> DataFrame:
    """Equal rows as one, with the faults: blank, first (of its role and text in the conversation), cut."""
    trimmed = F.rtrim("text", F.lit(SPACES))
    steps = rows.groupBy("conv", "turn", "role", "text").agg(F.sum("n").alias("n"))
    steps = steps.withColumns({"blank": trimmed == "", "cut": ~F.right(trimmed, F.lit(1)).isin(".", "!", "?"), "digest": F.sha2("text", 256)})
    seen = rows.where("n > 0").groupBy("conv", "role", F.sha2("text", 256).alias("digest"))
    seen = seen.agg(F.min("turn").alias("least"), F.max(F.col("turn").isNull()).alias("unnumbered"))
    first = F.when(F.col("unnumbered"), F.col("turn").isNull()).otherwise(F.col("turn") == F.col("least"))
    return steps.join(seen, ["conv", "role", "digest"], "left").select("conv", "turn", "role", "text", "n", "blank", F.coalesce(first, F.lit(False)).alias("first"), "cut")


def _order() -> list[Column]:
    return [F.col("conv"), F.asc_nulls_first("turn"), F.col("role"), F.col("text")]


SOLVED = "conv string, part int, seq int, letters string, illegal bigint, cost bigint, audit string, sha string, costs array<bigint>, audits array<string>"


def _illegal(a: str, b: str) -> bool:
    return a + b not in LEGAL


class _Part:
    """One partition's stream of steps, cut into conversations and segments."""

    def __init__(self, segment: int):
        self.segment, self.part, self.seq, self.out = segment, TaskContext.get().partitionId(), 0, []
        self.conv, self.edge = None, True
        self._clear()

    def _clear(self) -> None:
        self.steps, self.rows, self.illegal, self.ends, self.open = [], [], 0, None, False

    def _segment(self) -> None:
        m = [x for row in matrix(self.steps) for x in row]
        letters = "|".join(self.ends)
        self.out.append((self.conv, self.part, self.seq, letters, self.illegal, None, None, None, [None if x is None else x[0] for x in m], [None if x is None else x[1] for x in m]))
        self.seq += 1
        self._clear()
        self.open = True

    def end(self, edge: bool) -> None:
        """The conversation's last step in this partition has been read."""
        if self.conv is None or not self.steps:
            pass
        elif edge or self.edge or self.open:
            self._segment()
        else:
            ((cost, audit),) = search(self.steps).values()
            w = Writer(audit)
            for r in self.rows:
                w.rows(*r)
            self.out.append((self.conv, self.part, self.seq, None, self.illegal, cost, audit, w.digest(), None, None))
        self._clear()

    def read(self, conv: str, role: str, text: str, n: int, blank: bool, first: bool, cut: bool) -> None:
        if conv != self.conv:
            if self.conv is not None:
                self.end(edge=False)
                self.edge = False
            self.conv, self.open = conv, False
        elif len(self.steps) >= self.segment:
            self._segment()
        letter = role[:1]
        self.illegal += n - 1 + (self.ends is not None and _illegal(self.ends[1], letter))
        self.ends = (letter if self.ends is None else self.ends[0], letter)
        self.steps += _steps(role, n, blank, first, cut)
        self.rows.append((role, text, n))

    def taken(self) -> pa.RecordBatch:
        names = [f.split()[0] for f in SOLVED.split(", ")]
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.string())]
        rows, self.out = self.out, []
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


def _solver(segment: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = _Part(segment)
        for b in batches:
            for row in zip(*[c.to_pylist() for c in b.columns], strict=True):
                part.read(*row)
            yield part.taken()
        part.end(edge=True)
        yield part.taken()

    return run


def _conversation(segments) -> tuple[int, int, str]:
    """illegal, cost, audit of a conversation from its segments (part, seq, letters, illegal, costs, audits), in any order."""
    rows = sorted(segments, key=lambda r: (r[0], r[1]))
    illegal = sum(r[3] for r in rows)
    letters = [r[2].split("|") for r in rows]
    illegal += sum(_illegal(a[1], b[0]) for a, b in zip(letters, letters[1:], strict=False))
    k = len(NEXT)
    level = [[[None if c[s * k + t] is None else (int(c[s * k + t]), a[s * k + t]) for t in range(k)] for s in range(k)] for *_, c, a in rows]
    while len(level) > 1:
        level = [joined(*level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    cost, audit = min(level[0][0][t] for t in ACCEPT if level[0][0][t] is not None)
    return illegal, cost, audit


def _join(key: tuple, group: pa.Table) -> pa.Table:
    cells = [group.column(c).to_pylist() for c in ("part", "seq", "letters", "illegal", "costs", "audits")]
    illegal, cost, audit = _conversation(list(zip(*cells, strict=True)))
    return pa.table({"conv": pa.array([key[0].as_py()], pa.string()), "illegal": pa.array([illegal], pa.int64()), "cost": pa.array([cost], pa.int64()), "audit": pa.array([audit], pa.string())})


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """conv, sha from streams in which a conversation's audit stands before its rows."""
    conv, writer = None, None
    out = lambda c, w: pa.RecordBatch.from_pydict({"conv": [c], "sha": [w.digest()]})
    for b in batches:
        for c, audit, role, text, n in zip(*[x.to_pylist() for x in b.columns], strict=True):
            if c != conv:
                if writer is not None:
                    yield out(conv, writer)
                conv, writer = c, Writer(audit)
            else:
                writer.rows(role, text, n)
    if writer is not None:
        yield out(conv, writer)


def repaired(conversations: DataFrame, segment: int = SEGMENT, damage=damaged) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation.

    ``damage`` makes conv, turn, role, text, n of the rows; ``segment``: steps that are searched at once.
    """
    steps = written(judged(damage(conversations)), "steps")
    held, n = F.col("n") > 0, F.col("n")
    turns = F.when(held, F.col("turn"))
    wide = lambda c: c.cast("decimal(38,0)")
    counted = lambda c: F.sum(F.when(held, c).otherwise(F.lit(0)))
    stats = steps.groupBy("conv").agg(
        F.coalesce((wide(F.max(turns)) - wide(F.min(turns)) + 1 - F.count_distinct(turns)).cast("bigint"), F.lit(0)).alias("gaps"),
        counted(F.when(F.col("blank"), n).otherwise(F.lit(0))).alias("blank"),
        counted(F.when(F.col("blank"), F.lit(0)).otherwise(n - F.col("first").cast("bigint"))).alias("duplicate"),
        counted((~F.col("blank") & F.col("first") & F.col("cut")).cast("bigint")).alias("truncated"),
    )

    rows = steps.where(held)
    ordered = rows.repartitionByRange(*_order()).sortWithinPartitions(*_order())
    solved = written(arrow_map(ordered.select("conv", "role", "text", "n", "blank", "first", "cut"), _solver(segment), SOLVED), "solved")
    whole = solved.where("audit IS NOT NULL").select("conv", "illegal", "cost", "audit", "sha")
    parts = solved.where("audit IS NULL").select("conv", "part", "seq", "letters", "illegal", "costs", "audits")
    long = written(parts.groupBy("conv").applyInArrow(_join, "conv string, illegal bigint, cost bigint, audit string"), "long")
    none = lambda kind: F.lit(None).cast(kind)
    first = long.select("conv", F.lit(0).alias("rank"), none("bigint").alias("turn"), "audit", none("string").alias("role"), none("string").alias("text"), none("bigint").alias("n"))
    then = rows.join(long.select("conv"), "conv", "left_semi").select("conv", F.lit(1).alias("rank"), "turn", none("string").alias("audit"), "role", "text", "n")
    stream = first.unionByName(then).repartition("conv").sortWithinPartitions("conv", "rank", *_order()[1:])
    hashes = arrow_map(stream.select("conv", "audit", "role", "text", "n"), _hashes, "conv string, sha string")
    every = whole.unionByName(long.join(hashes, "conv"))

    out = stats.join(every, "conv", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    return out.select(
        F.when(F.col("conv") != " ", F.col("conv")).cast("bigint").alias("conv_id"),
        *[zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
    )


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(table(spark, sf_dir, "conversations"))


def _sql() -> str:
    """CRC by a table that SQL makes, then least (cost, audit, text) for each state after each row, row by row."""
    crc = "SELECT i, i AS c FROM range(256) t(i)"
    for _ in range(8):
        crc = f"SELECT i, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END AS c FROM ({crc})"
    edges = ["(0, 's', 1)", "(0, 'u', 2)", "(1, 'u', 2)", "(2, 'a', 3)", "(3, 'u', 2)"]
    return rf"""WITH RECURSIVE crc AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM ({crc})),
src AS (SELECT coalesce(CAST(conv_id AS VARCHAR), ' ') AS conv, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text FROM conversations),
hashed AS (SELECT src.*, xor(list_reduce(list_concat([4294967295], [CAST(ascii(x) AS BIGINT) FOR x IN string_split(conv || ':' || coalesce(CAST(turn AS VARCHAR), ' '), '')]), lambda c, b: xor(t[CAST(xor(c, b) % 256 + 1 AS BIGINT)], c // 256)), 4294967295) % 20 AS k FROM src, crc),
rows AS (SELECT conv, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE WHEN k = 1 THEN '' WHEN k = 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM hashed, range(CASE WHEN k = 3 THEN 2 ELSE 1 END) WHERE k <> 0),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, text) AS i FROM rows),
faults AS (SELECT *, trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS core, row_number() OVER (PARTITION BY conv, role, text ORDER BY i) > 1 AS again, left(role, 1) AS x, lead(left(role, 1)) OVER (PARTITION BY conv ORDER BY i) AS y FROM numbered),
steps AS MATERIALIZED (SELECT *, CASE WHEN core = '' THEN 'b' WHEN again THEN 'd' WHEN right(core, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault FROM faults),
grammar(a, x, b) AS (VALUES {", ".join(edges)}),
ins(a, b, cost, audit, line) AS (VALUES (0, 0, 0, '', ''), (1, 1, 0, '', ''), (2, 2, 0, '', ''), (3, 3, 0, '', ''), (0, 2, 5, 'I', chr(10) || 'user:'), (1, 2, 5, 'I', chr(10) || 'user:'),
  (3, 2, 5, 'I', chr(10) || 'user:'), (2, 3, 5, 'I', chr(10) || 'assistant:'), (0, 3, 10, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'), (1, 3, 10, 'II', chr(10) || 'user:' || chr(10) || 'assistant:')),
best(conv, i, s, w) AS (
  SELECT DISTINCT conv, CAST(0 AS BIGINT), 0, {{'cost': CAST(0 AS BIGINT), 'audit': '', 'line': ''}} FROM steps
  UNION ALL
  SELECT conv, i, s, min(w) FROM (
    SELECT p.conv, r.i, e.b AS s, {{'cost': CAST(p.w.cost + n.cost + e.cost AS BIGINT), 'audit': p.w.audit || n.audit || e.edit, 'line': p.w.line || n.line || CASE WHEN e.edit = 'D' THEN '' ELSE chr(10) || e.role || ':' || r.text END}} AS w
    FROM best p JOIN ins n ON n.a = p.s JOIN steps r ON r.conv = p.conv AND r.i = p.i + 1,
    LATERAL (SELECT n.b, 2 AS cost, 'D' AS edit, '' AS role
      UNION ALL SELECT g.b, CASE WHEN r.fault = 't' THEN 5 ELSE 0 END, 'K', r.role FROM grammar g WHERE g.a = n.b AND g.x = r.x AND r.fault NOT IN ('b', 'd')
      UNION ALL SELECT g.b, CASE WHEN r.fault = 't' THEN 6 ELSE 1 END, 'R', CASE g.x WHEN 'u' THEN 'user' ELSE 'assistant' END FROM grammar g WHERE g.a = n.b AND g.x <> 's' AND r.fault NOT IN ('b', 'd')) e(b, cost, edit, role)
  ) GROUP BY conv, i, s),
last AS (SELECT conv, max(i) AS n FROM steps GROUP BY conv),
solved AS (SELECT conv, min(w) AS w FROM (SELECT p.conv, {{'cost': CAST(p.w.cost + n.cost AS BIGINT), 'audit': p.w.audit || n.audit, 'line': p.w.line || n.line}} AS w FROM best p JOIN last l ON l.conv = p.conv AND l.n = p.i JOIN ins n ON n.a = p.s WHERE n.b IN (0, 3)) GROUP BY conv),
counts AS (SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(fault = 'b') AS blank, count_if(fault = 'd') AS duplicate, count_if(fault = 't') AS truncated, count_if(y IS NOT NULL AND x || y NOT IN ('su', 'ua', 'au')) AS illegal FROM steps GROUP BY conv)
SELECT CASE WHEN c.conv <> ' ' THEN CAST(c.conv AS BIGINT) END AS conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
  CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, coalesce(w.cost, 0) AS cost, coalesce(w.audit, '') AS audit, sha256(coalesce(substr(w.line, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv FROM src) c LEFT JOIN counts n ON n.conv = c.conv LEFT JOIN solved s ON s.conv = c.conv"""


OP11_SQL = _sql()
