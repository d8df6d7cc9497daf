"""Selection of matches from scored pairs (s1_id, t_id, score). Every order ends in ids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.checkpoint import drop, written
from kinweave.graph import components


def source_of(t_id: str = "t_id") -> Column:
    return F.substring(t_id, 1, 2)


def threshold(scored: DataFrame, tau: float = 0.70) -> DataFrame:
    """L-1."""
    return scored.where(F.col("score") >= tau)


def _ranked(scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    w = Window.partitionBy(*keys, "source").orderBy(F.desc("score"), "t_id")
    return scored.withColumn("source", source_of()).where(F.col("source").isin("S2", "S3")).withColumn("rank", F.row_number().over(w))


def margin_cap(scored: DataFrame, min_score: float = 0.80, margin: float = 0.05, cap: int = 3, auto: bool = False) -> DataFrame:
    """s1_id, t_id, score, rank: within ``margin`` of the best, ``cap`` for each source (L-2, L-6).

    With ``auto``, rows of ``is_auto`` pass the margin but count for the cap (L-3).
    """
    top = F.max("score").over(Window.partitionBy("s1_id"))
    near = F.col("top") - F.col("score") <= margin
    kept = scored.withColumn("top", top).where((F.col("score") >= min_score) & (near | F.col("is_auto") if auto else near))
    return _ranked(kept, ["s1_id"]).where(F.col("rank") <= cap).select("s1_id", "t_id", "score", "rank")


def singleton_guard(scored: DataFrame, gate: float = 0.88, min_score: float = 0.85, margin: float = 0.08, cap: int = 2) -> DataFrame:
    """Nothing for an s1 whose best is below ``gate``, else margin and cap (L-4)."""
    top = scored.withColumn("best", F.max("score").over(Window.partitionBy("s1_id"))).where(F.col("best") >= gate).drop("best")
    return margin_cap(top, min_score, margin, cap)


def top_k(scored: DataFrame, k: int) -> DataFrame:
    """The k best for each s1 (L-7)."""
    w = Window.partitionBy("s1_id").orderBy(F.desc("score"), "t_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def threshold_sweep(scored: DataFrame, truth: DataFrame, s1: DataFrame, taus: Sequence[float]) -> DataFrame:
    """tau, macro precision, recall, F0.5 for each threshold (L-8): pairs are read once, each row goes to the thresholds it reaches."""
    from kinweave.operators.evaluation import macro_by

    reached = F.filter(F.array(*[F.lit(float(t)) for t in taus]), lambda t: F.col("score") >= t)
    pred = scored.select("s1_id", "t_id", F.explode(reached).alias("tau"))
    every = s1.select(F.col("entity_id").alias("s1_id"), F.explode(F.array(*[F.lit(float(t)) for t in taus])).alias("tau"))
    return macro_by(every, pred, truth, ["tau"])


def best_of(sweep: DataFrame, by: str = "macro_f05") -> DataFrame:
    """The first row of the highest score: ties go to the smallest setting."""
    rest = [c for c in sweep.columns if c != by]
    return sweep.orderBy(F.desc(by), *rest).limit(1)


def grid_sweep(scored: DataFrame, truth: DataFrame, s1: DataFrame, minimums: Sequence[float], margins: Sequence[float], caps: Sequence[int]) -> DataFrame:
    """min_score, margin, cap and macro metrics for each setting (L-9). Scores are read once; a pair is copied only to the settings that it passes."""
    from kinweave.operators.evaluation import macro_by

    best = scored.withColumn("top", F.max("score").over(Window.partitionBy("s1_id")))
    lows = F.filter(F.array(*[F.lit(float(x)) for x in minimums]), lambda x: F.col("score") >= x)
    gaps = F.filter(F.array(*[F.lit(float(x)) for x in margins]), lambda x: F.col("top") - F.col("score") <= x)
    spread = best.select("s1_id", "t_id", "score", F.explode(lows).alias("min_score"), gaps.alias("gaps"))
    spread = spread.select("s1_id", "t_id", "score", "min_score", F.explode("gaps").alias("margin"))
    ranked = _ranked(spread, ["min_score", "margin", "s1_id"])
    fits = F.filter(F.array(*[F.lit(int(c)) for c in caps]), lambda c: F.col("rank") <= c)
    pred = ranked.select("s1_id", "t_id", "min_score", "margin", F.explode(fits).alias("cap"))
    every = s1.select(F.col("entity_id").alias("s1_id"))
    for name, values, kind in (("min_score", minimums, float), ("margin", margins, float), ("cap", caps, int)):
        every = every.withColumn(name, F.explode(F.array(*[F.lit(kind(v)) for v in values])))
    return macro_by(every, pred, truth, ["min_score", "margin", "cap"])


def unique_assignment(scored: DataFrame, min_score: float = 0.85, margin: float = 0.08, cap: int = 3, rounds: int = 50, by: Sequence[str] = ()) -> DataFrame:
    """Every target goes to one s1 at most (L-5): the greedy over (score desc, s1, t), in rounds.

    An edge that is first among the open ones of both its s1 and its target is decided as
    the greedy would: accepted if it is within ``margin`` of the s1's first free edge and
    the source's cap isn't reached. Rounds decide all such edges at once; each ends in a
    written table, and drops those of the round before. Chains longer than ``rounds`` are finished by the sequential rule inside
    their connected component, which is what is left of the graph by then; components of
    more than ``SEQUENTIAL`` edges go on in rounds, so no task holds more than that.
    ``by`` names columns whose values are settings of their own: each is assigned by itself.
    """
    by = list(by)
    order = [F.desc("score"), F.asc("s1_id"), F.asc("t_id")]
    open_ = written(scored.where(F.col("score") >= min_score).select(*by, "s1_id", "t_id", "score", source_of().alias("source")).distinct(), "open")
    spark = scored.sparkSession
    empty = spark.createDataFrame([], open_.select(*by, "s1_id", F.col("score").alias("best"), F.lit(0).alias("n2"), F.lit(0).alias("n3")).schema)
    state, done, left = written(empty, "state"), [], rounds
    while not open_.isEmpty():
        if not left:
            small, rest, named = _apart(open_, by)
            done.append(written(_finish(small, state, margin, cap, by), "finished"))
            drop(open_, named)
            open_, left = rest, rounds
            continue
        left -= 1
        by_s1, by_t = Window.partitionBy(*by, "s1_id").orderBy(*order), Window.partitionBy(*by, "t_id").orderBy(*order)
        ranked = open_.withColumn("r1", F.row_number().over(by_s1)).withColumn("r2", F.row_number().over(by_t))
        head = ranked.where("r1 = 1 AND r2 = 1").join(state, [*by, "s1_id"], "left")
        n = F.when(F.col("source") == "S2", F.coalesce("n2", F.lit(0))).otherwise(F.coalesce("n3", F.lit(0)))
        best = F.coalesce("best", "score")
        ok = (best - F.col("score") <= margin) & (n < cap) & F.col("source").isin("S2", "S3")
        head = written(head.select(*by, "s1_id", "t_id", "score", "source", best.alias("best"), ok.alias("ok"), "n2", "n3"), "head")
        done.append(head)
        add = lambda s: (F.coalesce(f"n{s[1]}", F.lit(0)) + (F.col("ok") & (F.col("source") == s)).cast("int")).cast("int")
        news = head.select(*by, "s1_id", "best", add("S2").alias("n2"), add("S3").alias("n3"))
        taken = head.where("ok").select(*by, "t_id")
        last = (state, open_)
        state = written(state.join(news, [*by, "s1_id"], "left_anti").unionByName(news), "state")
        open_ = written(open_.join(head, [*by, "s1_id", "t_id"], "left_anti").join(taken, [*by, "t_id"], "left_anti"), "open")
        drop(*last)
    columns = [*by, "s1_id", "t_id", "score"]
    out = scored.select(*columns).limit(0)
    for d in done:
        out = out.unionByName((d.where("ok") if "ok" in d.columns else d).select(*columns))
    out = written(out, "assigned")  # the one table that stays
    drop(open_, state, *done)
    return out


#: edges of a component that one task may walk
SEQUENTIAL = 1_000_000


def _apart(open_: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The edges of components that a task may hold, with ``root``; the others; the table that the first are read from."""
    node = lambda kind, c: F.concat_ws("\t", F.lit(kind), *[F.col(x).cast("string") for x in by], c)
    named = open_.withColumn("_s", node("s", "s1_id"))
    roots = components(named.select(F.col("_s").alias("a"), node("t", "t_id").alias("b")))
    named = written(named.join(roots, named["_s"] == roots["node"]).drop("_s", "node"), "named")
    drop(roots)
    large = named.groupBy("root").count().where(F.col("count") > SEQUENTIAL).select("root")
    return named.join(large, "root", "left_anti"), written(named.join(large, "root", "left_semi").drop("root"), "rest"), named


def _finish(edges: DataFrame, state: DataFrame, margin: float, cap: int, by: list[str]) -> DataFrame:
    """The sequential greedy inside each connected component of the open edges."""
    import pandas as pd

    def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
        best = {r.s1_id: r.best for r in pdf.itertuples() if r.best == r.best}
        count = {(r.s1_id, s): getattr(r, f"n{s[1]}") for r in pdf.itertuples() for s in ("S2", "S3") if r.n2 == r.n2}
        taken, keep = set(), []
        for r in pdf.sort_values(["score", "s1_id", "t_id"], ascending=[False, True, True]).itertuples():
            if r.t_id in taken:
                continue
            top = best.setdefault(r.s1_id, r.score)
            n = count.get((r.s1_id, r.source), 0)
            if top - r.score <= margin and n < cap and r.source in ("S2", "S3"):
                taken.add(r.t_id)
                count[r.s1_id, r.source] = n + 1
                keep.append(r.Index)
        return pdf.loc[keep, [*by, "s1_id", "t_id", "score"]]

    rows = edges.join(state, [*by, "s1_id"], "left")
    return rows.groupBy("root").applyInPandas(greedy, edges.select(*by, "s1_id", "t_id", "score").schema)


def unique_sweep(scored: DataFrame, truth: DataFrame, s1: DataFrame, taus: Sequence[float], margin: float = 0.08, cap: int = 3) -> DataFrame:
    """tau and macro metrics of the unique assignment at each threshold (L-10): all thresholds in the same rounds."""
    from kinweave.operators.evaluation import macro_by

    reached = F.filter(F.array(*[F.lit(float(t)) for t in taus]), lambda t: F.col("score") >= t)
    each = scored.select("s1_id", "t_id", "score", F.explode(reached).alias("tau"))
    pred = unique_assignment(each, 0.0, margin, cap, by=["tau"])
    every = s1.select(F.col("entity_id").alias("s1_id"), F.explode(F.array(*[F.lit(float(t)) for t in taus])).alias("tau"))
    return macro_by(every, pred, truth, ["tau"])
