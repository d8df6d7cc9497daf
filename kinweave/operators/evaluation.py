"""Evaluation of matches against truth. Truth and predictions are long: (s1_id, t_id); entities carry the singletons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def f_beta(truth: Column, pred: Column, hits: Column, beta: float = 0.5) -> tuple[Column, Column, Column]:
    """Precision, recall and F of counts (E-1). Nothing true: all 1 if nothing is predicted, else 0."""
    none = (truth == 0) & (pred == 0)
    zero = (truth == 0) | (pred == 0) | (hits == 0)
    p, r = hits / pred, hits / truth
    f = (1 + beta**2) * p * r / (beta**2 * p + r)
    pick = lambda x: F.when(none, 1.0).when(zero, 0.0).otherwise(x)
    return pick(p), pick(r), pick(f)


def _counts(every: DataFrame, pred: DataFrame, truth: DataFrame, keys: Sequence[str]) -> DataFrame:
    """For each entity (and setting) the sizes of truth, prediction and their intersection; sets, so duplicates count once."""
    pred = pred.select(*keys, "s1_id", "t_id").distinct().withColumn("_p", F.lit(1))
    true = truth.select("s1_id", "t_id").distinct()
    n_true = true.groupBy("s1_id").agg(F.count(F.lit(1)).alias("n_true"))
    hit = pred.join(true.withColumn("_t", F.lit(1)), ["s1_id", "t_id"], "left")
    n_pred = hit.groupBy(*keys, "s1_id").agg(F.count(F.lit(1)).alias("n_pred"), F.count("_t").alias("n_hit"))
    out = every.join(n_true, "s1_id", "left").join(n_pred, [*keys, "s1_id"], "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_true", "n_pred", "n_hit")})


def entity_scores(s1: DataFrame, pred: DataFrame, truth: DataFrame, beta: float = 0.5) -> DataFrame:
    """s1_id, n_true, n_pred, n_hit, precision, recall, f_beta (E-1)."""
    c = _counts(s1.select(F.col("entity_id").alias("s1_id")), pred, truth, [])
    p, r, f = f_beta(F.col("n_true"), F.col("n_pred"), F.col("n_hit"), beta)
    return c.select("s1_id", "n_true", "n_pred", "n_hit", p.alias("precision"), r.alias("recall"), f.alias("f_beta"))


def macro_by(every: DataFrame, pred: DataFrame, truth: DataFrame, keys: Sequence[str], beta: float = 0.5) -> DataFrame:
    c = _counts(every, pred, truth, keys)
    p, r, f = f_beta(F.col("n_true"), F.col("n_pred"), F.col("n_hit"), beta)
    return c.groupBy(*keys).agg(F.avg(p).alias("macro_precision"), F.avg(r).alias("macro_recall"), F.avg(f).alias("macro_f05"))


def macro_metrics(s1: DataFrame, pred: DataFrame, truth: DataFrame, beta: float = 0.5, by: Sequence[str] = ()) -> DataFrame:
    """Macro averages over all entities and by the number of true matches (E-2); an empty bucket is 0. ``by``: columns of s1, such as country."""
    e = entity_scores(s1, pred, truth, beta)
    if by:
        e = e.join(s1.select(F.col("entity_id").alias("s1_id"), *by), "s1_id")
    bucket = lambda cond: F.coalesce(F.avg(F.when(cond, F.col("f_beta"))), F.lit(0.0))
    n = F.col("n_true")
    return e.groupBy(*by).agg(
        F.count(F.lit(1)).alias("entities"),
        F.avg("precision").alias("macro_precision"),
        F.avg("recall").alias("macro_recall"),
        F.avg("f_beta").alias("macro_f05"),
        bucket(n == 0).alias("singleton_score"),
        bucket(n == 1).alias("single_f05"),
        bucket(n > 1).alias("multi_f05"),
        F.count_if(n == 0).alias("singletons"),
        F.count_if(n == 1).alias("singles"),
        F.count_if(n > 1).alias("multis"),
    )


def error_rows(pred: DataFrame, truth: DataFrame, cands: DataFrame) -> DataFrame:
    """s1_id, t_id, kind (TP, FP, FN), reason (E-3, E-4): a missed pair failed in blocking if it was no candidate, else in scoring."""
    flag = lambda df, c: df.select("s1_id", "t_id").distinct().withColumn(c, F.lit(True))
    both = flag(pred, "p").join(flag(truth, "t"), ["s1_id", "t_id"], "full").join(flag(cands, "c"), ["s1_id", "t_id"], "left")
    kind = F.when(F.col("p") & F.col("t"), "TP").when(F.col("p"), "FP").otherwise("FN")
    reason = F.when(F.col("p") & F.col("t"), "correct").when(F.col("p"), "false match").when(F.col("c"), "classifier failure").otherwise("blocking failure")
    return both.select("s1_id", "t_id", kind.alias("kind"), reason.alias("reason"))


def error_classes(pred: DataFrame, truth: DataFrame, cands: DataFrame, s1: DataFrame) -> DataFrame:
    """kind, reason, n; and the singletons that got nothing or something."""
    pairs = error_rows(pred, truth, cands).groupBy("kind", "reason").agg(F.count(F.lit(1)).alias("n"))
    single = s1.select(F.col("entity_id").alias("s1_id")).join(truth, "s1_id", "left_anti").join(pred.select("s1_id").distinct().withColumn("p", F.lit(1)), "s1_id", "left")
    kinds = single.groupBy(F.when(F.col("p").isNull(), "correct singleton").otherwise("incorrect singleton").alias("reason")).agg(F.count(F.lit(1)).alias("n"))
    return pairs.unionByName(kinds.select(F.lit("S").alias("kind"), "reason", "n"))


def gap(pred: DataFrame, truth: DataFrame, cands: DataFrame) -> DataFrame:
    """One row: true pairs, how many are candidates, how many are predicted (E-4)."""
    rows = error_rows(pred, truth, cands).where("kind <> 'FP'")
    return rows.agg(
        F.count(F.lit(1)).alias("true_pairs"),
        F.count_if(F.col("reason") != "blocking failure").alias("captured"),
        F.count_if(F.col("kind") == "TP").alias("predicted"),
    )


def hash_place(seed: int, column: str, places: int = 100):
    """A place below ``places`` for each value, by the first 32 bits of an MD5 that other engines have too."""
    word = F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.col(column)).cast("binary")), 1, 8)
    return F.conv(word, 16, 10).cast("bigint") % places


def split(s1: DataFrame, percent: int = 80, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Train and validation entities by a hash of the id (E-10)."""
    place = hash_place(seed, "entity_id")
    return s1.where(place < percent), s1.where(place >= percent)


def validation_set(s1: DataFrame, truth: DataFrame, targets: DataFrame, entities: int = 10_000, distractors: int = 100_000) -> tuple[DataFrame, DataFrame]:
    """The first entities, and their true targets with the first distractors of each source (E-11)."""

    head = s1.orderBy("entity_id").limit(entities)
    true = truth.join(head.select(F.col("entity_id").alias("s1_id")), "s1_id", "left_semi").select(F.col("t_id").alias("entity_id"))
    # of each source the smallest ids: a sort with a limit, never a rank over the whole source
    parts = [targets.where(F.col("entity_id").startswith(s)).orderBy("entity_id").limit(distractors) for s in ("S2-", "S3-")]
    pool = targets.join(true, "entity_id", "left_semi").unionByName(parts[0]).unionByName(parts[1]).distinct()
    return head, pool
