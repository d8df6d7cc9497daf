"""End-to-end plans: the modular pipeline and the rich profiles."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.checkpoint import written
from kinweave.operators import blocking, evaluation, features, models, refine, scoring, selection
from kinweave.operators.records import normalize_records, rich_records
from kinweave.plans.profiles import PROFILES
from kinweave.sources.writers import wide


@dataclass
class ERPipeline:
    """Normalise, block, featurise, score and select: ``train`` then ``predict``.

    Pairs are scored once and written; thresholds are tried on the scores.
    """

    model_type: str = "gbdt"
    threshold: float = 0.70
    max_candidates: int = 30
    hard_negatives: bool = False
    overrides: dict = field(default_factory=dict)
    classifier: models.MatchClassifier | None = None

    def pairs(self, s1: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(candidates, features)."""
        a, b = (written(features.with_grams(normalize_records(x), "norm_name", "norm_address")) for x in (s1, targets))
        cands = written(blocking.candidates(a, b, top=self.max_candidates))
        make = features.features17 if self.hard_negatives else features.features14
        return cands, make(features.pairs_of(cands.select("s1_id", "t_id"), a, b))

    def train(self, s1: DataFrame, targets: DataFrame, truth: DataFrame) -> ERPipeline:
        cands, rows = self.pairs(s1, targets)
        if self.hard_negatives:
            a, b = normalize_records(s1), normalize_records(targets)
            both = blocking.with_true_matches(cands, truth, targets)
            rows = features.features17(features.pairs_of(both, a, b))
        names = features.FEATURES17 if self.hard_negatives else features.FEATURES14
        kind = "hardneg" if self.hard_negatives and self.model_type == "gbdt" else self.model_type
        self.classifier = models.MatchClassifier(names, kind, overrides=self.overrides).fit(written(models.labelled(rows, truth)))
        return self

    def scores(self, s1: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
        cands, rows = self.pairs(s1, targets)
        return cands, written(self.classifier.score(rows))

    def predict(self, s1: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(candidates, matches), both long."""
        cands, scored = self.scores(s1, targets)
        return cands, selection.threshold(scored, self.threshold)

    def tune(self, s1: DataFrame, targets: DataFrame, truth: DataFrame, taus=(0.3, 0.4, 0.5, 0.6, 0.7, 0.75, 0.8, 0.85)) -> DataFrame:
        """The sweep over thresholds; the best is kept. Choose on other entities than those reported."""
        _, scored = self.scores(s1, targets)
        sweep = selection.threshold_sweep(scored, truth, s1, taus)
        self.threshold = selection.best_of(sweep).collect()[0]["tau"]
        return sweep


def rule_linkage(s1: DataFrame, targets: DataFrame, profile: str) -> tuple[DataFrame, DataFrame]:
    """(candidates, matches) of a rule profile. All countries at once: country is part of every key."""
    p = PROFILES[profile]
    a, b = written(rich_records(s1, p.records)), written(rich_records(targets.dropDuplicates(["entity_id"]), p.records))
    cands = written(blocking.gated_candidates(a, b, blocking.GATES[p.gate]))
    scored = written(scoring.rule_scores(features.pairs_of(cands, a, b), p.scorer))
    return cands, selection.margin_cap(scored, p.min_score, p.margin, p.cap, p.auto)


def rule_matches(s1: DataFrame, targets: DataFrame, profile: str) -> DataFrame:
    """The matches of ``rule_linkage`` alone: pairs that can't score are left out where they meet, as selection reads none of them."""
    p = PROFILES[profile]
    a, b = (written(scoring.with_marks(written(rich_records(x, p.records)))) for x in (s1, targets.dropDuplicates(["entity_id"])))
    cands = blocking.gated_candidates(a, b, blocking.GATES[p.gate], blocking.Sieve(scoring.LIGHT, scoring.may_score(p.scorer)))
    return selection.margin_cap(written(scoring.rule_scores(features.pairs_of(cands, a, b), p.scorer)), p.min_score, p.margin, p.cap, p.auto)


def champion(s1: DataFrame, targets: DataFrame, truth: DataFrame | None = None, model: models.MatchClassifier | None = None, negatives: int = 8, more: bool = False, **overrides) -> tuple[DataFrame, DataFrame, models.MatchClassifier]:
    """(candidates, matches, model) of the trained profile with global unique assignment. Gives ``truth`` to train, or a ``model``."""
    p = PROFILES["champion"]
    a, b = written(rich_records(s1, p.records)), written(rich_records(targets.dropDuplicates(["entity_id"]), p.records))
    cands = written(blocking.gated_candidates(a, b, blocking.GATES[p.gate]))
    rows = lambda pairs: features.features19(features.with_ratios(features.pairs_of(pairs, a, b)), more)
    if model is None:
        both = blocking.with_true_matches(cands, truth, targets)
        # which pairs are kept follows from ids and labels, so only those are compared
        kept = models.limit_negatives(models.labelled(both, truth), negatives).select("s1_id", "t_id")
        data = models.labelled(rows(kept), truth)
        names = features.FEATURES22 if more else features.FEATURES19
        model = models.MatchClassifier(names, "champion", overrides=overrides).fit(written(data))
    scored = written(model.score(rows(cands)))
    return cands, selection.unique_assignment(scored, p.min_score, p.margin, p.cap), model


def refined(matches: DataFrame, s1: DataFrame, targets: DataFrame, consensus: DataFrame, version: int = 2) -> DataFrame:
    """Conflict pruning, re-ranking, caps and the rescue of unassigned targets (refine 1 to 3). ``matches``: s1_id, t_id, idx."""
    facts = written(refine.address_facts(s1).unionByName(refine.address_facts(targets)))
    kept = refine.prune(matches, facts, pins=version == 2)
    ranked = refine.rerank(kept, facts, consensus, version)
    out = written(refine.cap(ranked, 2, 120 if version == 2 else None))
    more = refine.rescue(s1, targets, out).withColumn("idx", F.lit(1000)).withColumn("score", F.lit(0))
    return out.unionByName(more)


def result_table(s1: DataFrame, matches: DataFrame, order: str = "idx") -> DataFrame:
    return wide(s1, matches, order=order)


def report(s1: DataFrame, matches: DataFrame, truth: DataFrame, cands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(macro metrics, error classes)."""
    return evaluation.macro_metrics(s1, matches, truth), evaluation.error_classes(matches, truth, cands, s1)
