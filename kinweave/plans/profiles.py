"""The profiles: which normaliser, gate, scorer and selector belong together."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Profile:
    records: str  # of ``records.rich_records``
    gate: str  # of ``blocking.GATES``
    scorer: str  # of ``scoring.PROFILES``, or a model's kind
    min_score: float = 0.80
    margin: float = 0.05
    cap: int = 3
    auto: bool = False
    unique: bool = False


PROFILES = {
    "v2": Profile("v2", "v2", "v2", margin=0.06, cap=4, auto=True),
    "v3": Profile("v3", "v3", "v3", margin=0.06, cap=4, auto=True),
    "v4": Profile("v4", "v4", "v4"),
    "production": Profile("production", "production", "production"),
    "turbo": Profile("turbo", "turbo", "turbo"),
    "v5": Profile("v5", "v5", "v5", margin=0.04),
    "fixed": Profile("production", "production", "fixed"),
    "optimal": Profile("v5", "v5", "optimal", margin=0.04),
    "refined": Profile("champion", "refined", "refined", margin=0.04),
    "champion": Profile("champion", "champion", "champion", min_score=0.85, margin=0.08, unique=True),
}
