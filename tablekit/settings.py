"""Settings that change results. Pass a modified copy (``dataclasses.replace``) to override."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Thresholds:
    # The defaults of the quality and anomaly rules.
    low_completeness: float = 0.5
    high_duplicates: float = 0.1
    uniqueness: float = 0.99
    numeric_text_share: float = 0.9
    missing_low: float = 0.1
    missing_high: float = 0.3
    cluster_share: float = 0.3
    advice_score: float = 85.0
    top_categories: int = 10
    top_categories_agreeing: int = 7


DEFAULTS = Thresholds()
