"""Settings of an analysis, passed explicitly and never changed."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    min_set_size: int = 3
    max_set_size: int = 500
    min_present: int = 3
    min_observed: int = 10
    default_weight: float = 0.3
    d_share: float = 0.6
    s_share: float = 0.4
    tier_1: float = 0.5
    tier_2: float = 0.8
    similarity: float = 0.8
    iqr_percentile: float = 0.05
    stability: float = 0.60
    bootstraps: int = 200
    inner_bootstraps: int = 100
    l1_ratios: tuple[float, ...] = (0.5, 0.7, 0.9)
    n_cs: int = 10
    folds: int = 5
    permutations: int = 1000
    trees: int = 100
    impute_rounds: int = 10
    alpha: float = 0.05
    seed: int = 42
