"""Column functions on numbers: logarithms, weights, tiers, labels of tests."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def log2_positive(value: Column, strict: bool = False) -> Column:
    """log2 of positive values, else null; strict also drops logarithms that are not positive."""
    out = F.when(value > 0, F.log2(value))
    return F.when(out > 0, out) if strict else out


def combined_weight(d: Column, s: Column, d_share: float = 0.6, s_share: float = 0.4, default: float = 0.3) -> Column:
    d, s = F.coalesce(d, F.lit(0.0)), F.coalesce(s, F.lit(0.0))
    return F.when((d > 0) | (s > 0), F.lit(d_share) * d + F.lit(s_share) * s).otherwise(F.lit(default))


def parametric_weight(d: Column, c: Column, alpha: Column | float, beta: Column | float) -> Column:
    return F.lit(1.0) + F.lit(alpha) * F.coalesce(d, F.lit(0.0)) + F.lit(beta) * F.coalesce(c, F.lit(0.0))


def tier(rate: Column, first: float = 0.5, second: float = 0.8) -> Column:
    return F.when(rate == 0, "Complete").when(rate <= first, "Tier1").when(rate <= second, "Tier2").otherwise("Tier3")


def magnitude_bucket(x: Column, steps: int = 4096) -> Column:
    """A whole number that never falls where a double rises: its power of two and `steps` steps within it, negated below zero.

    It splits an order into ranges without looking at the data; how many there are is bounded by the number format."""
    size = F.abs(x)
    power = F.floor(F.log2(size))
    at = (power + 1100) * steps + F.floor((size / F.pow(F.lit(2.0), power) - 1) * steps)
    finite = F.when(x == 0, F.lit(0)).otherwise(F.signum(x).cast("long") * at)
    edge = F.lit(4000 * steps)
    return F.when(F.isnan(x) | (x == math.inf), edge).when(x == -math.inf, -edge).otherwise(finite).cast("long")


def stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")


def direction(x: Column, up: str = "up", down: str = "down", none: str = "-") -> Column:
    return F.when(x > 0, up).when(x < 0, down).otherwise(none)


def minus_log10(p: Column) -> Column:
    return -F.log10(F.greatest(p, F.lit(1e-300)))


def dot_size(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(6.0)) * 40 + 20


def theme_match(in_first: Column, in_second: Column, first: str, second: str) -> Column:
    return F.when(in_first & in_second, "Both").when(in_first, first).when(in_second, second).otherwise("Neither")


def logistic(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))
