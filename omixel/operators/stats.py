"""Rank tests, false discovery rates, correlations, intervals."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..storage import stored
from .blocks import correlations
from .order import running, value_counts


def mid_ranks(rows: DataFrame, by: list[str], value: str, to: str = "mid") -> DataFrame:
    """Average rank of each value within its group, and how many share it (`peers`)."""
    ranked = running(stored(value_counts(rows, by, value), "ranked"), by, value, "sum", "peers", to)
    told = ranked.select(*[F.col(c).alias(f"__{c}") for c in (*by, value)], "peers", (F.col(to) - (F.col("peers") - 1) / 2.0).alias(to))
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in (*by, value)]
    return rows.filter(F.col(value).isNotNull()).join(told, same).drop(*[f"__{c}" for c in (*by, value)])


def mann_whitney_u(rows: DataFrame, by: list[str], value: str = "es", group: str = "y") -> DataFrame:
    """by, n1, n0, u (of group 1), ties (sum of t^3 - t), r = 1 - 2 u / (n1 n0).

    Distinct values and their counts are all that is ranked, by ranges of the value."""
    one = F.col(group) == 1
    counts = stored(value_counts(rows.filter(F.col(group).isNotNull()), by, value, ones=one, zeros=~one), "ranked")
    ranked = running(counts, by, value, "sum", "peers", "upto")
    size = F.col("peers").cast("double")
    sums = ranked.groupBy(*by).agg(
        F.sum("ones").alias("n1"), F.sum("zeros").alias("n0"), F.sum(F.col("ones") * (F.col("upto") - (size - 1) / 2.0)).alias("r1"), F.sum(size * size * size - size).alias("ties")
    )
    u = F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2.0
    return sums.withColumn("u", u).withColumn("r", F.lit(1.0) - F.lit(2.0) * F.col("u") / F.nullif(F.col("n1") * F.col("n0"), F.lit(0)).cast("double")).drop("r1")


def _exact_tails(n1: int, n0: int) -> np.ndarray:
    """The chance of each U or more, from 0 to n1 n0, without ties: subsets of ranks counted by their sum."""
    n1, n0 = sorted((n1, n0))
    counts = np.zeros((n1 + 1, n1 * n0 + 1))
    counts[0, 0] = 1
    for item in range(n1 + n0):
        for k in range(min(n1, item + 1), 0, -1):
            shift = item - (k - 1)  # what the k-th chosen rank adds to U
            if 0 <= shift <= n1 * n0:
                counts[k, shift:] += counts[k - 1, : n1 * n0 + 1 - shift]
    return counts[n1][::-1].cumsum()[::-1] / counts[n1].sum()


def _exact_p(u: float, n1: int, n0: int) -> float:
    return min(1.0, 2 * float(_exact_tails(n1, n0)[int(max(u, n1 * n0 - u))]))


def p_of_u(u: float, n1: int, n0: int, ties: float) -> float:
    """Exact for small groups without ties, else normal with tie and continuity corrections."""
    if not n1 or not n0:
        return math.nan
    if min(n1, n0) <= 8 and ties == 0:
        return _exact_p(u, n1, n0)
    n = n1 + n0
    s = math.sqrt(n1 * n0 / 12.0 * (n + 1 - ties / (n * (n - 1))))
    return min(1.0, math.erfc((max(u, n1 * n0 - u) - n1 * n0 / 2 - 0.5) / s / math.sqrt(2))) if s > 0 else 1.0


def mann_whitney_p(u: str = "u", n1: str = "n1", n0: str = "n0", ties: str = "ties") -> Column:
    """Exact for groups of which the smaller has at most 8 and no values are tied, else the normal branch; null without two groups.

    Python sees the exact rows only; it counts each pair of group sizes once a batch."""
    small = (F.least(n1, n0) <= 8) & (F.col(ties) == 0)

    def run(u: pd.Series, n1: pd.Series, n0: pd.Series) -> pd.Series:
        out = pd.Series(np.nan, index=u.index)
        wanted = (n1 > 0) & (n0 > 0)
        for (a, b), rows in u[wanted].groupby([n1[wanted], n0[wanted]]):
            tails = _exact_tails(int(a), int(b))
            out[rows.index] = np.minimum(1.0, 2 * tails[np.maximum(rows, a * b - rows).astype(int)])
        return out

    zero = F.lit(0)  # of large groups nothing is counted
    exact = F.pandas_udf(run, "double")(F.when(small, F.col(u)).otherwise(0.0), F.when(small, F.col(n1)).otherwise(zero), F.when(small, F.col(n0)).otherwise(zero))
    both = (F.col(n1) > 0) & (F.col(n0) > 0)
    return F.when(both & small, exact).when(both, F.coalesce(normal_p(F.col(u), F.col(n1), F.col(n0), F.col(ties)), F.lit(1.0)))


def normal_p(u: Column, n1: Column, n0: Column, ties: Column) -> Column:
    """The normal branch as an expression; the normal tail by a rational approximation (error below 1.2e-7)."""
    n = n1 + n0
    s = F.sqrt(n1 * n0 / 12.0 * (n + 1 - F.coalesce(ties / F.nullif(n * (n - 1), F.lit(0)).cast("double"), F.lit(0.0))))
    z = (F.greatest(u, n1 * n0 - u) - n1 * n0 / 2.0 - 0.5) / F.nullif(s, F.lit(0.0))
    x = F.greatest(z, F.lit(0.0)) / math.sqrt(2)
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.5) * x)
    series = F.lit(0.17087277)
    for c in (-0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223):
        series = F.lit(c) + t * series
    return F.least(F.lit(1.0), t * F.exp(-x * x + series))


def benjamini_hochberg(rows: DataFrame, p: str = "p", by: list[str] = ()) -> DataFrame:
    """q and whether it is at most 0.05: the least p m / rank over all ranks from here on; equal p have one q, a null p has none and does not count.

    The rows are read several times and so are stored, and the ranks of distinct p with them."""
    rows = stored(rows, "tests")
    group = F.struct(F.lit(0).alias("all"), *by)
    held = rows.filter(F.col(p).isNotNull()).groupBy(group.alias("__by"), F.col(p).alias("__p")).agg(F.count("*").alias("__n"))
    ranked = running(held, ["__by"], "__p", "sum", "__n", "__rank")
    sizes = held.groupBy("__by").agg(F.sum("__n").alias("__m"))
    raised = stored(ranked.join(sizes, "__by").withColumn("__raised", F.col("__p") * F.col("__m") / F.col("__rank")), "raised")
    least = running(raised, ["__by"], "__p", "min", "__raised", "__least", descending=True)
    told = least.select("__by", "__p", F.least(F.lit(1.0), F.col("__least")).alias("q"))
    keyed = rows.withColumn("__by", group)
    joined = keyed.join(told.withColumnRenamed("__by", "__of"), (keyed["__by"] == F.col("__of")) & (keyed[p] == F.col("__p")), "left")
    return joined.drop("__by", "__of", "__p").withColumn("significant", F.col("q") <= 0.05)


def pairwise_correlation(rows: DataFrame, item: str, on: str, value: str, by: list[str] = ()) -> DataFrame:
    """by, a < b and the Pearson correlation of what both have on `on`: by blocks of items, see there."""
    return correlations(rows.filter(F.col(value).isNotNull()), item, on, value, by)


def reproduced(again: DataFrame, stored: DataFrame, keys: list[str], value: str, tolerance: float = 0.01) -> DataFrame:
    """keys, again, stored and whether they differ by less than the tolerance; what only one of them holds is not reproduced."""
    both = again.select(*keys, F.col(value).alias("again")).join(stored.select(*keys, F.col(value).alias("stored")), keys, "full")
    return both.withColumn("same", F.coalesce(F.abs(F.col("again") - F.col("stored")) < tolerance, F.lit(False)))


def empirical_p(null: DataFrame, column: str, observed: float) -> DataFrame:
    """(b + 1) / (n + 1) with b of the n values at least as large as what was observed, and the null's summary."""
    c = F.col(column)
    return null.agg(
        ((F.count(F.when(c >= observed, 1)) + 1) / (F.count(c) + 1)).alias("p"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("sd"), F.max(c).alias("max")
    )


def _beta_share(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function, by its continued fraction: about sqrt(max(a, b)) steps."""
    if x <= 0.0 or x >= 1.0:
        return float(x >= 1.0)
    if x > (a + 1) / (a + b + 2):
        return 1.0 - _beta_share(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, m, c = 1e-300, 0, 1.0
    d = 1.0 / (1.0 - (a + b) * x / (a + 1) or tiny)
    value = d
    while True:
        m += 1
        before = value
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1.0 / (1.0 + step * d or tiny), 1.0 + step / c or tiny
            value *= d * c
        if abs(value - before) <= 1e-16 * abs(value) or m > 50 + 20 * math.sqrt(a + b):
            return front * value


def binomial_interval(k: int, n: int, alpha: float = 0.05) -> tuple[float, float]:
    """Clopper-Pearson: bounds at which the binomial tails have alpha / 2.  The tails are incomplete beta functions, so no sum runs over n."""

    def solve(f) -> float:
        a, b = 0.0, 1.0
        for _ in range(80):
            m = (a + b) / 2
            if m in (a, b):
                break
            a, b = (m, b) if f(m) else (a, m)
        return (a + b) / 2

    low = 0.0 if k == 0 else solve(lambda p: _beta_share(p, k, n - k + 1) < alpha / 2)
    high = 1.0 if k == n else solve(lambda p: _beta_share(1 - p, n - k, k + 1) > alpha / 2)
    return low, high


def clopper_pearson(rows: DataFrame, k: str = "k", n: str = "n", alpha: float = 0.05) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            bounds = [binomial_interval(int(a), int(b), alpha) for a, b in zip(f[k], f[n], strict=True)]
            yield f.assign(low=[x for x, _ in bounds], high=[x for _, x in bounds])

    return rows.mapInPandas(run, StructType([*rows.schema.fields, StructField("low", DoubleType()), StructField("high", DoubleType())]))


def metrics(rows: DataFrame, truth: str = "y", predicted: str = "predicted", score: str = "score") -> DataFrame:
    """One row: confusion counts, accuracy, Cohen's kappa, tie-aware area under the ROC curve, per-class report.

    Counts per score are all that is read again; they are stored, so that what the rows come from runs once."""
    t, p = F.col(truth), F.col(predicted)
    named = [(name, (t == a) & (p == b)) for name, a, b in (("tp", 1, 1), ("fn", 1, 0), ("fp", 0, 1), ("tn", 0, 0))]
    cells = [F.count(F.when(rule, 1)).alias(name) for name, rule in (*named, ("__n1", t == 1), ("__n0", t != 1))]
    told = rows.groupBy(F.col(score).cast("double").alias("__score")).agg(*cells)
    told = stored(told, "counts")
    counts = told.agg(*[F.coalesce(F.sum(name), F.lit(0)).alias(name) for name, _ in named])
    scored = told.filter("__score is not null")
    passed = running(scored, [], "__score", "sum", "__n0", "__upto")
    pairs = F.sum("__n1") * F.sum("__n0")
    area = passed.agg((F.sum(F.col("__n1") * (F.col("__upto") - F.col("__n0") / 2)) / F.nullif(pairs, F.lit(0)).cast("double")).alias("auc"))
    n = F.col("tp") + F.col("fn") + F.col("fp") + F.col("tn")
    agree = (F.col("tp") + F.col("tn")) / n
    chance = ((F.col("tp") + F.col("fn")) * (F.col("tp") + F.col("fp")) + (F.col("fp") + F.col("tn")) * (F.col("fn") + F.col("tn"))) / (n * n)
    ratio = lambda a, b: F.coalesce(F.col(a) / F.nullif(b, F.lit(0)), F.lit(0.0))
    out = counts.withColumns(
        {
            "accuracy": agree,
            "kappa": (agree - chance) / F.nullif(F.lit(1.0) - chance, F.lit(0.0)),
            "precision_1": ratio("tp", F.col("tp") + F.col("fp")),
            "recall_1": ratio("tp", F.col("tp") + F.col("fn")),
            "precision_0": ratio("tn", F.col("tn") + F.col("fn")),
            "recall_0": ratio("tn", F.col("tn") + F.col("fp")),
        }
    )
    return out.join(F.broadcast(area), how="cross")
