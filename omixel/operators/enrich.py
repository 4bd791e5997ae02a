"""Single-sample set enrichment, weights, set catalogues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions.numeric import combined_weight
from .order import quantiles, row_ranks


def present_sets(membership: DataFrame, features: DataFrame, least: int = 3) -> DataFrame:
    """Membership of measured features, in sets that have at least `least` of them."""
    here = membership.select("set_id", "feature").distinct().join(features.select("feature").distinct().hint("merge"), "feature", "left_semi")
    enough = here.groupBy("set_id").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    return here.join(enough.select("set_id"), "set_id", "left_semi")


def sized_sets(membership: DataFrame, least: int = 3, most: int = 500) -> DataFrame:
    """Sets of a size within bounds; of entries with one id the first (least `ord`) counts."""
    first = membership.groupBy("set_id").agg(F.min("ord").alias("ord"))
    kept = membership.join(first, ["set_id", "ord"])
    sizes = kept.groupBy("set_id").agg(F.count("*").alias("n_genes")).filter(F.col("n_genes").between(least, most))
    return kept.join(sizes, "set_id").drop("ord")


def weights(scores: DataFrame, config: Config = Config()) -> DataFrame:
    """feature, d, s -> feature, w."""
    return scores.select("feature", combined_weight(F.col("d"), F.col("s"), config.d_share, config.s_share, config.default_weight).alias("w"))


def with_fallback(scores: DataFrame, curated: DataFrame, features: DataFrame, least: int = 10, by: list[str] = ()) -> DataFrame:
    """feature, score: where fewer than `least` features (of a group, by columns of `features`) have a score, curated ones fill those that have none."""
    have = scores.filter("score is not null").select("feature", "score")
    groups = features.select("feature", *by).distinct()
    if not by:
        few = have.agg((F.count("*") < least).alias("few"))
        open_ = groups.join(F.broadcast(few), how="cross").filter("few")
    else:
        enough = groups.join(have, "feature").groupBy(*by).agg(F.count("*").alias("n")).filter(F.col("n") >= least)
        open_ = groups.join(enough, list(by), "left_anti")
    more = curated.join(open_.select("feature"), "feature", "left_semi").join(have, "feature", "left_anti")
    return have.unionByName(more.select("feature", "score"))


def degree_centrality(edges: DataFrame) -> DataFrame:
    """node, degree, centrality: endpoints counted on both sides, relative to the largest degree."""
    ends = edges.select(F.col("a").alias("node")).unionAll(edges.select(F.col("b").alias("node")))
    degrees = ends.groupBy("node").agg(F.count("*").alias("degree"))
    largest = degrees.agg(F.max("degree").alias("largest"))  # one row, whatever the number of nodes
    return degrees.join(F.broadcast(largest), how="cross").select("node", "degree", (F.col("degree") / F.col("largest")).alias("centrality"))


def _hit_sums(matrix: DataFrame, membership: DataFrame, scores: DataFrame, samples: DataFrame, config: Config, parts: dict[str, Column]) -> DataFrame:
    """set_id, sample_id, n (values of the sample), hits, sp, and of every part its sum and its sum times p (name, name_p), over a set's hits."""
    ranked = row_ranks(matrix.select("sample_id", "feature", "value"), ["sample_id"], "value", "feature", descending=True)
    sizes = matrix.filter("value is not null").groupBy("sample_id").agg(F.count("*").alias("n"))
    weighted = ranked.join(scores.hint("merge"), "feature", "left").withColumns(parts).withColumn("p", F.col("n") - F.col("rank") + 1)
    sets = present_sets(membership, matrix, config.min_present)
    sums = [f(F.col(k)).alias(name) for k in parts for f, name in ((F.sum, k), (lambda c: F.sum(c * F.col("p")), f"{k}_p"))]
    hits = weighted.join(sets.hint("merge"), "feature").groupBy("set_id", "sample_id").agg(F.count("*").alias("hits"), F.sum("p").alias("sp"), *sums)
    return sets.select("set_id").distinct().join(samples.select("sample_id"), how="cross").join(sizes, "sample_id", "left").join(hits, ["set_id", "sample_id"], "left")


def _score(a: Column, ap: Column, config: Config) -> Column:
    n = F.col("n").cast("double")
    es = (ap / a - (n * (n + 1) / 2 - F.col("sp")) / (n - F.col("hits"))) / n
    return F.when(F.coalesce("n", F.lit(0)) < config.min_observed, None).when(F.col("hits").isNull() | (F.col("hits") == F.col("n")) | (a == 0), 0.0).otherwise(es)


def ssgsea(matrix: DataFrame, membership: DataFrame, weight: DataFrame, samples: DataFrame, config: Config = Config()) -> DataFrame:
    """set_id, sample_id, es: weighted enrichment of every set in every sample.

    The running-sum difference summed over all ranks has a closed form in the hits alone: with p = n - rank + 1,
    es = (sum(a p) / sum(a) - (n (n + 1) / 2 - sum(p)) / (n - hits)) / n, a = |value| * weight.
    So samples are ranked once, by ranges of the value, one join finds the hits, and one aggregate does the rest; the aggregate is
    partial before its shuffle.  Null where a sample has too few values; 0 where a set hits none or all of them."""
    sums = _hit_sums(matrix, membership, weight, samples, config, {"a": F.abs("value") * F.coalesce("w", F.lit(config.default_weight))})
    return sums.select("set_id", "sample_id", _score(F.col("a"), F.col("a_p"), config).alias("es"))


def ssgsea_grid(matrix: DataFrame, membership: DataFrame, scores: DataFrame, samples: DataFrame, points: list[tuple[float, float]], config: Config = Config()) -> DataFrame:
    """alpha, beta, set_id, sample_id, es: the scores under every weighting 1 + alpha d + beta s (a missing d or s counts as 0).

    The sums over hits are linear in alpha and beta, so three pairs of sums, made once, give all points; the points multiply
    the rows only after the aggregate."""
    size = F.abs("value")
    parts = {"one": size, "by_d": size * F.coalesce("d", F.lit(0.0)), "by_s": size * F.coalesce("s", F.lit(0.0))}
    sums = _hit_sums(matrix, membership, scores.select("feature", "d", "s"), samples, config, parts)
    at = F.explode(F.array(*[F.struct(F.lit(float(a)).alias("alpha"), F.lit(float(b)).alias("beta")) for a, b in points]))
    each = sums.withColumn("at", at).select("*", "at.alpha", "at.beta")
    total = lambda end: F.col("one" + end) + F.col("alpha") * F.col("by_d" + end) + F.col("beta") * F.col("by_s" + end)
    return each.select("alpha", "beta", "set_id", "sample_id", _score(total(""), total("_p"), config).alias("es"))


def group_means(scores: DataFrame, samples: DataFrame) -> DataFrame:
    """set_id, mean_1, mean_0, diff, abs_diff."""
    by = scores.join(samples, "sample_id").groupBy("set_id").agg(F.avg(F.when(F.col("y") == 1, F.col("es"))).alias("mean_1"), F.avg(F.when(F.col("y") == 0, F.col("es"))).alias("mean_0"))
    return by.withColumn("diff", F.col("mean_1") - F.col("mean_0")).withColumn("abs_diff", F.abs("diff"))


def iqr(scores: DataFrame, by: list[str] = ()) -> DataFrame:
    """by, set_id, iqr: exact quartiles with linear interpolation, nulls left out; 0 with fewer than two values."""
    quartiles = quantiles(scores, [*by, "set_id"], "es", [0.25, 0.75])
    spread = F.when(F.col("n") > 1, F.col("q")[1] - F.col("q")[0]).otherwise(0.0)
    return scores.select(*by, "set_id").distinct().join(quartiles.select(*by, "set_id", spread.alias("iqr")), [*by, "set_id"], "left").withColumn("iqr", F.coalesce("iqr", F.lit(0.0)))


def variance_filter(iqrs: DataFrame, percentile: float = 0.05, by: list[str] = ()) -> DataFrame:
    """Sets whose interquartile range is above the percentile of all (of their group); ties with it go."""
    cut = quantiles(iqrs, list(by), "iqr", [percentile]).select(*by, F.col("q")[0].alias("cut"))
    return (iqrs.join(cut, list(by)) if by else iqrs.join(F.broadcast(cut), how="cross")).filter("iqr > cut")


def with_symbols(rows: DataFrame, symbols: DataFrame, on: str) -> DataFrame:
    """All rows with their symbol, null where there is none; AQE broadcasts a small map, a large one is merged."""
    return rows.join(symbols, on, "left")


def best_hits(names: DataFrame, catalogue: DataFrame, name: str, key: str, *order: Column, n: int = 5) -> DataFrame:
    """query_original, query_clean, hit (from 1) and the catalogue's columns: for each name the first n entries of the same cleaned name.

    Names are cut at their first bracket and compared in lower case; a name without a hit, null or empty has no row.
    The first n of an entry's name are taken before the join, so that a common name never multiplies more than n rows."""
    clean = F.trim(F.regexp_extract(name, r"^([^(]+)", 1))
    asked = names.select(F.col(name).alias("query_original"), clean.alias("query_clean")).filter("query_clean <> ''").withColumn("__key", F.lower("query_clean"))
    entries = catalogue.withColumn("__key", F.lower(F.trim(key)))
    entries = entries.withColumn("hit", F.row_number().over(Window.partitionBy("__key").orderBy(*order))).filter(F.col("hit") <= n)
    return asked.join(entries, "__key").drop("__key")
