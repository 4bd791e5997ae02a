"""Long matrices (sample_id, feature, value): missingness, dedup, filling, scaling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import tier
from .order import quantiles


def missing_rate(matrix: DataFrame, features: DataFrame, n_samples: int | Column) -> DataFrame:
    """Per feature: observed, missing, rate.  Features without any value count as all missing."""
    n = F.lit(n_samples) if isinstance(n_samples, int) else n_samples
    observed = matrix.groupBy("feature").agg(F.count("value").alias("observed"))
    out = features.select("feature").distinct().join(observed, "feature", "left").withColumn("observed", F.coalesce("observed", F.lit(0)))
    return out.withColumn("missing", n - F.col("observed")).withColumn("rate", F.lit(1.0) - F.col("observed") / n)


def tiers(rates: DataFrame, first: float = 0.5, second: float = 0.8) -> DataFrame:
    return rates.withColumn("tier", tier(F.col("rate"), first, second))


def detection_by_sample(matrix: DataFrame, samples: DataFrame, n_features: int) -> DataFrame:
    counts = samples.join(matrix.groupBy("sample_id").agg(F.count("value").alias("detected")), "sample_id", "left").withColumn("detected", F.coalesce("detected", F.lit(0)))
    return counts.withColumn("rate", F.col("detected") / n_features).withColumn("mean_rate", F.avg("rate").over(Window.partitionBy()))


def detection_ecdf(rates: DataFrame) -> DataFrame:
    """Distinct missing rates and the share of features at or below each: one row per distinct rate enters the window."""
    counts = rates.groupBy("rate").agg(F.count("*").alias("n"))
    up_to = Window.orderBy("rate").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return counts.select("rate", "n", (F.sum("n").over(up_to) / F.sum("n").over(Window.partitionBy())).alias("share"))


def keep_best(rows: DataFrame, key: Column, *order: Column) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("__n = 1").drop("__n")


def first_n(rows: DataFrame, n: int, by: list[str], *order: Column) -> DataFrame:
    """The first n rows of each group; Spark limits each task's groups before the shuffle."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= n)


def fill(matrix: DataFrame, samples: DataFrame, policy: str = "feature_mean") -> DataFrame:
    """Every (sample, feature), missing values filled with the feature's mean, the sample's mean, or zero."""
    cells = samples.select("sample_id").join(matrix.select("feature").distinct(), how="cross").join(matrix, ["sample_id", "feature"], "left")
    mean = {"feature_mean": F.avg("value").over(Window.partitionBy("feature")), "sample_mean": F.avg("value").over(Window.partitionBy("sample_id")), "zero": F.lit(0.0)}[policy]
    return cells.withColumn("filled", F.coalesce("value", mean))


def zscores(matrix: DataFrame, by: str = "feature", value: str = "value") -> DataFrame:
    """(x - mean) / population deviation, 1 where that is 0."""
    group = Window.partitionBy(by)
    deviation = F.coalesce(F.nullif(F.stddev_pop(value).over(group), F.lit(0.0)), F.lit(1.0))
    return matrix.withColumn("z", (F.col(value) - F.avg(value).over(group)) / deviation)


def feature_arrays(filled: DataFrame, value: str = "filled") -> DataFrame:
    """One row per sample: its values in the order of the features."""
    pairs = F.sort_array(F.collect_list(F.struct("feature", F.col(value).alias("x"))))
    return filled.groupBy("sample_id").agg(pairs.alias("pairs")).select("sample_id", F.transform("pairs", lambda p: p["x"]).alias("features"))


def histogram(values: DataFrame, column: str, low: float, width: float) -> DataFrame:
    return values.select(F.floor((F.col(column) - F.lit(low)) / F.lit(width)).cast("long").alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))


def kernel_density(values: DataFrame, column: str, grid: list[float]) -> DataFrame:
    """Gaussian kernel density with Silverman's bandwidth at a fixed grid of points."""
    points = values.select(F.col(column).alias("x")).filter("x is not null")
    spread = quantiles(points, [], "x", [0.25, 0.75]).select((F.col("q")[1] - F.col("q")[0]).alias("iqr"))
    stats = points.agg(F.count("*").alias("n"), F.stddev("x").alias("s")).join(F.broadcast(spread), how="cross")
    width = F.lit(0.9) * F.least("s", F.col("iqr") / 1.34) * F.pow(F.col("n"), F.lit(-0.2))
    stats = stats.select("n", F.when(width > 0, width).otherwise(F.lit(1e-9)).alias("h"))
    dots = points.join(F.broadcast(stats), how="cross").withColumn("point", F.explode(F.array(*[F.lit(float(g)) for g in grid])))
    return dots.groupBy("point").agg((F.sum(F.exp(F.lit(-0.5) * F.pow((F.col("point") - F.col("x")) / F.col("h"), F.lit(2.0)))) / (F.first("n") * F.first("h") * 2.5066282746310002)).alias("density"))


def complete_features(matrix: DataFrame, samples: DataFrame, detected: float = 0.6, least: int = 5) -> DataFrame:
    """The matrix's rows of features that reach the detection rate and lack no sample; none where fewer than `least` features do."""
    values = matrix.filter(F.col("value").isNotNull()).join(samples.select("sample_id"), "sample_id", "left_semi")
    n = samples.agg(F.count_distinct("sample_id").alias("n_samples"))
    seen = values.groupBy("feature").agg(F.count_distinct("sample_id").alias("n")).join(F.broadcast(n), how="cross")
    full = seen.filter((F.col("n") >= detected * F.col("n_samples")) & (F.col("n") == F.col("n_samples"))).select("feature")
    enough = full.agg((F.count("*") >= least).alias("enough"))
    return values.join(full.join(F.broadcast(enough), how="cross").filter("enough").select("feature"), "feature", "left_semi")
