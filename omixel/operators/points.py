"""Selection and validation at many points (weightings, conditions), each with a design matrix of its own.

The matrices are a keyed table: a row is a point with its samples, labels, features and one block of values.  What is fitted is a
table of tasks (point, fold, bootstrap).  Tasks are dealt to slices of a point, a point's row is sent to each of its slices, and
slices are cogrouped with it; so neither the driver nor the code carries a matrix, and work spreads over points, folds and bootstraps alike.
Models are of few samples: a block of more than MOST_VALUES values is refused."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..storage import stored
from .enrich import iqr, variance_filter
from .ml import MOST_VALUES
from .resample import _predict_one, _select, bootstrap_indices
from .similarity import clusters, combined_similarity, jaccard_pairs, representatives
from .stats import pairwise_correlation

SLICES = 16


def _kinds(df: DataFrame, columns: list[str]) -> str:
    return "".join(f"{c} {df.schema[c].dataType.simpleString()}, " for c in columns)


def filled_scores(scores: DataFrame, by: list[str]) -> DataFrame:
    """Missing scores of a set take its mean at the point, or 0 where it has none."""
    means = scores.groupBy(*by, "set_id").agg(F.avg("es").alias("__mean"))
    return scores.join(means, [*by, "set_id"]).withColumn("es", F.coalesce("es", "__mean", F.lit(0.0))).drop("__mean")


def nonredundant(scores: DataFrame, membership: DataFrame, by: list[str], config: Config = Config()) -> DataFrame:
    """by, set_id: of sets that overlap or correlate at a point, one of each cluster; then those of low variance go.

    Jaccard similarities do not depend on the point and are made once."""
    scored = scores.select(*by, "set_id").distinct()
    jaccard = jaccard_pairs(membership.join(scored.select("set_id").distinct(), "set_id", "left_semi"))
    correlation = pairwise_correlation(filled_scores(scores, by), "set_id", "sample_id", "es", by)
    members = clusters(scored, combined_similarity(jaccard, correlation, by), (config.similarity,), by)
    iqrs = stored(iqr(scores, by), "iqrs")
    kept = representatives(members.withColumn("ord", F.lit(0)), iqrs, by).select(*by, "set_id")
    left = stored(iqrs.join(kept, [*by, "set_id"], "left_semi"), "representatives")  # read for the cut and again for what is above it
    return variance_filter(left, config.iqr_percentile, by).select(*by, "set_id")


def designs(scores: DataFrame, samples: DataFrame, sets: DataFrame, by: list[str]) -> DataFrame:
    """by, n, features, y, x: a point's matrix of the given sets, samples in the order of their id, features in that of theirs; x row by row."""
    cells = filled_scores(scores, by).join(sets.select(*by, "set_id"), [*by, "set_id"], "left_semi").join(samples.select("sample_id", "y").filter("y is not null"), "sample_id")
    rows = cells.groupBy(*by, "sample_id", "y").agg(F.array_sort(F.collect_list(F.struct("set_id", "es"))).alias("row"))
    points = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("sample_id", "y", "row"))).alias("rows"))
    names, x = F.transform(F.col("rows")[0]["row"], lambda c: c["set_id"]), F.flatten(F.transform("rows", lambda r: F.transform(r["row"], lambda c: c["es"])))
    values = F.when(F.size(x) <= MOST_VALUES, x).otherwise(F.raise_error(F.lit(f"a point's matrix has more than {MOST_VALUES} values")))
    return points.select(*by, F.size("rows").alias("n"), names.alias("features"), F.transform("rows", lambda r: r["y"].cast("int")).alias("y"), values.alias("x"))


def fitted(tasks: DataFrame, matrices: DataFrame, by: list[str], slice_: Column, run: Callable[[np.ndarray, np.ndarray, list, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """run(x, y, features, tasks) for each slice of tasks of a point, with the point's keys added; `slice_` deals the tasks."""
    keys = [*by, "slice"]
    n = max(1, 8 * tasks.sparkSession.sparkContext.defaultParallelism)  # not left to the size of the rows, which says nothing of the work
    left = tasks.withColumn("slice", F.pmod(slice_, F.lit(SLICES)).cast("int")).repartition(n, *keys)
    again = matrices.select(*[F.col(c).alias(c) for c in matrices.columns])  # tasks are made of the same table
    right = again.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1)))).repartition(n, *keys)

    def one(some: pd.DataFrame, point: pd.DataFrame) -> pd.DataFrame:
        if some.empty or point.empty:
            return pd.DataFrame()
        row = point.iloc[0]
        x, y = np.asarray(row["x"], float).reshape(int(row["n"]), -1), np.asarray(row["y"], int)
        return run(x, y, list(row["features"]), some).assign(**{c: row[c] for c in by})

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(one, _kinds(matrices, by) + schema)


def _each(count: Column, name: str) -> Column:
    return F.explode(F.sequence(F.lit(0), count - 1)).alias(name)


def coefficients(matrices: DataFrame, by: list[str], config: Config = Config()) -> DataFrame:
    """by, b, status, set_id, coefficient: one elastic net for each point and bootstrap; the bootstraps are the same at every point."""

    def run(x: np.ndarray, y: np.ndarray, features: list, tasks: pd.DataFrame) -> pd.DataFrame:
        draws, out = bootstrap_indices(len(y), config.bootstraps, config.seed), []
        for b in tasks["b"]:
            status, w = _select(x[draws[b]], y[draws[b]], config)
            out.append(pd.DataFrame({"b": b, "status": status, "set_id": features, "coefficient": w}))
        return pd.concat(out)

    tasks = matrices.select(*by, _each(F.lit(config.bootstraps), "b"))
    return fitted(tasks, matrices, by, F.col("b"), run, f"b int, status string, set_id {_element(matrices)}, coefficient double")


def _element(matrices: DataFrame) -> str:
    return matrices.schema["features"].dataType.elementType.simpleString()


def frequency(coefficients: DataFrame, by: list[str]) -> DataFrame:
    """by, set_id, selection_prob: in how many of the fits that succeeded a set has a coefficient."""
    ok = coefficients.filter("status = 'ok'")
    return ok.groupBy(*by, "set_id").agg(F.avg((F.abs("coefficient") > 1e-8).cast("double")).alias("selection_prob"))


def stable_counts(frequencies: DataFrame, points: DataFrame, by: list[str], threshold: float = 0.60) -> DataFrame:
    """by, n_stable of all points; 0 where nothing was selected."""
    counts = frequencies.filter(F.col("selection_prob") >= threshold).groupBy(*by).agg(F.count("*").alias("n_stable"))
    return points.select(*by).distinct().join(counts, by, "left").withColumn("n_stable", F.coalesce("n_stable", F.lit(0)))


def leave_one_out(matrices: DataFrame, by: list[str], config: Config = Config()) -> DataFrame:
    """by, position, y, probability, predicted: a task for each point and sample."""

    def run(x: np.ndarray, y: np.ndarray, features: list, tasks: pd.DataFrame) -> pd.DataFrame:
        p = np.array([_predict_one(x, y, i, "logistic", config) for i in tasks["position"]])
        return pd.DataFrame({"position": tasks["position"].to_numpy(), "y": y[tasks["position"]], "probability": p, "predicted": (p > 0.5).astype(int)})

    return fitted(matrices.select(*by, _each(F.col("n"), "position")), matrices, by, F.col("position"), run, "position int, y int, probability double, predicted int")


def nested_leave_one_out(matrices: DataFrame, by: list[str], config: Config = Config()) -> DataFrame:
    """by, position, y, probability, predicted, n_features: sets are selected anew, on bootstraps of all other samples, for each sample.

    Without a bootstrap that can be fitted all sets are taken; without a stable set the share of class 1."""

    def select(x: np.ndarray, y: np.ndarray, features: list, tasks: pd.DataFrame) -> pd.DataFrame:
        draws, out = bootstrap_indices(len(y) - 1, config.inner_bootstraps, config.seed), []
        for fold, b in zip(tasks["position"], tasks["b"], strict=True):
            rest = np.delete(np.arange(len(y)), fold)[draws[b]]
            status, w = _select(x[rest], y[rest], config)
            out.append(pd.DataFrame({"position": fold, "ok": int(status == "ok"), "feature": np.append(-1, np.flatnonzero(np.abs(w) > 1e-8))}))
        return pd.concat(out)

    def fit(x: np.ndarray, y: np.ndarray, features: list, tasks: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for fold, some, kept in zip(tasks["position"], tasks["some"], tasks["kept"], strict=True):
            mask = np.zeros(x.shape[1], bool)
            mask[list(kept) if some else slice(None)] = True
            p = _predict_one(x[:, mask], y, fold, "logistic", config) if mask.any() else float(np.delete(y, fold).mean())
            rows.append((fold, int(y[fold]), p, int(p > 0.5), int(mask.sum())))
        return pd.DataFrame(rows, columns=["position", "y", "probability", "predicted", "n_features"])

    tasks = matrices.select(*by, "n", _each(F.col("n"), "position")).select(*by, "position", _each(F.lit(config.inner_bootstraps), "b"))
    chosen = fitted(tasks, matrices, by, F.hash("position", "b"), select, "position int, ok int, feature int")
    # feature -1 stands for the bootstrap itself; both kinds of counts are read, and all bootstraps are fitted for them once
    counts = stored(chosen.filter("ok = 1").groupBy(*by, "position", "feature").agg(F.count("*").alias("n")), "chosen")
    fits = counts.filter("feature = -1").select(*by, "position", F.col("n").alias("ok"))
    stable = counts.filter("feature >= 0").join(fits, [*by, "position"]).filter(F.col("n") / F.col("ok") >= config.stability).groupBy(*by, "position").agg(F.sort_array(F.collect_list("feature")).alias("kept"))
    folds = matrices.select(*by, _each(F.col("n"), "position")).join(fits, [*by, "position"], "left").join(stable, [*by, "position"], "left")
    folds = folds.select(*by, "position", F.col("ok").isNotNull().alias("some"), F.coalesce("kept", F.array().cast("array<int>")).alias("kept"))
    return fitted(folds, matrices, by, F.col("position"), fit, "position int, y int, probability double, predicted int, n_features int")


def metrics(predictions: DataFrame, by: list[str]) -> DataFrame:
    """by, accuracy, auc, kappa of each point, ties counted half.  The predictions are stored, so that what they come from runs once."""
    from .stats import mann_whitney_u

    predictions = stored(predictions, "predictions")
    y, p = F.col("y").cast("double"), F.col("predicted").cast("double")
    rates = predictions.groupBy(*by).agg(F.avg((F.col("y") == F.col("predicted")).cast("double")).alias("accuracy"), F.avg(y).alias("__y"), F.avg(p).alias("__p"))
    chance = F.col("__y") * F.col("__p") + (1 - F.col("__y")) * (1 - F.col("__p"))
    areas = mann_whitney_u(predictions, by, "probability", "y").select(*by, (F.col("u") / F.nullif(F.col("n1") * F.col("n0"), F.lit(0)).cast("double")).alias("auc"))
    out = rates.join(areas, by, "left").withColumn("kappa", (F.col("accuracy") - chance) / F.nullif(F.lit(1.0) - chance, F.lit(0.0)))
    return out.select(*by, "accuracy", "auc", "kappa")


def evaluated(scores: DataFrame, samples: DataFrame, membership: DataFrame, by: list[str], nested: bool, config: Config = Config()) -> DataFrame:
    """by, n_sets (that are left to select from), n_stable, loocv_accuracy, loocv_auc, loocv_kappa, and nested_ ones: the whole way from scores to
    validation at every point.  Null where a point has fewer than two stable sets."""
    sets = stored(nonredundant(scores, membership, by, config), "point-sets")
    full = stored(designs(scores, samples, sets, by), "designs")
    frequencies = stored(frequency(coefficients(full, by, config), by), "frequencies")
    stable = frequencies.filter(F.col("selection_prob") >= config.stability).select(*by, "set_id")
    enough = stable.groupBy(*by).agg(F.count("*").alias("n_stable")).filter("n_stable >= 2")
    small = stored(designs(scores, samples, stable.join(enough.select(*by), by, "left_semi"), by), "stable-designs")
    named = lambda m, prefix: m.select(*by, *[F.col(c).alias(f"{prefix}_{c}") for c in ("accuracy", "auc", "kappa")])
    out = sets.groupBy(*by).agg(F.count("*").alias("n_sets")).join(stable_counts(frequencies, scores, by, config.stability), by, "right")
    out = out.join(named(metrics(leave_one_out(small, by, config), by), "loocv"), by, "left")
    if nested:
        tried = full.join(enough.select(*by), by, "left_semi")
        out = out.join(named(metrics(nested_leave_one_out(tried, by, config), by), "nested"), by, "left")
    return out
