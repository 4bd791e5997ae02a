"""Resampling: bootstraps, folds, permutations, simulations.

A resample is a row of a task table; each task gets the small training matrix with its code and runs on
its own, so the work spreads over the cluster however the tasks are nested.  A nested validation is (fold, bootstrap) tasks
followed by one task a fold.  The matrix is what a model of few samples is fitted on; its size is checked."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..functions.solvers import Forest, auc, cross_validated, cross_validated_elastic_net, kappa, ledoit_wolf, logistic_l2, sigmoid, standardise, stratified_folds
from .ml import MOST_VALUES
from .order import quantiles


def _tasks(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    n = max(1, min(len(rows), 4 * spark.sparkContext.defaultParallelism))
    return spark.createDataFrame(rows, schema).repartition(n)


def _checked(x: np.ndarray) -> None:
    if x.size > MOST_VALUES:
        raise ValueError(f"{x.size} values: a resampled matrix has {MOST_VALUES} at most")


def bootstrap_indices(n: int, times: int, seed: int) -> list[list[int]]:
    rng = np.random.RandomState(seed)
    return [rng.choice(n, size=n, replace=True).tolist() for _ in range(times)]


def _select(x: np.ndarray, y: np.ndarray, config: Config) -> tuple[str, np.ndarray]:
    """('ok', coefficients) of one elastic-net fit, or why there is none."""
    if len(np.unique(y)) < 2:
        return "one class", np.zeros(x.shape[1])
    try:
        b = cross_validated_elastic_net(standardise(x)[0], y, config.l1_ratios, config.n_cs, config.folds)
    except ValueError:
        return "too few of a class", np.zeros(x.shape[1])
    return "ok", b[:-1]


def bootstrap_coefficients(spark: SparkSession, x: np.ndarray, y: np.ndarray, config: Config = Config()) -> DataFrame:
    """b, status, position, coefficient: one elastic net per bootstrap."""
    _checked(x)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for b, at in zip(f["b"], f["at"], strict=True):
                status, w = _select(x[at], y[at], config)
                yield pd.DataFrame({"b": b, "status": status, "position": np.arange(len(w)), "coefficient": w})

    rows = list(enumerate(bootstrap_indices(len(y), config.bootstraps, config.seed)))
    return _tasks(spark, rows, "b int, at array<int>").mapInPandas(run, "b int, status string, position int, coefficient double")


def selection_frequency(coefficients: DataFrame) -> DataFrame:
    """position, selection_prob, mean_coef, direction over the bootstraps that succeeded."""
    ok = coefficients.filter("status = 'ok'").groupBy("position")
    out = ok.agg(F.avg((F.abs("coefficient") > 1e-8).cast("double")).alias("selection_prob"), F.avg("coefficient").alias("mean_coef"))
    return out.withColumn("direction", F.when(F.col("mean_coef") > 0, "up").when(F.col("mean_coef") < 0, "down").otherwise("-"))


def stable(frequency: DataFrame, threshold: float = 0.60) -> DataFrame:
    return frequency.filter(F.col("selection_prob") >= threshold)


def threshold_sweep(frequency: DataFrame, thresholds: tuple[float, ...]) -> DataFrame:
    grid = F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold")
    return frequency.select(grid, "selection_prob").groupBy("threshold").agg(F.count_if(F.col("selection_prob") >= F.col("threshold")).alias("n_stable"))


def _predict_one(x: np.ndarray, y: np.ndarray, i: int, kind: str, config: Config) -> float:
    """Probability of item i from a model of all others; their share of class 1 where no model can be fitted."""
    train = np.arange(len(y)) != i
    a, mean, deviation = standardise(x[train])
    if kind == "forest":
        return float(Forest(seed=config.seed).fit(x[train], y[train]).probability(x[i : i + 1])[0])
    try:
        b, _, _ = cross_validated(a, y[train], n_cs=config.n_cs, folds=config.folds)
    except ValueError:
        return float(y[train].mean())
    return float(sigmoid((x[i] - mean) / deviation @ b[:-1] + b[-1]))


def leave_one_out(spark: SparkSession, x: np.ndarray, y: np.ndarray, kind: str = "logistic", config: Config = Config()) -> DataFrame:
    """position, y, probability, predicted: one task an item; metrics() pools them."""
    _checked(x)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            p = np.array([_predict_one(x, y, i, kind, config) for i in f["position"]])
            yield pd.DataFrame({"position": f["position"], "y": y[f["position"]], "probability": p, "predicted": (p > 0.5).astype(int)})

    return _tasks(spark, [(i,) for i in range(len(y))], "position int").mapInPandas(run, "position int, y int, probability double, predicted int")


def stratified_predictions(x: np.ndarray, y: np.ndarray, k: int = 10, c: float = 1.0) -> np.ndarray:
    """Held-out probabilities: k folds for more than 100 items, else one item at a time."""
    fold = stratified_folds(y, k) if len(y) > 100 else np.arange(len(y))
    out = np.zeros(len(y))
    for f in np.unique(fold):
        train = fold != f
        a, mean, deviation = standardise(x[train])
        b = logistic_l2(a, y[train], c)
        out[~train] = sigmoid((x[~train] - mean) / deviation @ b[:-1] + b[-1])
    return out


def nested_leave_one_out(spark: SparkSession, x: np.ndarray, y: np.ndarray, config: Config = Config()) -> DataFrame:
    """position, y, probability, predicted, n_features: features are selected anew without each item."""
    _checked(x)
    n = len(y)
    draws = bootstrap_indices(n - 1, config.inner_bootstraps, config.seed)

    def select(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for fold, b in zip(f["position"], f["b"], strict=True):
                rest = np.delete(np.arange(n), fold)[draws[b]]
                status, w = _select(x[rest], y[rest], config)
                yield pd.DataFrame({"position": [fold], "ok": [int(status == "ok")], "chosen": [(np.abs(w) > 1e-8).astype(int).tolist()]})

    def fit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for fold, ok, counts in zip(f["position"], f["ok"], f["counts"], strict=True):
                mask = np.array(counts) / ok >= config.stability if ok else np.ones(x.shape[1], bool)
                train = np.arange(n) != fold
                p = _predict_one(x[:, mask], y, fold, "logistic", config) if mask.any() else float(y[train].mean())
                rows.append((fold, int(y[fold]), p, int(p > 0.5), int(mask.sum())))
            yield pd.DataFrame(rows, columns=["position", "y", "probability", "predicted", "n_features"])

    chosen = _tasks(spark, [(i, b) for i in range(n) for b in range(config.inner_bootstraps)], "position int, b int").mapInPandas(select, "position int, ok int, chosen array<int>")
    sums = chosen.groupBy("position").agg(F.sum("ok").alias("ok"), F.array(*[F.sum(F.col("chosen")[j]) for j in range(x.shape[1])]).alias("counts"))
    return sums.mapInPandas(fit, "position int, y int, probability double, predicted int, n_features int")


def permutation_null(spark: SparkSession, x: np.ndarray, y: np.ndarray, config: Config = Config(), c: float = 1.0) -> DataFrame:
    """permutation, accuracy: leave-one-out accuracy under shuffled labels."""
    _checked(x)
    rng = np.random.RandomState(config.seed)
    shuffled = [rng.permutation(y).tolist() for _ in range(config.permutations)]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            scores = []
            for labels in f["labels"]:
                t, right = np.array(labels), 0
                for i in range(len(t)):
                    train = np.arange(len(t)) != i
                    if len(np.unique(t[train])) < 2:
                        right += int(round(t[train].mean()) == t[i])
                        continue
                    a, mean, deviation = standardise(x[train])
                    b = logistic_l2(a, t[train], c, rounds=20)
                    right += int(((x[i] - mean) / deviation @ b[:-1] + b[-1] > 0) == (t[i] == 1))
                scores.append(right / len(t))
            yield pd.DataFrame({"permutation": f["permutation"], "accuracy": scores})

    return _tasks(spark, list(enumerate(shuffled)), "permutation int, labels array<int>").mapInPandas(run, "permutation int, accuracy double")


def class_model(x: np.ndarray, y: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray, float]]:
    """Mean, shrunk covariance and shrinkage of each class."""
    return {k: (x[y == k].mean(0), *ledoit_wolf(x[y == k])) for k in (0, 1)}


def power_curve(spark: SparkSession, x: np.ndarray, y: np.ndarray, sizes: tuple[int, ...], simulations: int, config: Config = Config()) -> DataFrame:
    """n_total, simulation, accuracy, auc: cross-validated accuracy on samples drawn from the fitted classes."""
    _checked(x)
    model, share = class_model(x, y), float(y.mean())

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for size, s in zip(f["n_total"], f["simulation"], strict=True):
                rng, n1 = np.random.default_rng(config.seed + int(s)), int(round(size * share))
                drawn = np.vstack([rng.multivariate_normal(*model[1][:2], size=n1), rng.multivariate_normal(*model[0][:2], size=size - n1)])
                t = np.append(np.ones(n1, int), np.zeros(size - n1, int))
                p = stratified_predictions(drawn, t)
                rows.append((size, s, float(((p > 0.5) == (t == 1)).mean()), auc(t, p), kappa(t, (p > 0.5).astype(int))))
            yield pd.DataFrame(rows, columns=["n_total", "simulation", "accuracy", "auc", "kappa"])

    return _tasks(spark, [(n, s) for n in sizes for s in range(simulations)], "n_total int, simulation int").mapInPandas(run, "n_total int, simulation int, accuracy double, auc double, kappa double")


def summary(runs: DataFrame, by: str, value: str = "accuracy") -> DataFrame:
    bounds = quantiles(runs, [by], value, [0.025, 0.975]).select(by, F.col("q")[0].alias("ci_low"), F.col("q")[1].alias("ci_high"))
    return runs.groupBy(by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd")).join(bounds, by, "left")


def recommended_n(table: DataFrame, mean: float = 0.90, low: float = 0.833) -> DataFrame:
    return table.filter((F.col("mean") >= mean) & (F.col("ci_low") > low)).agg(F.min("n_total").alias("recommended_n"))
