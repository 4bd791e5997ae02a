"""Elastic nets on any number of rows, all bootstraps at once.

Rows are packed into blocks: standardised features, labels, and a column of weights for each bootstrap.  A bootstrap is a Poisson draw
for each row by a hash of its id and the bootstrap's number, so it needs no list of rows.  One pass over the blocks gives the gradients
of all bootstraps: two matrix products a block, sums by task, one aggregate.  Passes are proximal steps; what comes
to the driver is as large as the coefficients, (features + 1) x bootstraps, however many rows there are."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.solvers import sigmoid
from ..storage import stored

ROWS = 4096
_POISSON = np.cumsum(np.exp(-1) / np.cumprod(np.concatenate([[1.0], np.arange(1.0, 15.0)])))


def multiplicities(keys: np.ndarray, times: int, seed: int) -> np.ndarray:
    """How often each row (a 64-bit key) is in each bootstrap: Poisson draws of mean 1, rows x times."""
    x = keys.astype(np.uint64)[:, None] ^ (np.arange(1, times + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))[None]
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return np.searchsorted(_POISSON, (x >> np.uint64(11)) / float(1 << 53), side="right").astype(np.uint8)


def _total(blocks: DataFrame, make: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of make(x, y, weights) over all blocks."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for f in frames:
            for x, y, w in zip(f["x"], f["y"], f["w"], strict=True):
                labels = np.frombuffer(y, np.uint8)
                part = make(np.frombuffer(x, "<f8").reshape(len(labels), -1), labels, np.frombuffer(w, np.uint8).reshape(len(labels), -1)).ravel()
                total = part if total is None else total + part
        if total is not None:
            yield pd.DataFrame({"i": np.arange(len(total)), "v": total})

    got = blocks.mapInPandas(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).toPandas().sort_values("i")
    return got["v"].to_numpy()


def packed(rows: DataFrame, key: Column, features: str, label: str, mean: list[float], deviation: list[float], times: int, seed: int) -> DataFrame:
    """x (rows x features and a 1), y, w: blocks of rows."""
    centre, scale = np.array(mean), np.array(deviation)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for i in range(0, len(f), ROWS):
                some = f.iloc[i : i + ROWS]
                x = (np.stack(some["v"].to_numpy()).astype(float) - centre) / scale
                z = np.hstack([x, np.ones((len(x), 1))])
                w = multiplicities(some["k"].to_numpy().view(np.uint64), times, seed)
                yield pd.DataFrame([[z.tobytes(), some["y"].to_numpy(np.uint8).tobytes(), w.tobytes()]], columns=["x", "y", "w"])

    values = rows.select(key.alias("k"), F.col(features).cast("array<double>").alias("v"), F.col(label).cast("int").alias("y")).filter("v is not null and y is not null")
    return stored(values.mapInPandas(run, "x binary, y binary, w binary"), "row-blocks")


def _moments(rows: DataFrame, features: str) -> tuple[list[float], list[float]]:
    at = rows.select(F.posexplode(F.col(features).cast("array<double>")).alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    got = at.orderBy("i").collect()  # a row a feature
    return [r.m for r in got], [r.s if r.s and r.s > 0 else 1.0 for r in got]


def bootstrapped_elastic_nets(rows: DataFrame, key: Column, features: str, label: str, c: float, l1_ratio: float, times: int = 200, seed: int = 42, passes: int = 400, tolerance: float = 1e-7) -> pd.DataFrame:
    """b, status, position, coefficient (the intercept's position is the number of features) of an elastic net on each bootstrap of the rows.

    Each minimises c * sum(weight * loss) + l1_ratio |coef|_1 + (1 - l1_ratio) |coef|^2 / 2 with class weights that balance the bootstrap, on
    features standardised over all rows.  A bootstrap of one class has status `one class` and no coefficients; no rows give no bootstraps.
    Raises RuntimeError where `passes` do not suffice."""
    mean, deviation = _moments(rows.filter(F.col(label).isNotNull()), features)
    if not mean:
        return pd.DataFrame({"b": [], "status": [], "position": [], "coefficient": []})
    blocks, p = packed(rows, key, features, label, mean, deviation, times, seed), len(mean)
    sizes = _total(blocks, lambda x, y, w: np.stack([(w * y[:, None]).sum(0, dtype=float), (w * (1 - y)[:, None]).sum(0, dtype=float)])).reshape(2, times)
    ok = (sizes > 0).all(0)
    of = np.where(sizes > 0, 0.5 / np.maximum(sizes, 1), 0.0)  # each class weighs a half

    def weighted(y: np.ndarray, w: np.ndarray) -> np.ndarray:
        return w * np.where(y[:, None] == 1, of[0], of[1])

    v = np.full((p + 1, times), 1 / np.sqrt(p + 1)) + np.random.default_rng(seed).normal(scale=0.1, size=(p + 1, times))
    for _ in range(12):  # power iteration: the largest curvature of each bootstrap
        v /= np.linalg.norm(v, axis=0)
        v = _total(blocks, lambda x, y, w, v=v: x.T @ (weighted(y, w) * (x @ v))).reshape(p + 1, times)
    scale = 1 / (c * np.maximum(sizes.sum(0), 1))
    l2 = np.append(np.ones(p), 0.0)[:, None] * ((1 - l1_ratio) * scale)
    largest = 1.1 * np.linalg.norm(v, axis=0) / 4 + l2.max(0) + 1e-12
    l1 = np.append(np.ones(p), 0.0)[:, None] * (l1_ratio * scale / largest)
    b = np.zeros((p + 1, times))
    ahead, t = b.copy(), np.ones(times)
    for _ in range(passes):
        gradient = _total(blocks, lambda x, y, w, a=ahead: x.T @ (weighted(y, w) * (sigmoid(x @ a) - y[:, None]))).reshape(p + 1, times) + l2 * ahead
        moved = ahead - gradient / largest
        new = moved - np.clip(moved, -l1, l1)
        step = new - b
        t[((ahead - new) * step).sum(0) > 0] = 1.0
        following = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead = new + (t - 1) / following * step
        b, t = new, following
        if (np.abs(step).max(0)[ok] <= tolerance * np.maximum(1.0, np.abs(b).max(0)[ok])).all():
            break
    else:
        raise RuntimeError(f"not settled after {passes} passes")
    b[:, ~ok] = 0.0
    at, which = np.meshgrid(np.arange(p + 1), np.arange(times), indexing="ij")
    return pd.DataFrame({"b": which.ravel(), "status": np.where(ok, "ok", "one class")[which.ravel()], "position": at.ravel(), "coefficient": b.ravel()})
