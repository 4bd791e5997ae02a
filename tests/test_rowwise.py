"""Elastic nets on rows against the solver in memory; components of wide matrices against a singular value decomposition."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from omixel.functions import solvers
from omixel.operators import ml, rowwise


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 6)) * [1, 2, 3, 1, 1, 0] + 5
    y = (x[:, 0] - x[:, 1] / 2 + rng.normal(size=300) > 2.5).astype(int)
    rows = [(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, y, strict=True))] + [(1000, None, 1), (1001, [0.0] * 6, None)]
    return spark.createDataFrame(rows, "id long, v array<double>, y int").repartition(3), x, y


def test_equal_to_the_solver(table):
    df, x, y = table
    fits = rowwise.bootstrapped_elastic_nets(df, F.col("id"), "v", "y", c=0.5, l1_ratio=0.6, times=5, tolerance=1e-9)
    scaled, _, _ = solvers.standardise(x)
    counts = rowwise.multiplicities(np.arange(300), 5, 42)
    assert abs(counts.mean() - 1) < 0.1 and abs(counts.var() - 1) < 0.2
    for b in range(5):
        times = np.repeat(np.arange(300), counts[:, b])
        want = solvers.logistic_elastic_net(scaled[times], y[times], 0.5, 0.6, rounds=20_000, tolerance=1e-13)
        got = fits[fits.b == b].sort_values("position")
        assert (got.status == "ok").all() and np.allclose(got.coefficient, want, atol=1e-6)


def test_one_class_and_nothing(table):
    df, _, _ = table
    fits = rowwise.bootstrapped_elastic_nets(df.filter("y = 1"), F.col("id"), "v", "y", 0.5, 0.6, times=2)
    assert set(fits.status) == {"one class"} and (fits.coefficient == 0).all()
    assert len(rowwise.bootstrapped_elastic_nets(df.limit(0), F.col("id"), "v", "y", 0.5, 0.6, times=2)) == 0
    with pytest.raises(RuntimeError, match="settled"):
        rowwise.bootstrapped_elastic_nets(df, F.col("id"), "v", "y", 0.5, 0.6, times=2, passes=2)


def test_wide_components(spark):
    """Twenty thousand features, of which a few cells are missing."""
    rng = np.random.default_rng(6)
    m = rng.normal(size=(12, 20_000)) + 10
    m[:6, :3000] += 1.5
    m[rng.random(m.shape) < 0.01] = np.nan
    wide = spark.createDataFrame([(f"s{i:02d}", row.tolist()) for i, row in enumerate(m)], "sample_id string, v array<double>")
    rows = wide.select("sample_id", F.posexplode("v").alias("feature", "value")).filter("not isnan(value)")
    got = sorted(ml.wide_components(rows).collect(), key=lambda r: r.sample_id)
    filled = np.where(np.isnan(m), np.nanmean(m, 0), m)
    u, s, _ = np.linalg.svd(filled - filled.mean(0), full_matrices=False)
    scores = np.array([r.scores for r in got])
    for k in range(2):
        want = u[:, k] * s[k]
        assert min(np.abs(scores[:, k] - want).max(), np.abs(scores[:, k] + want).max()) < 1e-6
    assert np.allclose(got[0].explained, (s**2 / (s**2).sum())[:2])


def test_wide_components_of_few(spark, monkeypatch):
    empty = spark.createDataFrame([], "sample_id string, feature int, value double")
    assert ml.wide_components(empty).collect() == []
    one = spark.createDataFrame([("a", 1, 2.0), ("a", 2, 3.0)], "sample_id string, feature int, value double")
    assert [(r.sample_id, r.scores) for r in ml.wide_components(one).collect()] == [("a", [0.0])]
    monkeypatch.setattr(ml, "MOST_SAMPLES", 0)
    with pytest.raises(ValueError, match="at most"):
        ml.wide_components(one)
