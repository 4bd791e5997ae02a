"""The phases one after another, and the stream of measurements."""

from __future__ import annotations

import datetime as dt
from dataclasses import replace

import numpy as np

from omixel.config import Config
from omixel.plans import runner
from omixel.streaming import measurements


def _analysis(spark):
    rng = np.random.default_rng(4)
    y = [i % 2 for i in range(16)]
    rows = [(s, f, float(rng.normal() + (2.5 * y[s] if f < 6 else 0))) for s in range(16) for f in range(30)]
    sets = {"up": range(6), "also": range(1, 7), "other": range(10, 16), "more": range(20, 26)}
    return runner.Analysis(
        spark,
        spark.createDataFrame(rows, "sample_id int, feature int, value double"),
        spark.createDataFrame(list(enumerate(y)), "sample_id int, y int"),
        spark.createDataFrame([(k, f) for k, fs in sets.items() for f in fs], "set_id string, feature int"),
        spark.createDataFrame([(f, 0.5, 0.5) for f in range(30)], "feature int, d double, s double"),
        replace(Config(), bootstraps=8, inner_bootstraps=2, permutations=9, n_cs=4, l1_ratios=(0.7,), stability=0.5, trees=3, impute_rounds=1),
    )


def test_phases(spark):
    done = runner.run(_analysis(spark), ["score", "reduce", "test", "validate", "nothing of the kind"])
    assert set(done.times) == {"score", "reduce", "test", "validate"}
    assert done.results["differential"].orderBy("p").first().set_id in ("up", "also")
    assert done.results["nonredundant"].count() <= 4
    assert {r.set_id for r in done.results["stable"].collect()} & {"up", "also"}


def test_validation(spark):
    done = runner.run(_analysis(spark), ["score", "reduce", "test", "validate"])
    one = {k: done.results[k].first() for k in ("loocv", "loocv_forest", "nested_loocv", "permutation")}
    assert min(one[k]["accuracy"] for k in ("loocv", "loocv_forest", "nested_loocv")) > 0.6
    assert 0 < one["permutation"]["p"] <= 0.5
    assert {r.phase for r in done.profile().collect()} == {"score", "reduce", "test", "validate"}


def test_imputed_variant(spark):
    plain = _analysis(spark)
    # feature 28 lacks 2 of 16 samples, 27 lacks 10, 29 lacks 14
    gaps = "not (feature = 28 and sample_id < 2) and not (feature = 27 and sample_id < 10) and not (feature = 29 and sample_id < 14)"
    gapped = replace(plain, matrix=plain.matrix.filter(gaps))
    done = runner.imputed_variant(gapped, ("score", "test"))
    assert {r.tier: (r.missing, r.imputed, r.left_missing) for r in done.results["imputation_report"].collect()} == {"Complete": (0, 0, 0), "Tier1": (2, 2, 0), "Tier2": (10, 10, 0), "Tier3": (14, 0, 14)}
    assert done.matrix.count() == 16 * 30 - 14 and gapped.matrix.count() == 16 * 30 - 26
    assert "score" in done.times and not gapped.results


def test_stream(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    rows = [(s, f, 1.0 if s < n else None, at + dt.timedelta(minutes=s)) for f, n in ((0, 4), (1, 2), (2, 1)) for s in range(4)] + [(0, 0, 1.0, at)]
    schema = "sample_id int, feature int, value double, at timestamp"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    stream = measurements.measurements(spark, str(tmp_path / "in"), schema)
    query = measurements.keep_tiers(measurements.detections(stream, "at"), 4, str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination(120)
    got = {r.feature: r.tier for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {0: "Complete", 1: "Tier1", 2: "Tier2"}
    counts = measurements.windowed_counts(measurements.measurements(spark, str(tmp_path / "in"), schema), "at", "2 minutes", "feature")
    q = counts.writeStream.outputMode("complete").format("memory").queryName("counted").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("counted").agg({"n": "sum"}).first()[0] == len(rows)
