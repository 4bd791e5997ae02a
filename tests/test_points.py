"""Selection and validation at many points against the same steps on one matrix."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pandas as pd
import pytest

from omixel.config import Config
from omixel.functions import solvers
from omixel.operators import points, resample, similarity

CONFIG = replace(Config(), bootstraps=6, inner_bootstraps=3, n_cs=3, l1_ratios=(0.5,), stability=0.5)


@pytest.fixture(scope="module")
def tables(spark):
    rng = np.random.default_rng(5)
    y = np.array([0, 1] * 7)
    frames = []
    for point in ("p", "q"):
        m = rng.normal(size=(14, 9))
        m[:, :3] += y[:, None] * (2.0 if point == "p" else 1.5)
        m[:, 8] = m[:, 0]  # redundant
        m[:, 7] = 0.25  # does not vary
        for j in range(9):
            frames += [(point, f"s{j}", i, None if (i, j) == (3, 4) else float(m[i, j])) for i in range(14)]
    scores = spark.createDataFrame(frames, "point string, set_id string, sample_id int, es double")
    samples = spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)], "sample_id int, y int")
    membership = spark.createDataFrame([(f"s{j}", 10 * j + k) for j in range(9) for k in range(4)], "set_id string, feature int")
    return scores.repartition(4), samples, membership, pd.DataFrame(frames, columns=["point", "set_id", "sample_id", "es"]), y


def _matrix(frame, point, sets):
    wide = frame[frame.point == point].pivot(index="sample_id", columns="set_id", values="es").astype(float)
    return wide.fillna(wide.mean())[sorted(sets)].to_numpy()


def test_evaluated(spark, tables):
    scores, samples, membership, frame, y = tables
    sets = {}
    for r in points.nonredundant(scores, membership, ["point"], CONFIG).collect():
        sets.setdefault(r.point, []).append(r.set_id)
    got = {r.point: r for r in points.evaluated(scores, samples, membership, ["point"], True, CONFIG).collect()}
    assert set(got) == {"p", "q"}
    for point, r in got.items():
        assert len({"s0", "s8"} & set(sets[point])) == 1 and "s7" not in sets[point] and r.n_sets == len(sets[point])
        x = _matrix(frame, point, sets[point])
        chosen = np.zeros(x.shape[1])
        ok = 0
        for at in resample.bootstrap_indices(14, CONFIG.bootstraps, CONFIG.seed):
            status, w = resample._select(x[at], y[at], CONFIG)
            ok += status == "ok"
            chosen += (np.abs(w) > 1e-8) * (status == "ok")
        stable = chosen / ok >= CONFIG.stability
        assert r.n_stable == stable.sum() >= 2
        p = np.array([resample._predict_one(x[:, stable], y, i, "logistic", CONFIG) for i in range(14)])
        assert r.loocv_accuracy == pytest.approx(((p > 0.5) == y).mean()) and r.loocv_auc == pytest.approx(solvers.auc(y, p)) and r.loocv_kappa == pytest.approx(solvers.kappa(y, (p > 0.5).astype(int)))
        nested = resample.nested_leave_one_out(spark, x, y, CONFIG).toPandas().sort_values("position")
        assert r.nested_accuracy == pytest.approx((nested.predicted == y).mean()) and r.nested_auc == pytest.approx(solvers.auc(y, nested.probability.to_numpy()))


def test_everything_is_fitted_once(spark, tables, tmp_path, monkeypatch):
    """What several tables are made of (clusters, selections of the folds, predictions) is made once, and so sent for once."""
    scores, samples, membership, _, _ = tables

    def counted(name):
        plain, folder = getattr(points, name), str(tmp_path)

        def run(*args):
            import tempfile

            tempfile.mkstemp(prefix=f"{name}-", dir=folder)
            return plain(*args)

        monkeypatch.setattr(points, name, run)

    counted("_select")
    counted("_predict_one")
    linkage, folder = similarity.average_linkage, str(tmp_path)

    def linked(distance):
        import tempfile

        tempfile.mkstemp(prefix="linkage-", dir=folder)
        return linkage(distance)

    monkeypatch.setattr(similarity, "average_linkage", linked)
    got = points.evaluated(scores, samples, membership, ["point"], True, CONFIG).collect()
    assert len(got) == 2 and all(r.n_stable >= 2 for r in got)
    made = {name: len(list(tmp_path.glob(f"{name}-*"))) for name in ("_select", "_predict_one", "linkage")}
    assert made == {"_select": 2 * (CONFIG.bootstraps + 14 * CONFIG.inner_bootstraps), "_predict_one": 2 * 2 * 14, "linkage": 2}


def test_too_few(spark, tables):
    """A point where nothing is selected has no validation; a point without scores has no row."""
    scores, samples, membership, _, _ = tables
    got = points.evaluated(scores.filter("point = 'p'"), samples, membership, ["point"], True, replace(CONFIG, stability=1.1)).collect()
    assert [(r.point, r.n_stable, r.loocv_accuracy, r.nested_accuracy) for r in got] == [("p", 0, None, None)]


def test_matrix_is_refused(spark, tables, monkeypatch):
    scores, samples, membership, _, _ = tables
    monkeypatch.setattr(points, "MOST_VALUES", 20)
    with pytest.raises(Exception, match="more than 20 values"):
        points.designs(scores, samples, scores.select("point", "set_id").distinct(), ["point"]).collect()
