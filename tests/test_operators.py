"""Edge cases of the operators on tiny frames."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from omixel.config import Config
from omixel.functions import numeric, text
from omixel.operators import enrich, impute, matrix, ml, resample, similarity, stats
from omixel.sources import files


def _plain_es(values, weights, hits):
    order = sorted(range(len(values)), key=lambda i: (-values[i], i))
    n, nh = len(values), sum(hits)
    total = sum(abs(values[i]) * weights[i] for i in range(n) if hits[i])
    if nh in (0, n) or not total:
        return 0.0
    run, out = 0.0, 0.0
    miss = 0
    for i in order:
        run += abs(values[i]) * weights[i] if hits[i] else 0
        miss += not hits[i]
        out += run / total - miss / (n - nh)
    return out / n


def test_ssgsea_edges(spark):
    rng = np.random.default_rng(5)
    rows, w = [], {f: 0.1 + f % 4 for f in range(14)}
    values = {s: rng.normal(size=14) for s in range(3)}
    for f in range(14):
        rows.append((0, f, float(values[0][f])))
        if f < 10:
            rows.append((1, f, float(values[1][f])))
        if f < 9:
            rows.append((2, f, float(values[2][f])))
    members = {"a": [0, 3, 5], "all": list(range(14)), "two": [1, 2], "late": [11, 12, 13]}
    es = enrich.ssgsea(
        spark.createDataFrame(rows, "sample_id int, feature int, value double"),
        spark.createDataFrame([(k, f) for k, fs in members.items() for f in fs], "set_id string, feature int"),
        spark.createDataFrame([(f, x) for f, x in w.items() if f != 5], "feature int, w double"),
        spark.createDataFrame([(0,), (1,), (2,), (3,)], "sample_id int"),
    )
    got = {(r.set_id, r.sample_id): r.es for r in es.collect()}
    assert {k for k, _ in got} == {"a", "all", "late"}  # a set of two present features is no set
    w[5] = 0.3
    for s, n in ((0, 14), (1, 10)):
        for k in ("a", "late", "all"):
            want = _plain_es(list(values[s][:n]), [w[f] for f in range(n)], [f in members[k] for f in range(n)])
            assert got[k, s] == pytest.approx(want, abs=1e-12)
    assert got["a", 2] is None and got["a", 3] is None  # nine values, and none
    assert got["late", 1] == 0.0 and got["all", 0] == 0.0


def test_tiers_and_rates(spark):
    m = spark.createDataFrame([(s, f, 1.0) for f, n in ((0, 10), (1, 5), (2, 2), (3, 1)) for s in range(n)], "sample_id int, feature int, value double")
    rates = matrix.tiers(matrix.missing_rate(m, spark.createDataFrame([(i,) for i in range(5)], "feature int"), 10))
    assert {r.feature: r.tier for r in rates.collect()} == {0: "Complete", 1: "Tier1", 2: "Tier2", 3: "Tier3", 4: "Tier3"}




def test_numeric(spark):
    rows = spark.createDataFrame([(0.0,), (-1.0,), (1.0,), (0.5,), (8.0,), (None,)], "v double")
    assert [r[0] for r in rows.select(numeric.log2_positive(F.col("v"))).collect()] == [None, None, 0.0, -1.0, 3.0, None]
    assert [r[0] for r in rows.select(numeric.log2_positive(F.col("v"), strict=True)).collect()] == [None, None, None, None, 3.0, None]
    w = spark.createDataFrame([(None, None), (0.0, 0.0), (0.5, None), (None, 1.0)], "d double, s double")
    assert [r[0] for r in w.select(numeric.combined_weight(F.col("d"), F.col("s"))).collect()] == pytest.approx([0.3, 0.3, 0.3, 0.4])


def test_names(spark):
    names = ["ACTG1 protein", "Clusterin (CLU)", "DNA polymerase (EC) (POLB)", "immunoglobulin", None, "an IG thing", "IGHV3-23 heavy", "Serpin, plasma,, ", "Complement C3"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    n = F.col("name")
    assert [r[0] for r in df.select(text.gene_symbol(n)).collect()] == ["ACTG1", "CLU", "POLB", None, None, None, "IGHV3", None, None]
    assert [r[0] for r in df.select(text.is_immunoglobulin(n)).collect()] == [False, False, False, True, False, True, True, False, False]
    assert [r[0] for r in df.select(text.v_gene(n)).collect()][6] == "IGHV3-23"
    assert df.select(text.comma_list(n)).collect()[7][0] == ["Serpin", "plasma"]
    assert [r[0] for r in df.select(text.category(n)).collect()] == ["Other", "Apolipoprotein", "Other", "Other", "Other", "Other", "Other", "Protease Inhibitor", "Complement"]


def test_fallback(spark):
    few = spark.createDataFrame([("APOE", 0.5)], "feature string, score double")
    curated = spark.createDataFrame([("APOE", 0.95), ("CLU", 0.85), ("BIN1", 0.8)], "feature string, score double")
    features = spark.createDataFrame([("APOE",), ("CLU",)], "feature string")
    assert {r.feature: r.score for r in enrich.with_fallback(few, curated, features).collect()} == {"APOE": 0.5, "CLU": 0.85}
    assert enrich.with_fallback(few, curated, features, least=1).count() == 1


def test_keep_best_and_filter(spark):
    rows = spark.createDataFrame([("g", "a", 3), ("g", "b", 1), (None, "c", 0), (None, "d", 0), ("g", "e", 1)], "gene string, name string, missing int")
    best = matrix.keep_best(rows, F.coalesce("gene", "name"), F.col("missing"), F.col("name"))
    assert {r["name"] for r in best.collect()} == {"b", "c", "d"}
    iqrs = spark.createDataFrame([(i, 0.0 if i < 5 else float(i)) for i in range(20)], "set_id int, iqr double")
    assert enrich.variance_filter(iqrs).count() == 15  # ties at the cut all go


def test_fill_policies(spark):
    m = spark.createDataFrame([(0, "x", 1.0), (0, "y", 3.0), (1, "x", 5.0)], "sample_id int, feature string, value double")
    s = spark.createDataFrame([(0,), (1,)], "sample_id int")
    got = lambda policy: {(r.sample_id, r.feature): r.filled for r in matrix.fill(m, s, policy).collect()}[1, "y"]
    assert (got("feature_mean"), got("sample_mean"), got("zero")) == (3.0, 5.0, 0.0)


def test_tail_imputation(spark):
    m = spark.createDataFrame([(s, "f", 10.0 + s) for s in range(6)] + [(s, "c", 2.0) for s in range(3)] + [(0, "few", 1.0)], "sample_id int, feature string, value double")
    params = impute.tail_parameters(m)
    by = {r.feature: r for r in params.collect()}
    assert set(by) == {"f", "c"} and by["c"].sigma == pytest.approx(0.15) and by["c"].upper == pytest.approx(2.15)
    gaps = spark.createDataFrame([(s, f) for s in range(6, 40) for f in ("f", "few")], "sample_id int, feature string")
    draws = impute.tail_draws(gaps, params)
    values = [r.imputed for r in draws.orderBy("sample_id").collect()]
    assert len(values) == 34 and all(by["f"].lower <= v <= by["f"].upper for v in values) and len(set(values)) > 30
    assert values == [r.imputed for r in draws.orderBy("sample_id").collect()]


def test_clusters(spark):
    sim = spark.createDataFrame([("a", "b", 0.9), ("b", "c", 0.78), ("a", "c", 0.85), ("c", "d", 0.1)], "a string, b string, s double")
    got = similarity.clusters(spark.createDataFrame([(x,) for x in "abcd"], "set_id string"), sim, (0.7, 0.8, 0.9)).collect()
    by = {(r.threshold, r.set_id): r.cluster for r in got}
    assert by[0.8, "c"] == "a" and by[0.9, "c"] == "c" and by[0.9, "b"] == "a" and by[0.7, "d"] == "d"


def test_scoring_and_shap(spark):
    model = {"features": ["p", "q"], "coefficients": [0.5, -1.0], "feature_means": [1.0, 2.0], "feature_stds": [2.0, 4.0], "intercept": 0.1}
    arrays = ml.score_arrays(spark.createDataFrame([([3.0, None],)], "x array<double>"), F.col("x"), model).first().probability
    assert arrays == pytest.approx(1 / (1 + np.exp(-(0.1 + 0.5 * 1.0 - 1.0 * (0 - 2.0) / 4.0))))
    params = ml.parameters(spark, model)
    long = ml.score_long(spark.createDataFrame([(7, "p", 3.0)], "sample_id int, feature string, value double"), params, spark.createDataFrame([(7,)], "sample_id int"))
    assert long.first().probability == pytest.approx(arrays)
    phi = ml.linear_shap(spark.createDataFrame([(0, "p", 1.0), (1, "p", 3.0)], "sample_id int, feature string, z double"), params)
    assert sorted(r.phi for r in phi.collect()) == pytest.approx([-0.5, 0.5])


def test_resampling(spark):
    rng = np.random.default_rng(8)
    y = np.array([0, 1] * 12)
    x = rng.standard_normal((24, 4))
    x[:, 1] += 3 * y
    config = Config(bootstraps=12, inner_bootstraps=3, permutations=20, n_cs=4, l1_ratios=(0.7,))
    frequency = {r.position: r for r in resample.selection_frequency(resample.bootstrap_coefficients(spark, x, y, config)).collect()}
    assert frequency[1].selection_prob == 1.0 and frequency[1].direction == "up"
    assert stats.metrics(resample.leave_one_out(spark, x, y, config=config), score="probability").first().auc > 0.8
    assert resample.nested_leave_one_out(spark, x, y, config).count() == 24
    null = resample.permutation_null(spark, x, y, config)
    assert stats.empirical_p(null, "accuracy", 1.1).first().p == pytest.approx(1 / 21)


def test_one_class_bootstraps_are_told(spark):
    y = np.array([1, 1, 1, 1, 1, 0])
    got = resample.bootstrap_coefficients(spark, np.random.default_rng(0).standard_normal((6, 2)), y, Config(bootstraps=10, n_cs=3)).select("status").distinct().collect()
    assert {r.status for r in got} & {"one class", "too few of a class"}


def test_files(spark, tmp_path):
    wide = spark.createDataFrame([("p", 1.0, None), ("q", 2.0, 3.0)], "name string, P1 double, C1 double")
    wide.coalesce(1).write.csv(str(tmp_path / "wide"), header=True, nullValue="NA")
    long = files.read_matrix(spark, str(tmp_path / "wide"), "name", ["P1", "C1"])
    assert sorted(map(tuple, long.collect())) == [("p", "P1", 1.0), ("q", "C1", 3.0), ("q", "P1", 2.0)]
    (tmp_path / "sets.json").write_text('{"GO:1": {"name": "x", "source": "GO:BP", "genes": ["A", "B"], "size_total": 9, "size_matched": 2, "p_value": 0.1}}')
    sets, members = files.read_sets(spark, str(tmp_path / "sets.json"))
    assert sets.first().name == "x" and sorted(r.feature for r in members.collect()) == ["A", "B"]
    files.write_sets(sets, members, str(tmp_path / "again"))
    files.write_csv(sets.select("set_id"), str(tmp_path / "csv"))
    files.write_json_lines(sets, str(tmp_path / "json"))
    assert files.read_table(spark, str(tmp_path / "none.csv"), "a int").count() == 0
    files.write_model({"a": [1.5]}, str(tmp_path / "m.json"))
    assert files.read_model(str(tmp_path / "m.json")) == {"a": [1.5]}
    assert r"\begin{tabular}" in files.latex_table(sets, ["set_id", "source"], "sets", "tab:sets")


def test_metrics_match_plain_version(spark):
    from omixel.functions import solvers

    rng = np.random.default_rng(2)
    y, s = rng.integers(0, 2, 50), rng.integers(0, 9, 50) / 8
    df = spark.createDataFrame([(int(a), int(b > 0.5), float(b)) for a, b in zip(y, s, strict=True)], "y int, predicted int, score double")
    m = stats.metrics(df).first()
    assert m.auc == pytest.approx(solvers.auc(y, s)) and m.kappa == pytest.approx(solvers.kappa(y, (s > 0.5).astype(int))) and m.accuracy == pytest.approx((y == (s > 0.5)).mean())


def test_power_curve_has_all_sets_and_sizes(spark, monkeypatch):
    from omixel.plans import queries

    x, y = np.random.default_rng(1).standard_normal((24, 30)), np.array([0, 1] * 12)
    monkeypatch.setattr(queries, "_set_scores", lambda t: (x, y, [], []))
    seen, run = [], resample.power_curve
    monkeypatch.setattr(resample, "power_curve", lambda spark, x, y, sizes, simulations: seen.append(x.shape) or run(spark, x, y, sizes, 1))
    got = queries.queries()["power_curve"](spark, "").collect()
    assert seen == [x.shape] and sorted(r.n_total for r in got) == [20, 30, 50, 75, 100, 150, 200, 300, 500]


def test_distributed_training_is_the_solver_s(spark):
    import numpy as np

    from omixel.functions.solvers import logistic_l2, standardise
    from omixel.operators import ml

    rng = np.random.default_rng(4)
    x = rng.standard_normal((240, 4)) * [1, 3, 0.5, 1]
    y = (x @ [1.0, -0.4, 0.5, 0] + rng.logistic(size=240) > 0.6).astype(int)
    model = ml.train_distributed(spark.createDataFrame([(v.tolist(), int(k)) for v, k in zip(x, y, strict=True)], "v array<double>, y int"), "v", n_cs=5, folds=3)
    scaled, mean, deviation = standardise(x)
    want = logistic_l2(scaled, y, model["regularization_C"])
    assert np.abs(np.array([*model["coefficients"], model["intercept"]]) - want).max() < 1e-3
    assert np.abs(np.array(model["feature_means"]) - mean).max() < 1e-9 and np.abs(np.array(model["feature_stds"]) - deviation).max() < 1e-9


def test_fallback_by_group(spark):
    scores = spark.createDataFrame([(i, float(i) if i != 3 else None) for i in range(14)], "feature int, score double")
    curated = spark.createDataFrame([(3, 0.5), (20, 0.6), (21, 0.7), (99, 0.9)], "feature int, score double")
    features = spark.createDataFrame([(i, "a" if i < 14 else "b") for i in (*range(14), 20, 21)], "feature int, grp string")
    got = {r.feature: r.score for r in enrich.with_fallback(scores, curated, features, by=["grp"]).collect()}
    assert got == {**{i: float(i) for i in range(14) if i != 3}, 20: 0.6, 21: 0.7}


def test_best_hits(spark):
    names = spark.createDataFrame([("Kinase A (KA)",), ("ring",), (None,), ("",), ("(X)",), ("none",)], "name string")
    catalogue = spark.createDataFrame([(i, "kinase a ") for i in range(9)] + [(20, "Ring"), (21, None)], "id int, title string")
    got = enrich.best_hits(names, catalogue, "name", "title", F.col("id"))
    assert sorted((r.query_clean, r.id, r.hit) for r in got.collect()) == [("Kinase A", i, i + 1) for i in range(5)] + [("ring", 20, 1)]
    symbols = spark.createDataFrame([("kinase a ", "KA")], "title string, gene string")
    assert enrich.with_symbols(catalogue, symbols, "title").filter("gene is null").count() == 2


def test_complete_features(spark):
    samples = spark.createDataFrame([(s,) for s in range(4)], "sample_id int")
    rows = [(s, f, 1.0 if f < 5 or s else None) for s in range(4) for f in range(7)]
    m = spark.createDataFrame(rows, "sample_id int, feature int, value double")
    assert {r.feature for r in matrix.complete_features(m, samples).collect()} == set(range(5))
    assert matrix.complete_features(m.filter("feature > 0"), samples).count() == 0


def test_usable_symbols(spark):
    rows = spark.createDataFrame([("A",), ("AB",), ("AB",), (None,), ("",)], "gene string")
    assert [r.gene for r in text.usable_symbols(rows, "gene").collect()] == ["AB"]
