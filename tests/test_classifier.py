"""The classifier's command line, from a matrix to predictions."""

from __future__ import annotations

import math

import numpy as np

from omixel.operators import ml
from omixel.plans import classifier
from omixel.sources import files


def test_train_predict_info(spark, tmp_path, capsys):
    rng = np.random.default_rng(0)
    y = [i % 2 for i in range(20)]
    rows = [(s, f, float(rng.normal() + 3 * y[s] * (f == "b"))) for s in range(20) for f in ("a", "b", "c")]
    spark.createDataFrame(rows, "sample_id int, feature string, value double").write.parquet(str(tmp_path / "m"))
    spark.createDataFrame(list(enumerate(y)), "sample_id int, y int").write.parquet(str(tmp_path / "l"))
    model = str(tmp_path / "model.json")
    classifier.main(["--train", "--matrix", str(tmp_path / "m"), "--labels", str(tmp_path / "l"), "--model", model])
    (tmp_path / "new.csv").write_text("sample_id,b,c,truth\nx,4.0,NA,AD\ny,-2.0,,control\n")
    wide = spark.read.csv(str(tmp_path / "new.csv"), header=True)
    parameters = files.read_model(model)
    got = classifier.predict(wide, parameters)
    assert {r.sample_id: r.prediction for r in got.collect()} == {"x": "AD", "y": "Control"}
    p = parameters
    z = p["intercept"] + sum(c * ((4.0 if f == "b" else 0.0) - m) / s for f, c, m, s in zip(p["features"], p["coefficients"], p["feature_means"], p["feature_stds"], strict=True))
    assert abs(got.filter("sample_id = 'x'").first().probability - 1 / (1 + math.exp(-z))) < 1e-4
    m = classifier.evaluate(got, "truth").first()
    assert (m.accuracy, m.auc, m.kappa) == (1.0, 1.0, 1.0)
    assert classifier.info(spark, parameters).first().feature == "b"
    classifier.main(["--predict", str(tmp_path / "new.csv"), "--model", model, "--label-col", "truth", "--out", str(tmp_path / "out")])
    assert spark.read.csv(str(tmp_path / "out"), header=True).count() == 2
    assert ml.parameters(spark, parameters).count() == 3
