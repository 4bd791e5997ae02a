"""Classifiers as parameters, scoring and explanations as expressions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import logistic
from ..functions.solvers import cross_validated, sigmoid, standardise
from . import blocks

#: values of a training matrix that is collected to fit one model
MOST_VALUES = 20_000_000


def training_matrix(filled: DataFrame, labels: DataFrame, value: str = "filled", most: int = MOST_VALUES) -> tuple[np.ndarray, np.ndarray, list, list]:
    """(x, y, samples, features) on the driver, for models of a few samples; larger matrices are refused."""
    n = filled.count()
    if n > most:
        raise ValueError(f"{n} values: a model is fitted on {most} at most")
    frame = filled.select("sample_id", "feature", F.col(value).alias("x")).toPandas().pivot(index="sample_id", columns="feature", values="x").sort_index().sort_index(axis=1)
    y = labels.select("sample_id", "y").toPandas().set_index("sample_id")["y"].reindex(frame.index)
    return frame.to_numpy(float), y.to_numpy(int), list(frame.index), list(frame.columns)


def train(filled: DataFrame, labels: DataFrame, scoring: str = "roc_auc") -> dict:
    """Scaler and L2 logistic regression as plain parameters."""
    x, y, samples, features = training_matrix(filled, labels)
    scaled, mean, deviation = standardise(x)
    b, c, _ = cross_validated(scaled, y, scoring=scoring)
    p = sigmoid(scaled @ b[:-1] + b[-1])
    return {
        "n_features": len(features),
        "n_training_samples": len(samples),
        "features": [str(f) for f in features],
        "coefficients": b[:-1].tolist(),
        "intercept": float(b[-1]),
        "feature_means": mean.tolist(),
        "feature_stds": deviation.tolist(),
        "regularization_C": c,
        "training_accuracy": float(((p > 0.5) == (y == 1)).mean()),
    }


def train_distributed(rows: DataFrame, features: str, label: str = "y", n_cs: int = 10, folds: int = 5, seed: int = 42) -> dict:
    """The parameters that `train` gives, from a table of any number of rows (a column of arrays and a 0/1 label).

    Means, deviations and the fits are sums over the rows, made where the rows are; C is chosen by held-out area under the ROC curve.
    The penalty is 1 / (C * sum of weights), as a class's weights are balanced to half of all rows."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Summarizer
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    vectors = rows.select(array_to_vector(features).alias("v"), F.col(features).alias("raw"), F.col(label).cast("double").alias("label"))
    seen = vectors.agg(F.count("*").alias("n"), F.sum("label").alias("ones"), Summarizer.metrics("mean", "variance").summary(F.col("v")).alias("s"))
    row = seen.first()
    n, ones = row["n"], row["ones"] or 0.0
    if not 0 < ones < n:
        raise ValueError("both classes need rows")
    mean = [float(v) for v in row["s"]["mean"]]
    deviation = [float((v * (n - 1) / n) ** 0.5) or 1.0 for v in row["s"]["variance"]]
    scaled = F.zip_with(F.zip_with("raw", F.lit(mean), lambda v, m: v - m), F.lit(deviation), lambda v, s: v / s)
    weight = F.when(F.col("label") == 1, n / (2 * ones)).otherwise(n / (2 * (n - ones)))
    training = vectors.select(array_to_vector(scaled).alias("features"), "label", weight.alias("weight")).cache()
    fit = LogisticRegression(weightCol="weight", standardization=False, maxIter=200, tol=1e-8)
    grid = ParamGridBuilder().addGrid(fit.regParam, [1 / (10 ** (-4 + 8 * i / max(1, n_cs - 1)) * n) for i in range(n_cs)]).build()
    found = CrossValidator(estimator=fit, estimatorParamMaps=grid, evaluator=BinaryClassificationEvaluator(), numFolds=folds, seed=seed, parallelism=4).fit(training)
    best = found.bestModel
    right = best.transform(training).agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]
    training.unpersist()
    return {
        "n_features": len(mean),
        "n_training_samples": n,
        "features": [str(i) for i in range(len(mean))],
        "coefficients": [float(v) for v in best.coefficients],
        "intercept": float(best.intercept),
        "feature_means": mean,
        "feature_stds": deviation,
        "regularization_C": 1 / (best.getRegParam() * n),
        "training_accuracy": float(right),
    }


def parameters(spark, model: dict) -> DataFrame:
    """A model as a table: feature, coefficient, mean, deviation, intercept."""
    rows = zip(model["features"], model["coefficients"], model["feature_means"], model["feature_stds"], strict=True)
    return spark.createDataFrame([(str(f), float(c), float(m), float(s), float(model["intercept"])) for f, c, m, s in rows], "feature string, coefficient double, mean double, deviation double, intercept double")


def score_arrays(rows: DataFrame, features: Column, model: dict) -> DataFrame:
    """Probability of class 1 from an array of raw values; missing values count as raw 0."""
    scaled = F.zip_with(F.transform(features, lambda v: F.coalesce(v, F.lit(0.0))), F.lit([float(m) for m in model["feature_means"]]), lambda v, m: v - m)
    scaled = F.zip_with(scaled, F.lit([float(s) for s in model["feature_stds"]]), lambda v, s: v / s)
    terms = F.zip_with(scaled, F.lit([float(c) for c in model["coefficients"]]), lambda v, c: v * c)
    return rows.withColumn("probability", logistic(F.aggregate(terms, F.lit(float(model["intercept"])), lambda a, t: a + t)))


def score_long(matrix: DataFrame, params: DataFrame, samples: DataFrame) -> DataFrame:
    """sample_id, probability, predicted, low_confidence: every sample against every parameter, absent values as raw 0."""
    terms = samples.select("sample_id").join(F.broadcast(params), how="cross").join(matrix.select("sample_id", "feature", "value"), ["sample_id", "feature"], "left")
    z = F.sum(F.col("coefficient") * (F.coalesce("value", F.lit(0.0)) - F.col("mean")) / F.col("deviation")) + F.first("intercept")
    p = terms.groupBy("sample_id").agg(z.alias("margin")).withColumn("probability", logistic(F.col("margin")))
    return p.withColumn("predicted", (F.col("probability") > 0.5).cast("int")).withColumn("low_confidence", F.col("probability").between(0.3, 0.7) & ~F.col("probability").isin(0.3, 0.7))


def linear_shap(scaled: DataFrame, params: DataFrame, value: str = "z") -> DataFrame:
    """phi = coefficient * (x - mean x) for each sample and feature."""
    centred = F.col(value) - F.avg(value).over(Window.partitionBy("feature"))
    return scaled.join(params.select("feature", "coefficient"), "feature").withColumn("phi", F.col("coefficient") * centred)


def shap_ranking(phi: DataFrame) -> DataFrame:
    return phi.groupBy("feature").agg(F.avg(F.abs("phi")).alias("importance"))


def misclassified(phi: DataFrame, predictions: DataFrame, wrong: int = 3, right: int = 2) -> DataFrame:
    """For each wrongly predicted sample the features that push most to the wrong and to the right side."""
    bad = predictions.filter("predicted <> y").select("sample_id", "y")
    toward = F.when(F.signum("phi") == F.when(F.col("y") == 1, F.lit(1.0)).otherwise(F.lit(-1.0)), "right").otherwise("wrong")
    pushes = phi.join(bad, "sample_id").filter("phi <> 0").withColumn("side", toward)
    rank = F.row_number().over(Window.partitionBy("sample_id", "side").orderBy(F.abs("phi").desc(), "feature"))
    return pushes.withColumn("rank", rank).filter(((F.col("side") == "wrong") & (F.col("rank") <= wrong)) | ((F.col("side") == "right") & (F.col("rank") <= right)))


def representative_samples(predictions: DataFrame) -> DataFrame:
    """The most confident right prediction of each class and the most confident wrong one."""
    right = F.col("predicted") == F.col("y")
    confidence = F.abs(F.col("probability") - 0.5)
    pick = lambda c, order: F.max_by(F.when(c, F.col("sample_id")), F.when(c, F.struct(order.alias("v"), (-F.col("sample_id")).alias("t"))))
    return predictions.agg(
        pick(right & (F.col("y") == 1), F.col("probability")).alias("right_1"), pick(right & (F.col("y") == 0), -F.col("probability")).alias("right_0"), pick(~right, confidence).alias("wrong")
    )


def principal_components(rows: DataFrame, features: str, k: int = 2) -> DataFrame:
    """Scores on the first k components of centred vectors (a column of arrays), and the variance each explains."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    vectors = rows.withColumn("__v", array_to_vector(features))
    mean = vectors.select(Summarizer.mean(F.col("__v")).alias("m")).first()["m"].toArray().tolist()
    centred = rows.withColumn("__c", array_to_vector(F.zip_with(features, F.lit(mean), lambda a, m: a - m)))
    model = PCA(k=k, inputCol="__c", outputCol="__p").fit(centred)
    shares = [float(v) for v in model.explainedVariance]
    return model.transform(centred).withColumn("scores", vector_to_array("__p")).drop("__c", "__p").withColumn("explained", F.lit(shares))


#: samples whose products with each other are decomposed on the driver
MOST_SAMPLES = 4_000


def wide_components(matrix: DataFrame, k: int = 2, value: str = "value") -> DataFrame:
    """sample_id, scores (on the first k components), explained (share of the variance): of a matrix of any number of features.

    Features are centred where they are.  Products of samples with each other are summed over features by blocks; their matrix, of at most
    MOST_SAMPLES samples, is all that reaches the driver, and its eigenvectors are the scores.  A missing cell counts as the feature's mean.
    A component's sign is such that its largest score is positive."""
    n = matrix.select("sample_id").distinct().count()
    if n > MOST_SAMPLES:
        raise ValueError(f"{n} samples: components of a wide matrix take {MOST_SAMPLES} at most")
    centred = matrix.withColumn("__v", F.col(value) - F.avg(value).over(Window.partitionBy("feature")))
    products = blocks.products(centred, "sample_id", "feature", "__v").toPandas()  # n^2 / 2 rows
    names = sorted(set(products["a"]))
    at = {s: i for i, s in enumerate(names)}
    gram = np.zeros((len(names), len(names)))
    i, j = products["a"].map(at).to_numpy(int), products["b"].map(at).to_numpy(int)
    gram[i, j] = gram[j, i] = products["product"].to_numpy()
    values, vectors = np.linalg.eigh(gram) if names else (np.zeros(0), np.zeros((0, 0)))
    values, vectors = np.maximum(values[::-1][:k], 0.0), vectors[:, ::-1][:, :k]
    scores = vectors * np.sqrt(values)
    scores *= np.where(np.abs(scores).max(0, initial=0.0) == scores.max(0, initial=-np.inf), 1.0, -1.0)
    shares = (values / max(np.trace(gram), 1e-300)).tolist()
    kind = matrix.schema["sample_id"].dataType.simpleString()
    rows = [(s, r, shares) for s, r in zip(names, scores.tolist(), strict=True)]
    return matrix.sparkSession.createDataFrame(rows, f"sample_id {kind}, scores array<double>, explained array<double>")
