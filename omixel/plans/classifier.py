"""Train, apply and describe a classifier: `python -m omixel.plans.classifier --train --matrix M --labels L --model m.json`.

The model is a JSON file of plain parameters.  Input for prediction is a CSV with a sample_id column and one column per feature; features that the
file lacks, and missing cells, count as raw 0."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import label
from ..operators import ml, stats
from ..sources import files


def predict(wide: DataFrame, model: dict, positive: str = "AD", negative: str = "Control") -> DataFrame:
    """sample_id, prediction, probability (4 digits), low_confidence, and the columns of `wide` that are no features."""
    have = set(wide.columns)
    features = F.array(*[F.expr(f"try_cast(`{f}` as double)") if f in have else F.lit(None).cast("double") for f in model["features"]])
    rest = [F.col(f"`{c}`") for c in wide.columns if c not in model["features"]]
    scored = ml.score_arrays(wide.withColumn("__features", features), F.col("__features"), model)
    p = F.col("probability")
    return scored.select(*rest, F.when(p > 0.5, positive).otherwise(negative).alias("prediction"), F.bround(p, 4).alias("probability"), ((p > 0.3) & (p < 0.7)).alias("low_confidence"), (p > 0.5).cast("int").alias("predicted"))


def evaluate(predictions: DataFrame, label_column: str) -> DataFrame:
    """Accuracy, kappa, AUC, confusion counts and class report against a column of labels (AD, 1, patient, true are positive)."""
    return stats.metrics(predictions.withColumn("y", label(F.col(label_column))), score="probability")


def info(spark: SparkSession, model: dict) -> DataFrame:
    """Features by the size of their coefficients."""
    return ml.parameters(spark, model).withColumn("direction", F.when(F.col("coefficient") > 0, "up").when(F.col("coefficient") < 0, "down").otherwise("-")).orderBy(F.abs("coefficient").desc(), "feature")


def main(args: list[str] | None = None) -> None:
    from ..session import session

    parser = argparse.ArgumentParser(description=__doc__)
    action = parser.add_mutually_exclusive_group(required=True)
    action.add_argument("--train", action="store_true")
    action.add_argument("--predict", metavar="CSV")
    action.add_argument("--info", action="store_true")
    parser.add_argument("--matrix", help="Parquet of sample_id, feature, value")
    parser.add_argument("--labels", help="Parquet of sample_id, y")
    parser.add_argument("--model", required=True)
    parser.add_argument("--label-col")
    parser.add_argument("--out")
    given = parser.parse_args(args)
    spark = session()
    if given.train:
        rows = spark.read.parquet(given.matrix).select("sample_id", "feature", F.coalesce("value", F.lit(0.0)).alias("filled"))
        files.write_model(ml.train(rows, spark.read.parquet(given.labels)), given.model)
        return
    model = files.read_model(given.model)
    if given.info:
        info(spark, model).show(1000, truncate=False)
        return
    found = predict(spark.read.csv(given.predict, header=True), model)
    if given.label_col:
        evaluate(found, given.label_col).show(truncate=False)
    if given.out:
        files.write_csv(found.drop("predicted"), given.out)
    else:
        found.drop("predicted").show(1000, truncate=False)


if __name__ == "__main__":
    main()
