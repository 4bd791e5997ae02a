"""Readers and writers: wide matrices, set catalogues, model parameters, reports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from ..storage import stored

SET = "struct<name:string,source:string,genes:array<string>,size_total:int,size_matched:int,p_value:double>"


def wide_schema(key: str, samples: list[str]) -> StructType:
    return StructType([StructField(key, StringType()), *[StructField(s, DoubleType()) for s in samples]])


def read_wide(spark: SparkSession, path: str, key: str, samples: list[str]) -> DataFrame:
    """A features x samples CSV with `NA` for missing values, as it stands."""
    return spark.read.schema(wide_schema(key, samples)).csv(path, header=True, nullValue="NA")


def unpivot(wide: DataFrame, keys: list[str], samples: list[str], variable: str = "sample_id", value: str = "value") -> DataFrame:
    """Wide to long; missing cells are absent rows."""
    return wide.unpivot(keys, samples, variable, value).filter(F.col(value).isNotNull())


def read_matrix(spark: SparkSession, path: str, key: str, samples: list[str]) -> DataFrame:
    return unpivot(read_wide(spark, path, key, samples), [key], samples)


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV or Parquet table; an empty table of the schema where the file does not exist."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path) if path.endswith(".parquet") else spark.read.schema(schema).csv(path, header=True, nullValue="")


def read_sets(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(sets, membership) of a JSON object from set id to name, source, genes and sizes."""
    text = spark.read.text(path, wholetext=True)
    entries = text.select(F.explode(F.from_json("value", f"map<string,{SET}>")).alias("set_id", "s")).select("set_id", "s.*")
    return entries.drop("genes"), entries.select("set_id", F.explode("genes").alias("feature"))


def _before(rows: DataFrame, column: str, to: str) -> DataFrame:
    """The sum of a column over all earlier records of the file: totals of its parts first, then within each part."""
    totals = rows.groupBy("file", "part").agg(F.sum(column).alias("__total"))
    earlier = Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("file", "part", F.coalesce(F.sum("__total").over(earlier), F.lit(0)).alias("__offset"))
    here = F.coalesce(F.sum(column).over(Window.partitionBy("file", "part").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(offsets, ["file", "part"]).withColumn(to, here + F.col("__offset")).drop("__offset")


def read_large_sets(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """What read_sets gives, of an object of any size, which many tasks read and parse.

    The file is read as records that end in a closing brace, so that Spark splits it anywhere.  Whether a record begins inside a string follows
    from the number of quotes before it, and how deep its end lies from the braces outside strings; both are running sums over the parts that
    tasks have read.  Where the depth comes back to one an entry ends; its records are put together and parsed.  An entry is what one task holds."""
    raw = spark.read.option("lineSep", "}").text(path)
    records = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("part"), F.monotonically_increasing_id().alias("at"), "value")
    plain = F.regexp_replace("value", r"(?s)\\.", "")  # without escaped characters
    count = lambda text, mark: F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))
    quoted = stored(records.withColumn("quotes", count(plain, '"').cast("long")), "json-records")
    begun = _before(quoted, "quotes", "earlier")
    inside = F.col("earlier") % 2 == 1
    outside = F.regexp_replace(F.concat(F.when(inside, F.lit('"')).otherwise(""), plain), r'"[^"]*(?:"|$)', "")
    closes = ((F.col("earlier") + F.col("quotes")) % 2 == 0).cast("long")  # else the brace that ended the record is part of a string
    deep = stored(begun.select("file", "part", "at", "value", closes.alias("closes"), (count(outside, "{") - closes).alias("step")), "json-depths")
    ended = _before(deep, "step", "depth").withColumn("ends", ((F.col("closes") == 1) & (F.col("depth") + F.col("step") == 1)).cast("long"))
    entries = _before(stored(ended.drop("depth", "step", "closes"), "json-entries"), "ends", "entry").groupBy("file", "entry").agg(
        F.max("ends").alias("ends"), F.array_sort(F.collect_list(F.struct("part", "at", "value"))).alias("records")
    )
    text = F.concat(F.array_join(F.transform("records", lambda r: r["value"]), "}"), F.lit("}"))
    body = F.concat(F.lit("{"), F.regexp_replace(text, r"^[\s,{}]+", ""), F.lit("}"))
    parsed = entries.filter("ends = 1").select(F.explode(F.from_json(body, f"map<string,{SET}>")).alias("set_id", "s")).select("set_id", "s.*")
    return parsed.drop("genes"), parsed.select("set_id", F.explode("genes").alias("feature"))


def read_report(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, multiLine=True)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    df.write.mode("overwrite").parquet(path, partitionBy=partition_by)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def write_sets(sets: DataFrame, membership: DataFrame, path: str) -> None:
    """One JSON object a line: {set id: {...}}; read_sets takes several lines as well as one object."""
    genes = membership.groupBy("set_id").agg(F.sort_array(F.collect_list("feature")).alias("genes"))
    rows = sets.join(genes, "set_id", "left")
    fields = F.struct(*[F.coalesce("genes", F.array().cast("array<string>")).alias("genes") if c == "genes" else F.col(c) for c in rows.columns if c != "set_id"])
    rows.select(F.to_json(F.create_map(F.col("set_id"), fields)).alias("value")).write.mode("overwrite").text(path)


def latex_table(rows: DataFrame, columns: list[str], caption: str, label: str, most: int = 1000) -> str:
    """A LaTeX table of a small result; more than `most` rows are refused rather than cut."""
    got = rows.select(*columns).limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"more than {most} rows do not make a table")
    show = lambda v: "--" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v).replace("_", r"\_")
    lines = [r"\begin{table}[htbp]", r"\centering", rf"\caption{{{caption}}}", rf"\label{{{label}}}", rf"\begin{{tabular}}{{{'l' * len(columns)}}}", r"\hline"]
    lines += [" & ".join(c.replace("_", r"\_") for c in columns) + r" \\", r"\hline"]
    lines += [" & ".join(show(v) for v in r) + r" \\" for r in got]
    return "\n".join([*lines, r"\hline", r"\end{tabular}", r"\end{table}"])


def write_model(parameters: dict, path: str) -> None:
    with open(path, "w") as f:
        json.dump(parameters, f, indent=1)


def read_model(path: str) -> dict:
    with open(path) as f:
        return json.load(f)
