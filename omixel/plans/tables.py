"""The library's tables taken from a star schema: nations are samples, parts are features, part attributes are sets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import stored


class Tables:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self._stored = spark, folder, {}

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def once(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """What several steps of a query read, made and stored once."""
        if name not in self._stored:
            self._stored[name] = stored(make(), name)
        return self._stored[name]

    def samples(self) -> DataFrame:
        """sample_id, y: the nations of suppliers, in two groups."""
        here = self.read("supplier").select(F.col("s_nationkey").alias("n_nationkey")).distinct()
        return self.read("nation").join(here, "n_nationkey", "left_semi").select(F.col("n_nationkey").alias("sample_id"), F.col("n_regionkey").isin(1, 2, 3).cast("int").alias("y"))

    def raw(self) -> DataFrame:
        """sample_id, feature, value: what a nation's suppliers sold of a part; some cells are missing."""
        items = self.read("lineitem").select("l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice")
        parts = self.read("part").select(F.col("p_partkey").alias("l_partkey"), "p_size")
        suppliers = self.read("supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("sample_id"))
        kept = items.join(parts.hint("merge"), "l_partkey").filter("l_linenumber <= 1 + p_size % 7").join(suppliers.hint("merge"), "l_suppkey")
        return kept.groupBy("sample_id", F.col("l_partkey").alias("feature")).agg(F.round(F.sum("l_extendedprice"), 2).alias("value"))

    def matrix(self) -> DataFrame:
        return self.raw().filter("value > 0").select("sample_id", "feature", F.round(F.log2("value"), 9).alias("value"))

    def features(self) -> DataFrame:
        return self.read("part").select(F.col("p_partkey").alias("feature"))

    def membership(self) -> DataFrame:
        """set_id, feature: parts of a brand, a type, a size."""
        kinds = F.array(F.concat(F.lit("B:"), "p_brand"), F.concat(F.lit("T:"), "p_type"), F.concat(F.lit("S:"), F.col("p_size").cast("string")))
        return self.read("part").select(F.explode(kinds).alias("set_id"), F.col("p_partkey").alias("feature"))

    def scores(self) -> DataFrame:
        """feature, d, s: two scores of a part, each missing for some."""
        k = F.col("p_partkey")
        return self.read("part").select(
            k.alias("feature"), F.when(k % 5 != 0, (k % 7).cast("double") / F.lit(7.0)).alias("d"), F.when(k % 4 != 0, (k % 11).cast("double") / F.lit(11.0)).alias("s")
        )

    def names(self) -> DataFrame:
        """p_partkey and names of many shapes, made of part attributes."""
        k, upper = F.col("p_partkey"), F.upper(F.regexp_replace("p_type", "[^A-Za-z]", ""))
        shapes = F.array(
            F.concat(upper, F.lit(" "), "p_name"),
            F.concat(F.col("p_name"), F.lit(" ("), upper, F.lit(")")),
            F.concat(F.lit("DNA "), "p_name", F.lit(" (EC) (AB"), (k % 90).cast("string"), F.lit(")")),
            F.concat(F.lit("IGHV"), (k % 7 + 1).cast("string"), F.lit("-"), (k % 40).cast("string"), F.lit(" heavy chain variable")),
            F.concat(F.lit("Complement factor "), "p_name"),
            F.concat(F.lit("Lipid kinase of "), "p_name", F.lit(", calcium")),
            F.concat(F.lit("immunoglobulin "), "p_brand"),
        )
        return self.read("part").select("p_partkey", F.when(k % 31 != 30, F.get(shapes, (k % 7).cast("int"))).alias("name"), "p_name", "p_brand", "p_type", "p_size")
