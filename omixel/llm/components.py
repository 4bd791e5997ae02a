"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is a group-by minimum, which is summed before the shuffle, and an equi-join, whose hot keys Spark can split;
no component is ever gathered in one place.  Each round is written to the shared folder, so lost executors
cost at most a round.  The number of rounds grows with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import cluster


def _least_neighbour(edges: DataFrame) -> DataFrame:
    """u, m: the least of u and its neighbours."""
    return edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours point to its least neighbour."""
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.join(_least_neighbour(both), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours point to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _least_neighbour(down)
    return down.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """id, component (the least id reachable) of every id that has an edge to another id."""
    spark = edges.sparkSession
    current = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    state, kept = None, []
    while True:
        with cluster.shuffles_end_with_query(spark):
            path = cluster.scratch(spark, "components")
            current.write.parquet(path)
        now = spark.read.schema(current.schema).parquet(path)
        found = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        kept.append(path)
        for old in kept[:-1]:
            cluster.remove(spark, old)
        kept = kept[-1:]
        if found == state:
            return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionAll(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
        state = found
        current = _small_star(_large_star(now).distinct()).distinct()
