"""Ranks, running totals and quantiles of large groups, without a task that sorts or buffers a whole group.

The order of the values is split into ranges that rise with the value (`magnitude_bucket`).  Ranges are counted first, partially where
the rows are; one small window over a group's ranges says how many rows lie before each; and only within a range are rows sorted.
A group may so be as large as all rows.  Null values take no part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import magnitude_bucket
from ..storage import stored


def _group(by: list[str]) -> Column:
    """The group as one value, which is never null and joins on nulls too."""
    return F.struct(F.lit(0).alias("all"), *by)


def _ordered(column: str, descending: bool) -> Column:
    return F.col(column).desc() if descending else F.col(column).asc()


def running(values: DataFrame, by: list[str], value: str, kind: str, column: str, to: str, descending: bool = False) -> DataFrame:
    """`kind` (sum or min) of a column over the rows of a group up to this one, in the order of `value`, which holds no double twice a group.

    Ranges of the value are totalled first, so that rows are sorted within their range only and one task sees no more than the ranges' totals.
    `values` are read twice, so they had better be stored."""
    of = {"sum": F.sum, "min": F.min}[kind]
    dealt = values.withColumn("__group", _group(by)).withColumn("__range", magnitude_bucket(F.col(value)))
    totals = dealt.groupBy("__group", "__range").agg(of(column).alias("__total"))
    earlier = Window.partitionBy("__group").orderBy(_ordered("__range", descending)).rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("__group", "__range", of("__total").over(earlier).alias("__before"))
    here = of(column).over(Window.partitionBy("__group", "__range").orderBy(_ordered(value, descending)).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    joined = dealt.join(before.hint("merge"), ["__group", "__range"]).withColumn(to, here)
    both = F.col(to) + F.coalesce("__before", F.lit(0)) if kind == "sum" else F.least(to, "__before")
    return joined.withColumn(to, both).drop("__group", "__range", "__before")


def row_ranks(rows: DataFrame, by: list[str], value: str, *ties: str, to: str = "rank", size: str = "n", descending: bool = False, weight: str | None = None) -> DataFrame:
    """The rows that have a value, with their place (from 1) in their group by value, then by the tie columns, and the group's size.

    A row of a whole `weight` stands for as many rows, of which it has the first one's place.
    Rows of one value are put in order by one task.  The rows are read twice, so they had better be stored."""
    dealt = rows.filter(F.col(value).isNotNull()).withColumn("__group", _group(by)).withColumn("__range", magnitude_bucket(F.col(value)))
    counts = dealt.groupBy("__group", "__range").agg((F.sum(weight) if weight else F.count("*")).alias("__in"))
    whole = Window.partitionBy("__group")
    upto = F.sum("__in").over(whole.orderBy(_ordered("__range", descending)).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    offsets = counts.select("__group", "__range", (upto - F.col("__in")).alias("__before"), F.sum("__in").over(whole).alias(size))
    inside = Window.partitionBy("__group", "__range").orderBy(_ordered(value, descending), *ties)
    here = F.sum(weight).over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col(weight) + 1 if weight else F.row_number().over(inside)
    return dealt.join(offsets.hint("merge"), ["__group", "__range"]).withColumn(to, F.col("__before") + here).drop("__group", "__range", "__before")


def value_counts(rows: DataFrame, by: list[str], value: str, **counted: Column) -> DataFrame:
    """by, value, how often it occurs (`peers`) and in how many rows each of the conditions holds; ties meet before the shuffle."""
    cells = [F.count(F.when(rule, 1)).alias(name) for name, rule in counted.items()]
    return rows.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("peers"), *cells)


def quantiles(rows: DataFrame, by: list[str], value: str, shares: list[float], to: str = "q") -> DataFrame:
    """by, n, and the exact quantiles as an array in the order of `shares`, linear between neighbours; a group without values is absent.

    Only ranges that hold a wanted place are sorted, and of those the distinct values; the counts per value are stored, as they are read twice."""
    keys = [F.col(c) for c in by]
    held = value_counts(rows, by, value).select(_group(by).alias("__group"), *[k.alias(f"__by{i}") for i, k in enumerate(keys)], F.col(value).cast("double").alias("__value"), "peers")
    held = stored(held.withColumn("__range", magnitude_bucket(F.col("__value"))), "values")
    counts = held.groupBy("__group", "__range").agg(F.sum("peers").alias("__in"))
    whole = Window.partitionBy("__group")
    upto = F.sum("__in").over(whole.orderBy("__range").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = counts.select("__group", "__range", (upto - F.col("__in")).alias("__before"), "__in", F.sum("__in").over(whole).alias("n"))
    at = [F.lit(float(s)) * (F.col("n") - 1) for s in shares]
    wanted = F.array_distinct(F.array(*[f(a).cast("long") for a in at for f in (F.floor, F.ceil)]))
    # of a group's ranges those that hold the k-th row, k from 0
    here = placed.withColumn("__wanted", F.filter(wanted, lambda k: (k >= F.col("__before")) & (k < F.col("__before") + F.col("__in")))).filter(F.size("__wanted") > 0)
    inside = held.join(here.drop("__in"), ["__group", "__range"])
    last = F.col("__before") + F.sum("peers").over(Window.partitionBy("__group", "__range").orderBy("__value").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = inside.withColumn("__last", last).withColumn("__k", F.explode(F.filter("__wanted", lambda k: (k < F.col("__last")) & (k >= F.col("__last") - F.col("peers")))))
    values = F.map_from_entries(F.collect_list(F.struct("__k", "__value")))
    told = found.groupBy("__group").agg(F.first("n").alias("n"), values.alias("__at"), *[F.first(f"__by{i}").alias(c) for i, c in enumerate(by)])

    def between(a: Column) -> Column:
        low, high = F.element_at("__at", F.floor(a).cast("long")), F.element_at("__at", F.ceil(a).cast("long"))
        return low + (a - F.floor(a)) * (high - low)

    return told.select(*by, "n", F.array(*[between(a) for a in at]).alias(to))
