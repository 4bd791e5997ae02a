"""Ranks, totals, quantiles and correlations of large groups against numpy and pandas."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from omixel.operators import blocks, enrich, order, stats


@pytest.fixture(scope="module")
def values(spark):
    """One group of a million rows with ties, a few small ones, one without a value."""
    rows = spark.range(1_000_000).select(F.lit("big").alias("g"), F.when(F.col("id") % 3 == 0, F.lit(0.5)).otherwise(F.round(F.randn(1) * 100, 2)).alias("v"), F.col("id"))
    small = spark.createDataFrame([(g, v, 2_000_000 + i) for i, (g, v) in enumerate((("one", 3.5), ("two", -1.0), ("two", 4.0), ("none", None), (None, 7.0), (None, -0.0), (None, 0.0), ("two", None)))], "g string, v double, id long")
    df = rows.unionByName(small).repartition(6)
    return df, df.toPandas()


def test_quantiles(values):
    df, frame = values
    shares = [0.0, 0.05, 0.25, 0.5, 0.777, 1.0]
    got = {r.g: (r.n, r.q) for r in order.quantiles(df, ["g"], "v", shares).collect()}
    assert set(got) == {"big", "one", "two", None}
    for g, (n, q) in got.items():
        v = frame[(frame.g == g) | ((g is None) & frame.g.isna())].v.dropna()
        assert n == len(v) and np.allclose(q, np.quantile(v, shares), atol=1e-12)
    assert order.quantiles(df, [], "v", [0.5]).first().n == frame.v.count()
    assert order.quantiles(df.filter("g = 'none'"), ["g"], "v", [0.5]).count() == 0


def test_quantiles_sort_ranges_only(values):
    """No buffer of a group's values, and no window or sort by the group alone but over the totals of ranges."""
    plan = order.quantiles(values[0], ["g"], "v", [0.5])._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile" not in plan.lower() and "median" not in plan.lower()


def test_row_ranks(values):
    df, frame = values
    got = order.row_ranks(df, ["g"], "v", "id", descending=True).toPandas().sort_values("id")
    want = frame.dropna(subset="v").sort_values(["v", "id"], ascending=[False, True])
    want = want.assign(rank=want.groupby("g", dropna=False).cumcount() + 1, n=want.groupby("g", dropna=False).v.transform("size")).sort_values("id")
    assert got.id.tolist() == want.id.tolist() and got["rank"].tolist() == want["rank"].tolist() and got.n.tolist() == want.n.tolist()


def test_one_sample_is_many_tasks(values):
    """The rows of one group lie in many ranges, each of few distinct values."""
    big = values[0].filter("g = 'big' and v <> 0.5").withColumn("range", order.magnitude_bucket(F.col("v")))
    assert big.groupBy("range").count().agg(F.max("count")).first()[0] < 20_000


def test_mid_ranks_and_u(spark, values):
    df, frame = values
    some = df.filter("g <> 'big' or g is null or id < 30000").withColumn("y", (F.col("id") % 2).cast("int"))
    held = frame[(frame.g != "big") | (frame.id < 30000)].dropna(subset="v")
    want = held.assign(mid=held.groupby("g", dropna=False).v.rank(method="average")).sort_values("id")
    got = stats.mid_ranks(some, ["g"], "v").toPandas().sort_values("id")
    assert got.id.tolist() == want.id.tolist() and np.allclose(got.mid, want.mid)
    u = {r.g: r for r in stats.mann_whitney_u(some, ["g"], "v", "y").collect()}
    for g, part in want.groupby("g", dropna=False):
        r = u[None if pd.isna(g) else g]
        n1 = int((part.id % 2 == 1).sum())
        assert (r.n1, r.n0) == (n1, len(part) - n1) and r.u == part.mid[part.id % 2 == 1].sum() - n1 * (n1 + 1) / 2
        assert r.ties == sum(t**3 - t for t in part.v.value_counts())


def test_iqr_of_nothing(spark):
    scores = spark.createDataFrame([("a", 1, 2.0), ("a", 2, None), ("b", 1, None), ("c", 1, 1.0), ("c", 2, 4.0)], "set_id string, sample_id int, es double")
    assert {r.set_id: r.iqr for r in enrich.iqr(scores).collect()} == {"a": 0.0, "b": 0.0, "c": 1.5}


@pytest.mark.parametrize(("block", "slice_"), [(256, 4096), (7, 11)])
def test_correlations(spark, block, slice_):
    """With holes, a constant item, an item of one value, two groups; every two blocks and slices."""
    rng = np.random.default_rng(2)
    rows = []
    for g in ("x", "y"):
        m = rng.normal(size=(40, 30)) + 1000
        m[3] = 5.0
        m[rng.random(m.shape) < 0.3] = np.nan
        m[4, 1:] = np.nan
        m[5, :] = np.nan
        rows += [(g, f"i{i:02d}", j, None if np.isnan(m[i, j]) else float(m[i, j])) for i in range(40) for j in range(30)]
    df = spark.createDataFrame(rows, "g string, item string, place int, v double").repartition(5)
    got = {(r.g, r.a, r.b): (r.r, r.n) for r in blocks.correlations(df, "item", "place", "v", ["g"], block, slice_).collect()}
    frame = pd.DataFrame(rows, columns=["g", "item", "place", "v"])
    for g, part in frame.groupby("g"):
        wide = part.pivot(index="place", columns="item", values="v").astype(float)
        for i, a in enumerate(wide.columns):
            for b in wide.columns[i + 1 :]:
                both = wide[[a, b]].dropna()
                assert ((g, a, b) in got) == (len(both) > 0)
                if len(both):
                    r, n = got[g, a, b]
                    want = both[a].corr(both[b]) if len(both) > 1 and both[a].nunique() > 1 and both[b].nunique() > 1 else None
                    assert n == len(both) and (r is None) == (want is None) and (r is None or abs(r - want) < 1e-9), (a, b, r, want)


def test_blocks_are_what_is_sent(spark):
    """Rows that meet are blocks: their number follows the number of blocks, not of cells or pairs of items."""
    df = spark.range(600 * 20).select((F.col("id") % 600).alias("item"), F.floor(F.col("id") / 600).alias("place"), F.rand(3).alias("v"))
    packed = blocks.packed(df, [], "item", "place", "v", 5, 1)
    assert packed.count() == 5 and blocks.correlations(df, "item", "place", "v", block=120).count() == 600 * 599 // 2


def test_input_tables_are_merged(spark):
    """What is read of parts takes little on disk, so Spark would send all of it to the driver and from there to every task."""
    from omixel.operators import enrich, similarity
    from omixel.plans.tables import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    values = t.once("matrix", t.matrix)
    for df in (t.matrix(), similarity.meeting(t.membership()), enrich.ssgsea_grid(values, t.membership(), t.scores(), t.samples(), [(0.0, 1.0)])):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not [line for line in plan.splitlines() if "BroadcastHashJoin" in line and ("feature" in line or "l_partkey" in line)]
