"""Published values and plain versions of the statistics."""

from __future__ import annotations

import itertools
import math
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from omixel.functions import numeric, solvers
from omixel.operators import similarity, stats


@pytest.mark.parametrize(("k", "low", "high"), [(29, 0.828, 0.999), (21, 0.506, 0.853), (18, 0.406, 0.773)])
def test_clopper_pearson(k, low, high):
    a, b = stats.binomial_interval(k, 30)
    assert (round(a, 3), round(b, 3)) == (low, high)


def test_clopper_pearson_ends():
    assert stats.binomial_interval(0, 10)[0] == 0.0
    assert stats.binomial_interval(10, 10)[1] == 1.0


@pytest.mark.parametrize(("k", "n"), [(0, 1), (1, 1), (0, 40), (40, 40), (1, 40), (7, 40), (20, 40), (39, 40), (3, 2000), (1000, 2000), (1900, 2000)])
@pytest.mark.parametrize("alpha", [0.05, 0.001])
def test_clopper_pearson_tails(k, n, alpha):
    """At the bounds the tails, summed term by term, have alpha / 2."""
    term = lambda p, i: math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p))
    low, high = stats.binomial_interval(k, n, alpha)
    assert low == 0.0 if k == 0 else math.fsum(term(low, i) for i in range(k, n + 1)) == pytest.approx(alpha / 2, rel=1e-9)
    assert high == 1.0 if k == n else math.fsum(term(high, i) for i in range(k + 1)) == pytest.approx(alpha / 2, rel=1e-9)


def test_clopper_pearson_of_many_is_quick():
    """What it takes grows with the root of n: the sum over a hundred million terms took minutes for each of 80 steps."""
    n = 100_000_000
    began = time.perf_counter()
    low, high = stats.binomial_interval(n // 4, n)
    assert time.perf_counter() - began < 20
    spread = 1.959963984540054 * math.sqrt(0.25 * 0.75 / n)
    assert (0.25 - low) / spread == pytest.approx(1, abs=1e-3) and (high - 0.25) / spread == pytest.approx(1, abs=1e-3)


def test_mann_whitney_p():
    assert stats.p_of_u(4.0, 2, 6, 0.0) == pytest.approx(_enumerated(4.0, 2, 6))
    # r = -0.5 for groups of 8 in all, 2 of them in one
    assert stats.p_of_u(12.0, 8, 2, 0.0) == pytest.approx(0.4)
    # r = -0.46 for groups of 20 and 10
    assert stats.p_of_u(146.0, 20, 10, 0.0) == pytest.approx(0.04531344230901011, abs=1e-12)


def _enumerated(u, n1, n0):
    us = [sum(c) - n1 * (n1 - 1) / 2 for c in itertools.combinations(range(n1 + n0), n1)]
    far = abs(u - n1 * n0 / 2)
    return min(1.0, 2 * sum(x >= n1 * n0 / 2 + far for x in us) / len(us))


@pytest.mark.parametrize("u", [0, 3, 5, 8, 10])
def test_mann_whitney_exact(u):
    assert stats.p_of_u(float(u), 2, 5, 0.0) == pytest.approx(_enumerated(u, 2, 5))


def test_normal_tail_expression(spark):
    rows = [(float(u), 20, 10, 6.0) for u in range(0, 201, 7)]
    df = spark.createDataFrame(rows, "u double, n1 long, n0 long, ties double")
    import pyspark.sql.functions as F

    got = df.select("u", stats.normal_p(F.col("u"), F.col("n1"), F.col("n0"), F.col("ties")).alias("p")).collect()
    assert all(r.p == pytest.approx(stats.p_of_u(r.u, 20, 10, 6.0), abs=5e-7) for r in got)


def test_bh(spark):
    p = [0.01, 0.04, 0.03, 0.005, 0.5]
    df = stats.benjamini_hochberg(spark.createDataFrame([(i, x) for i, x in enumerate(p)], "i int, p double"))
    got = [r.q for r in df.orderBy("i").collect()]
    assert got == pytest.approx([0.025, 0.05, 0.05, 0.025, 0.5])


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("ab"), st.none() | st.sampled_from([0.0, 1.0, 0.25, 0.01]) | st.floats(0, 1)), min_size=1, max_size=40))
def test_bh_by_group_with_ties_and_nulls(spark, rows):
    df = spark.createDataFrame([(i, g, x) for i, (g, x) in enumerate(rows)], "i int, g string, p double")
    got = {r.i: r.q for r in stats.benjamini_hochberg(df, by=["g"]).collect()}
    assert len(got) == len(rows)
    for i, (g, x) in enumerate(rows):
        ps = sorted(y for h, y in rows if h == g and y is not None)
        want = None if x is None else min([1.0] + [y * len(ps) / (k + 1) for k, y in enumerate(ps) if y >= x])
        assert got[i] == (want if want is None else pytest.approx(want))


def test_area_of_tied_negative_and_null_scores(spark):
    rows = [(1, 0.5), (0, 0.5), (1, -2.0), (0, -3.5), (1, 0.0), (0, 0.0), (0, 1e-300), (1, 7.0), (1, None), (None, 2.0), (1, math.inf), (0, 1e9)]
    one, zero = ([x for y, x in rows if y == k and x is not None] for k in (1, 0))
    want = sum((a > b) + (a == b) / 2 for a in one for b in zero) / (len(one) * len(zero))
    df = spark.createDataFrame([(y, 1, s) for y, s in rows], "y int, predicted int, score double")
    assert stats.metrics(df).first().auc == pytest.approx(want)
    alone = stats.metrics(df.filter("y = 1")).first()
    assert alone.auc is None
    assert alone.tp == 6


@settings(max_examples=10, deadline=None)
@given(st.lists(st.floats(allow_nan=False), min_size=2, max_size=60))
def test_ranges_keep_the_order_of_doubles(spark, values):
    got = spark.createDataFrame([(float(v),) for v in values], "x double").select("x", numeric.magnitude_bucket(F.col("x")).alias("b")).orderBy("x").collect()
    assert all(a.b <= b.b for a, b in itertools.pairwise(got))


def _plain_upgma(d):
    clusters, heights = [[i] for i in range(len(d))], []
    while len(clusters) > 1:
        pairs = [(np.mean([d[i][j] for i in a for j in b]), x, y) for x, a in enumerate(clusters) for y, b in enumerate(clusters) if x < y]
        h, x, y = min(pairs)
        heights.append(h)
        clusters[x] += clusters.pop(y)
    return heights


@settings(max_examples=25, deadline=None)
@given(st.integers(2, 9), st.integers(0, 10_000))
def test_average_linkage(n, seed):
    d = np.random.default_rng(seed).random((n, n))
    d = (d + d.T) / 2
    merges = similarity.average_linkage(d)
    assert sorted(h for _, _, h in merges) == pytest.approx(sorted(_plain_upgma(d)))
    assert len(set(similarity.cut(n, merges, 2.0))) == 1
    assert len(set(similarity.cut(n, merges, -1.0))) == n


def test_l2_logistic_is_at_its_minimum():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((40, 4))
    y = (x[:, 0] + rng.standard_normal(40) > 0).astype(int)
    b = solvers.logistic_l2(x, y, 0.7)
    w, p = solvers.balanced_weights(y), solvers.sigmoid(x @ b[:-1] + b[-1])
    gradient = 0.7 * np.hstack([x, np.ones((40, 1))]).T @ (w * (p - y)) + np.append(b[:-1], 0)
    assert np.abs(gradient).max() < 1e-5


def test_elastic_net_conditions():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((60, 8))
    y = (x[:, 0] - x[:, 1] + rng.standard_normal(60) > 0).astype(int)
    c, r = 0.2, 0.7
    b = solvers.logistic_elastic_net(x, y, c, r, rounds=20_000, tolerance=1e-12)
    w, p = solvers.balanced_weights(y), solvers.sigmoid(x @ b[:-1] + b[-1])
    g = c * x.T @ (w * (p - y)) + (1 - r) * b[:-1]
    on = np.abs(b[:-1]) > 1e-9
    assert np.abs(g[on] + r * np.sign(b[:-1][on])).max(initial=0) < 1e-4
    assert (np.abs(g[~on]) <= r + 1e-4).all()


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 5)), min_size=2, max_size=30))
def test_auc_and_kappa(rows):
    y, s = np.array([a for a, _ in rows]), np.array([float(b) for _, b in rows])
    area = solvers.auc(y, s)
    if 0 < y.sum() < len(y):
        pairs = [(s[i] > s[j]) + (s[i] == s[j]) / 2 for i in np.flatnonzero(y == 1) for j in np.flatnonzero(y == 0)]
        assert area == pytest.approx(np.mean(pairs))
        assert area == pytest.approx(1 - solvers.auc(1 - y, s))
    else:
        assert math.isnan(area)
    k = solvers.kappa(y, (s > 2).astype(int))
    assert math.isnan(k) or k <= 1 + 1e-12


def test_ledoit_wolf_shrinks():
    x = np.random.default_rng(0).standard_normal((10, 13))
    c, s = solvers.ledoit_wolf(x)
    assert 0 < s <= 1 and np.linalg.cond(c) < 1e4 and np.allclose(c, c.T)


def test_forest():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((60, 5))
    y = (x[:, 2] > 0).astype(int)
    p = solvers.Forest(60, 3).fit(x, y).probability(x)
    assert ((p > 0.5) == (y == 1)).mean() > 0.9


def test_p_expression(spark):
    import pyspark.sql.functions as F

    rows = [(float(u), a, b, t) for a, b in ((1, 1), (3, 2), (8, 12), (9, 10), (2, 40)) for t in (0.0, 6.0) for u in range(a * b + 1)] + [(0.0, 0, 5, 0.0), (12.5, 5, 5, 120.0)]
    got = spark.createDataFrame(rows, "u double, n1 long, n0 long, ties double").withColumn("p", stats.mann_whitney_p()).collect()
    assert len(got) == len(rows)
    for r in got:
        want = stats.p_of_u(r.u, r.n1, r.n0, r.ties) if r.n1 + r.n0 > 2 or not r.ties else None
        if not r.n1 or not r.n0:
            assert r.p is None
        elif want is not None and r.n1 * r.n0:
            assert r.p == pytest.approx(want, abs=5e-7), r


def test_reproduced(spark):
    a, b = (spark.createDataFrame(r, "k int, v double") for r in ([(1, 0.5), (2, 0.5), (3, None), (4, 1.0)], [(1, 0.509), (2, 0.52), (3, 1.0), (5, 1.0)]))
    assert {r.k: r.same for r in stats.reproduced(a, b, ["k"], "v").collect()} == {1: True, 2: False, 3: False, 4: False, 5: False}


def test_elastic_nets_at_once():
    """Many problems in one batch give what each of them gives alone, and the same selection over C and ratios."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(30, 12))
    y = (x[:, 0] - x[:, 1] + rng.normal(size=30) > 0).astype(int)
    w = solvers.balanced_weights(y)
    part = np.where(np.arange(30) < 22, 1.0, 0.0)
    part[:22] *= solvers.balanced_weights(y[:22])
    problems = [(w, 0.3, 0.5), (w, 10.0, 0.9), (part, 1.0, 0.7)]
    got = solvers.elastic_nets(x, y, np.stack([p[0] for p in problems], 1), np.array([p[1] for p in problems]), np.array([p[2] for p in problems]), rounds=20_000, tolerance=1e-11)
    for k, (weights, c, ratio) in enumerate(problems):
        rows = weights > 0
        assert np.allclose(got[:, k], solvers.logistic_elastic_net(x[rows], y[rows], c, ratio, rounds=20_000, tolerance=1e-12), atol=1e-6)
    one, _, _ = solvers.cross_validated(x, y, (0.5, 0.9), 6, 5, "roc_auc")
    assert ((np.abs(one) > 1e-6) == (np.abs(solvers.cross_validated_elastic_net(x, y, (0.5, 0.9), 6)) > 1e-6)).all()
