"""Chained forests: trees against a plain version, blocks against none, and gaps that can be told."""

from __future__ import annotations

import numpy as np
import pytest

from omixel.functions.forests import completed, searched
from omixel.functions.solvers import Cuts, RegressionForest
from omixel.operators import impute


def _plain(x, y, w, least):
    """Values of all rows by one tree on the weighted rows: the first best cut of all columns, again and again."""
    rows = np.flatnonzero(w > 0)

    def grow(inside, asked):
        wi, yi = w[inside], y[inside]
        squares = (wi * (yi - (wi * yi).sum() / wi.sum()) ** 2).sum() or 1.0
        best = (0.0, None, None)
        for f in range(x.shape[1]):
            for t in np.unique(x[:, f])[:-1]:
                low = x[inside, f] <= t
                if least <= low.sum() <= len(inside) - least:
                    gain = sum((wi[m] * yi[m]).sum() ** 2 / wi[m].sum() for m in (low, ~low)) - (wi * yi).sum() ** 2 / wi.sum()
                    gain /= squares
                    if gain > best[0] + 1e-9:
                        best = (gain, f, t)
        _, f, t = best
        if f is None:
            return {i: (wi * yi).sum() / wi.sum() for i in asked}
        low = x[:, f] <= t
        return grow(inside[low[inside]], [i for i in asked if low[i]]) | grow(inside[~low[inside]], [i for i in asked if not low[i]])

    got = grow(rows, list(range(len(y))))
    return np.array([got[i] for i in range(len(y))])


@pytest.mark.parametrize("least", [1, 2, 4])
def test_forest_is_the_plain_one(least):
    rng = np.random.default_rng(least)
    x, y = rng.standard_normal((40, 6)), rng.standard_normal(40)
    y[:5] = np.nan
    forest = RegressionForest(y, 8, [3], least)
    forest.grow(Cuts(x))
    want = np.mean([_plain(x, forest.y, w, least) for w in forest.weights], 0)
    assert np.allclose(forest.values(), want)
    assert all(len(np.unique(p)) > 40 / 4 / least - 2 for p in forest.place)


def test_depth_has_no_bound():
    y = 2.0 ** np.arange(40)
    forest = RegressionForest(y, 1, [0], 1)
    forest.weights[:] = 1
    forest.grow(Cuts(np.arange(40.0)[:, None]))
    assert np.allclose(forest.values(), y)


def test_many_values_are_cut_in_bins():
    x = np.random.default_rng(0).standard_normal((1000, 2))
    cuts = Cuts(x, bins=31)
    assert np.bincount(cuts.column).tolist() == [31, 31]
    assert np.diff(cuts.below[:31].sum(1)).min() > 20


def _rows(n_samples=20, n_features=12, seed=5):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n_samples, 3))
    m = np.stack([base[:, f % 3] + 0.1 * rng.standard_normal(n_samples) for f in range(n_features)], 1)
    gaps = rng.random(m.shape) < 0.15
    gaps[:, 7], gaps[:, 11] = False, True  # a feature without gaps, and one without values
    return m, gaps


def test_blocks_make_no_difference(spark):
    m, gaps = _rows()
    cells = [(s, f"f{f}", float(m[s, f])) for s, f in zip(*np.nonzero(~gaps), strict=True)]
    matrix = spark.createDataFrame([(int(s), f, v) for s, f, v in cells], "sample_id int, feature string, value double")
    samples = spark.createDataFrame([(i,) for i in range(20)], "sample_id int")
    got = [{(r.sample_id, r.feature): r.imputed for r in impute.chained_forests(matrix, samples, 6, 1, block=block, targets_a_task=5).collect()} for block in (100, 5)]
    asked = {(int(s), f"f{f}") for s, f in zip(*np.nonzero(gaps), strict=True) if f != 11}
    assert set(got[0]) == set(got[1]) == asked
    assert all(got[0][k] == pytest.approx(got[1][k]) for k in asked)
    medians = {f"f{f}": np.median(m[~gaps[:, f], f]) for f in range(11)}
    error = np.mean([abs(got[0][s, f] - m[s, int(f[1:])]) for s, f in asked])
    assert error < 0.6 * np.mean([abs(medians[f] - m[s, int(f[1:])]) for s, f in asked])
    assert impute.chained_forests(matrix.filter("feature = 'f7'"), samples, 2, 2).count() == 0
    assert impute.chained_forests(matrix.limit(0), samples, 2, 2).count() == 0


def test_distinct_cuts_give_the_same_trees():
    """Each way to part the samples is kept once, with two features that make it; trees are those of all features' cuts, the own one left out.

    Copies of features add no cut; keys are of 64 bits, in which neighbouring ones differ by less than a double tells."""
    rng = np.random.default_rng(1)
    x = np.round(rng.standard_normal((25, 300)), 1)
    x = np.concatenate([x, x[:, :40]], 1)
    keys = np.int64(2**62) + np.arange(340) * 3 + 1
    told = impute.pd.concat(impute._cuts(iter([impute.pd.DataFrame({"column": keys, "values": list(x.T)})])))
    row = impute._packed(told.assign(block=0)).iloc[0]
    named = np.frombuffer(row["named"], np.int64).reshape(-1, 4)
    below = np.unpackbits(np.frombuffer(row["cuts"], np.uint8).reshape(len(named), -1), axis=1, count=25).astype(bool)
    distinct, every = Cuts.distinct(below, named[:, :2], named[:, 2:]), Cuts(x)
    either = {min(c.tobytes(), (~c).tobytes()) for c in every.below}
    assert len(distinct.below) == len(either) < len(every.below)
    for target in range(12):
        y = np.where(rng.random(25) < 0.2, np.nan, x[:, target] + 0.01 * rng.standard_normal(25))
        grown, plain, scanned = (RegressionForest(y, 6, [target]) for _ in range(3))
        grown.grow(distinct, int(keys[target]))
        plain.grow(every, target)
        while (scanned.place >= 0).any():  # level by level, as where there are several blocks
            scanned.cut(*scanned.search(distinct, int(keys[target]))[:2])
        assert np.allclose(grown.values(), plain.values(), rtol=0, atol=1e-12) and np.allclose(scanned.values(), plain.values(), rtol=0, atol=1e-12)
        want = np.mean([_plain(np.delete(x, target, 1), plain.y, w, 2) for w in plain.weights[:1]], 0) if target == 0 else None
        assert want is None or np.allclose(want[plain.known & (plain.weights[0] > 0)], _first_tree(plain)[plain.known & (plain.weights[0] > 0)])


def _first_tree(forest):
    leaf = np.unique(~forest.place[0], return_inverse=True)[1]
    return (np.bincount(leaf, forest.weights[0] * forest.y) / np.bincount(leaf, forest.weights[0]))[leaf]


def _gathered(x, keys, whole=True):
    """The distinct cuts of columns x, as words and as those of RegressionForest."""
    told = impute.pd.concat(impute._cuts(iter([impute.pd.DataFrame({"column": keys, "values": list(x.T)})])))
    half = len(told) // 2  # in two rows, as tasks pack them
    told = impute.pd.concat([told.assign(block=0)]).sort_values("cut")
    while 0 < half < len(told) and told["cut"].iloc[half] == told["cut"].iloc[half - 1]:
        half += 1
    block = impute.pd.concat([impute._packed(part) for part in (told.iloc[:half], told.iloc[half:]) if len(part)])
    named = np.concatenate([np.frombuffer(k, np.int64).reshape(-1, 4) for k in block["named"]])
    packed = np.concatenate([np.frombuffer(c, np.uint8) for c in block["cuts"]]).reshape(len(named), -1)
    below = np.unpackbits(packed, axis=1, count=len(x)).astype(bool)
    return impute._gathered(block, len(x), whole), Cuts.distinct(below, named[:, :2], named[:, 2:])


@pytest.mark.parametrize(("n", "columns", "digits", "gaps"), [(25, 400, 6, 0.35), (25, 20, 6, 0.2), (25, 300, 0, 0.35), (12, 60, 1, 0.3), (20, 3, 1, 0.3), (32, 60, 6, 0.02)])
def test_targets_at_once_have_the_same_trees(n, columns, digits, gaps):
    """Few cuts and many, ties of values and of columns, own columns, more rows than ways are tried for; levels by blocks find the same cuts."""
    rng = np.random.default_rng(columns)
    x = np.round(rng.standard_normal((n, columns)), digits)
    x[:, columns // 2 :: 3] = x[:, : len(range(columns // 2, columns, 3))]  # copies
    keys = rng.permutation(np.int64(2**62) + np.arange(columns) * 3 - (np.arange(columns) % 2) * 2**62 * 2)
    cuts, plain = _gathered(x, keys)
    y = x.T[:12].copy()
    y[rng.random(y.shape) < gaps] = np.nan
    y[np.isnan(y).all(1), 0] = 1.0
    seeds, asked = [[7, i] for i in range(len(y))], np.isnan(y)
    for least in (1, 2, 4):
        got, want = completed(cuts, keys[: len(y)], y, 6, seeds, least), y.copy()
        for i, v in enumerate(y):
            forest = RegressionForest(v, 6, seeds[i], least)
            forest.grow(plain, int(keys[i]))
            want[i, asked[i]] = forest.values()[asked[i]]
        assert np.allclose(got, want, rtol=0, atol=1e-12)
    forest, scanned = RegressionForest(y[0], 6, seeds[0]), RegressionForest(y[0], 6, seeds[0])
    while (forest.place >= 0).any():
        found, told = searched(cuts, forest, int(keys[0])), scanned.search(plain, int(keys[0]))
        some = told[0] > 0
        assert np.allclose(found[0], told[0]) and (found[2][some] == told[2][some]).all()
        forest.cut(*found[:2])
        scanned.cut(*told[:2])
        assert (forest.place == scanned.place).all()


def test_few_of_many_cuts_are_looked_at():
    """A tree costs no more with more cuts, and the first ones decide for nearly all targets, as all of them would."""
    rng = np.random.default_rng(0)
    x, y = rng.standard_normal((25, 20_000)), rng.standard_normal((150, 25))
    y[rng.random(y.shape) < 0.35] = np.nan
    keys, own, seeds = np.arange(20_000), np.full(150, -1), [[i] for i in range(150)]
    some, _ = _gathered(x[:, :5000], keys[:5000], whole=False)
    more, _ = _gathered(x, keys)
    first, want = completed(some, own, y, 10, seeds), completed(more, own, y, 10, seeds)
    assert len(more.codes) > 3 * len(some.codes) > 250_000
    assert more.compared < 1500 * 20_000 and more.compared < 1.3 * some.compared
    done = ~np.isnan(first).any(1)
    assert 120 < done.sum() < 150 and (first[done] == want[done]).all() and np.isnan(first[~done]).any(1).all()


def test_first_features_make_no_difference(spark):
    m, gaps = _rows(n_features=40)
    cells = [(int(s), f"f{f}", float(m[s, f])) for s, f in zip(*np.nonzero(~gaps), strict=True)]
    matrix = spark.createDataFrame(cells, "sample_id int, feature string, value double")
    samples = spark.createDataFrame([(i,) for i in range(20)], "sample_id int")
    got = [{(r.sample_id, r.feature): r.imputed for r in impute.chained_forests(matrix, samples, 3, 1, block=block, ahead=ahead).collect()} for block, ahead in ((100, 100), (100, 30), (10, 30))]
    assert set(got[0]) == set(got[1]) == set(got[2]) and len(got[0]) > 50
    assert all(got[0][k] == pytest.approx(got[i][k], abs=1e-12) for k in got[0] for i in (1, 2))
