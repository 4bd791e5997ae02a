"""Imputation: left-tail draws for features with many gaps, chained forests for those with few, assembly and accounting."""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.forests import Partings, completed, searched
from ..functions.solvers import EQUAL, Cuts, RegressionForest
from ..storage import stored
from .order import quantiles


def tail_parameters(matrix: DataFrame, least: int = 3) -> DataFrame:
    """feature, mu, sigma, lower, upper of the truncated normal that missing values are drawn from.

    Features with fewer than `least` values have none and stay as they are."""
    spread = matrix.filter("value is not null").groupBy("feature").agg(F.stddev_samp("value").alias("s"), (F.min("value") - 2.0).alias("lower"))
    stats = quantiles(matrix, ["feature"], "value", [0.01, 0.05]).join(spread, "feature")
    mu = F.col("q")[0]
    sigma = F.lit(0.3) * F.when(F.col("s").isNull() | (F.col("s") == 0) | F.isnan("s"), 0.5).otherwise(F.col("s"))
    upper = F.when(F.col("q")[1] <= F.col("mu"), F.col("mu") + F.col("sigma")).otherwise(F.col("q")[1])
    return stats.filter(F.col("n") >= least).withColumn("mu", mu).withColumn("sigma", sigma).withColumn("upper", upper).select("feature", "mu", "sigma", "lower", "upper")


def _draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    normal = NormalDist()
    for f in frames:
        out = []
        for u, mu, sigma, low, high in zip(f["u"], f["mu"], f["sigma"], f["lower"], f["upper"], strict=True):
            a, b = normal.cdf((low - mu) / sigma), normal.cdf((high - mu) / sigma)
            q = min(max(a + u * (b - a), 1e-300), 1 - 1e-16)
            out.append(min(max(mu + sigma * normal.inv_cdf(q), low), high))
        yield f[["sample_id", "feature"]].assign(imputed=out)


def tail_draws(missing: DataFrame, parameters: DataFrame, seed: int = 42) -> DataFrame:
    """sample_id, feature, imputed for each missing cell; a draw depends on seed, sample and feature only."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("sample_id").cast("string"), F.col("feature").cast("string")))
    u = F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))
    cells = missing.select("sample_id", "feature").join(parameters, "feature").withColumn("u", u)
    schema = f"sample_id {cells.schema['sample_id'].dataType.simpleString()}, feature {cells.schema['feature'].dataType.simpleString()}, imputed double"
    return cells.mapInPandas(_draw, schema)


def _cuts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The cuts of features: packed rows on the side without the first row, column and place; of those that part the rows alike the first two of a frame."""
    for f in frames:
        f = f.sort_values("column")
        cuts = Cuts(np.array(f["values"].to_list(), float).T)
        packed = np.packbits(cuts.below ^ cuts.below[:, :1], axis=1)
        alike = pd.DataFrame({"cut": [p.tobytes() for p in packed], "column": f["column"].to_numpy(np.int64)[cuts.column], "place": np.arange(len(packed), dtype=np.int32)})
        yield alike[alike.groupby("cut").cumcount() < 2]


def _packed(f: pd.DataFrame) -> pd.DataFrame:
    """The distinct cuts of a block in one row; (column, place) of each, and the least of another column that has it."""
    f = f.sort_values(["cut", "column", "place"])
    named, first = f[["column", "place"]].to_numpy(np.int64), np.flatnonzero((f.groupby("cut").cumcount() == 0).to_numpy())
    two = np.diff(np.append(first, len(f))) > 1
    second = np.where(two[:, None], named[np.minimum(first + 1, len(f) - 1)], -1)
    return pd.DataFrame([[f["block"].iloc[0], b"".join(f["cut"].iloc[first]), np.hstack([named[first], second]).tobytes()]], columns=["block", "cuts", "named"])


def _gathered(block: pd.DataFrame, n: int, whole: bool = True) -> Partings | Cuts:
    """The cuts of a block, from any number of rows."""
    named = [np.frombuffer(x, np.int64).reshape(-1, 4) for x in block["named"]]
    packed = [np.frombuffer(x, np.uint8).reshape(len(k), -1) for x, k in zip(block["cuts"], named, strict=True)]
    named, packed = np.concatenate([np.zeros((0, 4), np.int64), *named]), np.concatenate([np.zeros((0, (n + 7) // 8), np.uint8), *packed])
    if n <= Partings.FIT:
        return Partings(packed, named, n, whole)
    return Cuts.distinct(np.unpackbits(packed, axis=1, count=n).astype(bool), named[:, :2], named[:, 2:])


def _completed(trees: int, seed: int, round_: int, whole: bool, at_once: int = 512):
    """A group of targets and cuts: whole trees.  Where these are not all cuts, targets that may need others have no prediction."""

    def complete(targets: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(targets):
            cuts = _gathered(block, len(targets["value"].iloc[0]), whole)
            for i in range(0, len(targets), at_once):
                f = targets.iloc[i : i + at_once]
                y, keys = np.array(f["value"].to_list(), float), f["key"].to_numpy(np.int64)
                if isinstance(cuts, Partings):
                    y = completed(cuts, keys, y, trees, [_seed(seed, round_, k) for k in keys.tolist()])
                else:
                    for j, (v, k) in enumerate(zip(y, keys.tolist(), strict=True)):
                        forest = RegressionForest(v, trees, _seed(seed, round_, k))
                        forest.grow(cuts, k)
                        y[j] = forest.values()
                out.append(f[["key", "value"]].assign(predicted=[None if np.isnan(v).any() else v for v in y]))
        return pd.concat(out) if out else pd.DataFrame(columns=["key", "value", "predicted"])

    return complete


def _found(trees: int, seed: int, round_: int):
    """A group of targets and a block of cuts: the best cut of each open node within that block."""

    def search(targets: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(targets):
            cuts = _gathered(block, len(targets["value"].iloc[0]))
            for t in targets.itertuples():
                forest = _forest(t, trees, seed, round_)
                gain, below, first = searched(cuts, forest, t.key) if isinstance(cuts, Partings) else forest.search(cuts, t.key)
                out.append((t.key, gain.tobytes(), np.ascontiguousarray(first).tobytes(), np.packbits(below, axis=1).tobytes()))
        return pd.DataFrame(out, columns=["key", "gain", "column", "below"])

    return search


def _seed(seed: int, round_: int, key: int) -> list[int]:
    return [seed, round_, key % (1 << 63)]


def _forest(t, trees: int, seed: int, round_: int) -> RegressionForest:
    place = np.frombuffer(t.place, np.int32) if t.place else None
    return RegressionForest(np.array(t.value, float), trees, _seed(seed, round_, t.key), place=place)


def _applied(trees: int, seed: int, round_: int):
    """One target: its forest cut where the best of all blocks is."""

    def apply(targets: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        t = next(targets.itertuples())
        forest = _forest(t, trees, seed, round_)
        if (forest.place >= 0).any():
            gains = np.stack([np.frombuffer(g, float) for g in found["gain"]])
            named = np.stack([np.frombuffer(c, np.int64).reshape(-1, 2) for c in found["column"]])
            bits = np.stack([np.frombuffer(x, np.uint8).reshape(gains.shape[1], -1) for x in found["below"]])
            near, last = gains >= gains.max(0) - EQUAL, np.iinfo(np.int64).max  # of equal cuts that of the least key, whatever its block
            columns = np.where(near, named[:, :, 0], last)
            best = np.where(near & (columns == columns.min(0)), named[:, :, 1], last).argmin(0)
            k = np.arange(gains.shape[1])
            forest.cut(gains[best, k], np.unpackbits(bits[best, k], axis=1, count=forest.place.shape[1]).astype(bool))
        place = forest.place.tobytes()
        return targets.assign(place=place, open=bool((np.frombuffer(place, np.int32) >= 0).any()))

    return apply


def _predicted(trees: int, seed: int, round_: int):
    def predict(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            values = [_forest(t, trees, seed, round_).values() for t in f.itertuples()]
            yield f[["key"]].assign(predicted=[v.tolist() for v in values])

    return predict


def _distinct(features: DataFrame, tasks: int) -> tuple[DataFrame, int]:
    """The distinct cuts of features, each in two rows at most: with the two features of least key that make it; and how many there are."""
    every = features.select(F.col("key").alias("column"), F.col("now").alias("values")).repartition(tasks, "column").mapInPandas(_cuts, "cut binary, column long, place int")
    first = lambda rows: rows.groupBy("cut").agg(F.min(F.struct("column", "place")).alias("named"))
    every = stored(every, "cuts")
    least = stored(first(every), "first-cuts")
    others = first(every.join(least.hint("merge"), "cut").filter(F.col("column") != F.col("named.column")).select("cut", "column", "place"))
    return least.unionByName(others).select("cut", "named.column", "named.place"), least.count()


def _blocks(cuts: DataFrame, n_cuts: int, n_blocks: int) -> DataFrame:
    """block, cuts, named: each block in rows of about PIECE cuts, as one task packs a row."""
    dealt = F.pmod(F.xxhash64("cut"), F.lit(n_blocks * max(1, -(-n_cuts // (n_blocks * PIECE)))))
    parts = cuts.withColumn("piece", dealt).withColumn("block", F.pmod("piece", F.lit(n_blocks)).cast("int"))
    return stored(parts.groupBy("block", "piece").applyInPandas(_packed, "block int, cuts binary, named binary"), "packed-cuts")


PIECE = 1 << 17


def chained_forests(
    matrix: DataFrame, samples: DataFrame, trees: int = 100, rounds: int = 10, seed: int = 42, block: int = 65536, targets_a_task: int = 32768, tolerance: float = 1e-3, ahead: int = 32768
) -> DataFrame:
    """sample_id, feature, imputed of every missing cell of a feature that has some values.

    In each round every feature with gaps is predicted by a forest from all other features as they were after the round before; gaps start at medians, and
    rounds end once no imputed value moves by more than `tolerance` times the largest observed one.  Trees look at all features in each cut, without a bound on depth.

    A cut is a way to part the samples in two.  Those of all features are gathered and each is kept once, with the two features of least key that
    make it; so they are 2^(samples - 1) at most, however many features there are, and a target is held against them instead of against each feature.
    A target first meets the cuts of the `ahead` features of least keys.  Where these have the best of all ways to part a node, no other feature has a better one or
    an equal one that counts before it; targets of which all nodes are so are done.  The others, few of them, meet all features' cuts.
    These are in blocks of as many as `block` features may have; groups of targets meet blocks, each pair in a task, which finds the best cuts of
    all open nodes of its targets; the best of all blocks is taken, level by level.  Where one block holds all cuts, a task grows whole trees; the
    result is the same.  The samples are taken to be few: a feature's values are one row."""
    ids = sorted(r[0] for r in samples.select("sample_id").distinct().collect())
    spark, kinds = matrix.sparkSession, {c: matrix.schema[c].dataType.simpleString() for c in ("sample_id", "feature")}
    places = spark.createDataFrame(list(enumerate(ids)), f"place int, sample_id {kinds['sample_id']}")
    given = matrix.filter("value is not null and not isnan(value)").join(F.broadcast(places), "sample_id").groupBy("feature")
    by_place = given.agg(F.map_from_entries(F.collect_list(F.struct("place", F.col("value").cast("double")))).alias("held"), F.sort_array(F.collect_list(F.col("value").cast("double"))).alias("s"))  # one value a sample
    value = F.transform(F.sequence(F.lit(0), F.lit(len(ids) - 1)), lambda i: F.coalesce(F.try_element_at("held", i), F.lit(float("nan"))))
    now = F.transform("value", lambda v: F.when(F.isnan(v), F.col("m")).otherwise(v))
    median = (F.get("s", F.floor((F.size("s") - 1) / 2)) + F.get("s", F.floor(F.size("s") / 2))) / 2
    by_place = by_place.withColumn("m", median)
    features = stored(by_place.select("feature", F.xxhash64("feature").alias("key"), value.alias("value"), "m").withColumn("now", now).drop("m"), "features")
    gaps, parallel = F.exists("value", F.isnan), spark.sparkContext.defaultParallelism
    n_features, n_targets, largest = features.agg(F.count("*"), F.count_if(gaps), F.max(F.array_max(F.transform("value", lambda v: F.when(~F.isnan(v), F.abs(v)))))).first()
    tasks = lambda n: max(1, min(-(-n // 512), 4 * parallel))  # noqa: E731  # not left to the size of the rows, which says nothing of the work
    hashed = F.pmod(F.hash("key"), F.lit(1 << 20))

    def met(targets: DataFrame, blocks: DataFrame, n: int, n_blocks: int):
        """Groups of n targets, each with every block."""
        n_groups = max(1, -(-n // targets_a_task), min(-(-n // 16), 4 * parallel))
        n_tasks = max(4 * n_groups * n_blocks, parallel)
        dealt = targets.withColumn("group", F.pmod(hashed, F.lit(n_groups)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
        cuts = blocks.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1))))
        return dealt.repartition(n_tasks, "group", "block").groupBy("group", "block").cogroup(cuts.repartition(n_tasks, "group", "block").groupBy("group", "block"))

    def whole_trees(targets: DataFrame, cuts: DataFrame, n_cuts: int, n: int, round_: int, whole: bool) -> DataFrame:
        pairs = met(targets, _blocks(cuts, n_cuts, 1), n, 1)
        return stored(pairs.applyInPandas(_completed(trees, seed, round_, whole), "key long, value array<double>, predicted array<double>"), "predicted")

    def by_levels(targets: DataFrame, cuts: DataFrame, n_cuts: int, n: int, n_blocks: int, round_: int) -> DataFrame:
        blocks = _blocks(cuts, n_cuts, n_blocks)
        targets = targets.select("key", "value", F.lit(b"").alias("place"), F.lit(True).alias("open"))
        while n:
            found = met(targets.filter("open"), blocks, n, n_blocks).applyInPandas(_found(trees, seed, round_), "key long, gain binary, column binary, below binary")
            grown = targets.filter("open").groupBy("key").cogroup(found.groupBy("key")).applyInPandas(_applied(trees, seed, round_), "key long, value array<double>, place binary, open boolean")
            targets = stored(targets.filter("not open").unionByName(grown), "forests")
            n = targets.filter("open").count()
        return targets.mapInPandas(_predicted(trees, seed, round_), "key long, predicted array<double>")

    for round_ in range(rounds if n_targets else 0):
        left, n_left, done = features.filter(gaps).select("key", "value"), n_targets, []
        if n_features > ahead and len(ids) <= Partings.FIT:
            some = features.filter(F.col("key") < -(1 << 63) + (ahead << 64) // n_features)  # keys are hashes
            first = whole_trees(left, *_distinct(some, tasks(ahead)), n_left, round_, False)
            done.append(first.filter("predicted is not null").select("key", "predicted"))
            left = first.filter("predicted is null").select("key", "value")
            n_left = left.count()
        if n_left:
            cuts, n_cuts = _distinct(features, tasks(n_features))
            n_blocks = max(1, -(-n_cuts // (block * max(1, len(ids) - 1))))
            rest = by_levels(left, cuts, n_cuts, n_left, n_blocks, round_) if n_blocks > 1 else whole_trees(left, cuts, n_cuts, n_left, round_, True)
            done.append(rest.select("key", "predicted"))
        predicted = done[0] if len(done) == 1 else done[0].unionByName(done[1])
        again = F.when(F.col("predicted").isNull(), F.col("now")).otherwise(F.zip_with("value", "predicted", lambda v, p: F.when(F.isnan(v), p).otherwise(v)))
        moved = F.array_max(F.zip_with("now", "was", lambda a, b: F.abs(a - b)))
        features = stored(features.join(predicted.hint("merge"), "key", "left").withColumn("was", F.col("now")).withColumn("now", again).drop("predicted").withColumn("moved", moved).drop("was"), "features")
        if (features.agg(F.max("moved")).first()[0] or 0.0) <= tolerance * (largest or 0.0):
            break
        features = features.drop("moved")
    cells = features.filter(gaps).select("feature", F.posexplode(F.arrays_zip("value", "now")).alias("place", "cell")).filter(F.isnan("cell.value"))
    return cells.join(F.broadcast(places), "place").select("sample_id", "feature", F.col("cell.now").alias("imputed"))


def assembled(matrix: DataFrame, samples: DataFrame, tiers: DataFrame, imputed: DataFrame) -> DataFrame:
    """Every cell of the features: observed values, imputed ones where there are any, null else."""
    cells = samples.select("sample_id").join(tiers.select("feature", "tier"), how="cross").join(matrix, ["sample_id", "feature"], "left").join(imputed, ["sample_id", "feature"], "left")
    return cells.withColumn("full", F.coalesce("value", "imputed"))


def accounting(cells: DataFrame) -> DataFrame:
    """tier, features, missing before, imputed, still missing."""
    return cells.groupBy("tier").agg(
        F.count_distinct("feature").alias("features"),
        F.count_if(F.col("value").isNull()).alias("missing"),
        F.count_if(F.col("value").isNull() & F.col("full").isNotNull()).alias("imputed"),
        F.count_if(F.col("full").isNull()).alias("left_missing"),
    )
