"""Similarity of sets and redundancy: Jaccard, correlation, average linkage."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import stored
from .order import row_ranks

#: sets of one feature that meet in one task
MEETING = 1_000
#: sets that one task may cluster: their distances take 8 n^2 bytes
MOST_SETS = 20_000


def meeting(rows: DataFrame, limit: int = MEETING) -> DataFrame:
    """a, b (structs of a row's other columns, a of the lesser set_id) for every two sets that share a feature, once for each such feature.

    The sets of a feature are dealt to blocks of about `limit` by a hash, and every two blocks meet at a key of their own; so a feature
    that most sets have is many tasks.  What Spark takes a table of sets for, from its size on disk, is far below what it holds: joins are merged."""
    others = [F.col(c) for c in rows.columns if c != "feature"]
    blocks = rows.groupBy("feature").agg(F.ceil(F.count("*") / limit).alias("blocks"))
    block = F.pmod(F.xxhash64("set_id"), F.col("blocks"))
    dealt = rows.join(blocks.hint("merge"), "feature").select("feature", F.struct(*others).alias("row"), block.alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    sides = dealt.select("feature", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "row")
    left = sides.filter("block = low").select("feature", "low", "high", F.col("row").alias("x"))
    right = sides.filter("block = high").select("feature", "low", "high", F.col("row").alias("y"))
    pairs = left.join(right.hint("merge"), ["feature", "low", "high"]).filter("low < high or x.set_id < y.set_id")
    less = F.col("x.set_id") < F.col("y.set_id")
    return pairs.select(F.when(less, F.col("x")).otherwise(F.col("y")).alias("a"), F.when(less, F.col("y")).otherwise(F.col("x")).alias("b"))


def similar_pairs(membership: DataFrame, threshold: float, limit: int = MEETING) -> DataFrame:
    """a < b and their Jaccard similarity, for the pairs that reach the threshold (above 0): what jaccard_pairs gives, filtered.

    Features of the same sets are one feature with a weight.  Of each set only its rarest features are joined: two sets at the threshold share
    one of the first size - ceil(threshold * size) + 1 in order of rarity.  A pair met there is dropped where its sizes, or what is left
    of both sets from there on, cannot reach the threshold; the others' common features are counted."""
    _check(threshold)
    m = alike(membership)
    return _of_candidates(m, _candidates(m, threshold, limit), threshold)


def candidate_pairs(membership: DataFrame, threshold: float, limit: int = MEETING) -> DataFrame:
    """a, b, na, nb: the pairs of which similar_pairs counts the common features."""
    _check(threshold)
    return _candidates(alike(membership), threshold, limit)


def _check(threshold: float) -> None:
    if not 0 < threshold <= 1:
        raise ValueError("the threshold lies above 0, and at 1 at most")


def alike(membership: DataFrame) -> DataFrame:
    """set_id, feature, sets, weight: of features that are in the same sets the least one, in how many sets it is, and how many features it stands for.

    The sets of a feature are told by two 64-bit hashes, combined whatever their order, and their number.  Joins are merged: what a table
    takes on disk says little of its rows, so Spark would broadcast tables of many millions."""
    m = stored(membership.select("set_id", "feature").filter("set_id is not null and feature is not null").distinct(), "members")
    signature = [F.bit_xor(F.xxhash64(F.lit(i), "set_id")).alias(f"h{i}") for i in (0, 1)]
    kinds = m.groupBy("feature").agg(F.count("*").alias("sets"), *signature).groupBy("sets", "h0", "h1").agg(F.min("feature").alias("feature"), F.count("*").alias("weight"))
    return stored(m.join(kinds.select("feature", F.col("sets").cast("double").alias("sets"), "weight").hint("merge"), "feature").select("set_id", "feature", "sets", "weight"), "alike")


def _candidates(m: DataFrame, threshold: float, limit: int) -> DataFrame:
    exact = F.lit(1e-9)  # a product that is whole must not be rounded up
    ranked = row_ranks(m, ["set_id"], "sets", "feature", to="place", size="size", weight="weight")
    prefix = ranked.filter(F.col("place") <= F.col("size") - F.ceil(F.lit(threshold) * F.col("size") - exact) + 1).select("feature", "set_id", "size", "place")
    na, nb = F.col("a.size"), F.col("b.size")
    needed = F.lit(threshold / (1 + threshold)) * (na + nb) - exact
    left = 1 + F.least(na - F.col("a.place"), nb - F.col("b.place"))  # common features from here on, at most
    # what both share before this feature would have met them earlier: the first meeting has all that is left
    met = meeting(prefix, limit).filter(F.least(na, nb) >= F.lit(threshold) * F.greatest(na, nb) - exact)
    first = met.groupBy(F.col("a.set_id").alias("a"), F.col("b.set_id").alias("b"), na.alias("na"), nb.alias("nb")).agg(F.max(left - needed).alias("room"))
    return first.filter("room >= 0").drop("room")


def _of_candidates(m: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    own = pairs.join(m.select(F.col("set_id").alias("a"), "feature", "weight").hint("merge"), "a")
    shared = own.join(m.select(F.col("set_id").alias("b"), "feature").hint("merge"), ["b", "feature"], "left_semi").groupBy("a", "b", "na", "nb").agg(F.sum("weight").alias("shared"))
    jaccard = F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))
    return shared.select("a", "b", jaccard.alias("jaccard")).filter(F.col("jaccard") >= threshold)


def jaccard_pairs(membership: DataFrame, limit: int = MEETING) -> DataFrame:
    """a < b and their Jaccard similarity, for the pairs that share a feature."""
    m = membership.select("set_id", "feature").distinct()
    sizes = m.groupBy("set_id").agg(F.count("*").alias("size"))
    shared = meeting(m, limit).groupBy(F.col("a.set_id").alias("a"), F.col("b.set_id").alias("b")).agg(F.count("*").alias("shared"))
    sized = shared.join(sizes.select(F.col("set_id").alias("a"), F.col("size").alias("na")), "a").join(sizes.select(F.col("set_id").alias("b"), F.col("size").alias("nb")), "b")
    return sized.select("a", "b", (F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))).alias("jaccard"))


def combined_similarity(jaccard: DataFrame, correlation: DataFrame, by: list[str] = ()) -> DataFrame:
    """The larger of Jaccard similarity and absolute correlation; what either lacks counts as 0.

    With `by`, correlations are of many points, each of which has all pairs, and Jaccard similarities are the same at all of them."""
    r = F.coalesce(F.when(F.isnan("r"), 0.0).otherwise(F.col("r")), F.lit(0.0))
    both = correlation.select(*by, "a", "b", "r").join(jaccard, ["a", "b"], "left" if by else "full")
    return both.select(*by, "a", "b", F.greatest(F.coalesce("jaccard", F.lit(0.0)), F.abs(r)).alias("s"))


def average_linkage(distance: np.ndarray) -> list[tuple[int, int, float]]:
    """Merges (i, j, height) of average-linkage clustering by chains of nearest neighbours; i < j name cluster slots."""
    d = distance.astype(np.float64).copy()
    n = len(d)
    np.fill_diagonal(d, np.inf)
    sizes, alive, merges, chain = np.ones(n), np.ones(n, bool), [], []
    for _ in range(n - 1):
        if not chain:
            chain = [int(np.flatnonzero(alive)[0])]
        while True:
            i = chain[-1]
            j = int(d[i].argmin())
            if len(chain) > 1 and d[i, chain[-2]] <= d[i, j]:
                j = chain[-2]
                break
            chain.append(j)
        chain = chain[:-2]
        i, j = min(i, j), max(i, j)
        merges.append((i, j, float(d[i, j])))
        joint = (sizes[i] * d[i] + sizes[j] * d[j]) / (sizes[i] + sizes[j])
        d[i], d[:, i] = joint, joint
        d[i, i] = np.inf
        d[j], d[:, j] = np.inf, np.inf
        sizes[i] += sizes[j]
        alive[j] = False
    return merges


def cut(n: int, merges: list[tuple[int, int, float]], height: float) -> list[int]:
    """Cluster of each item (its least member) when every merge up to `height` is made."""
    of = list(range(n))

    def find(x: int) -> int:
        while of[x] != x:
            x = of[x]
        return x

    for i, j, h in merges:
        if h <= height:
            a, b = find(i), find(j)
            of[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def clusters(sets: DataFrame, similarity: DataFrame, thresholds: tuple[float, ...], by: list[str] = ()) -> DataFrame:
    """by, set_id, threshold, cluster (its least set id): one dendrogram, cut at distance 1 - threshold, bounds included.

    Average linkage needs all distances together; up to MOST_SETS sets they fit one task, and more are refused."""
    n = sets.groupBy(*by).agg(F.count_distinct("set_id").alias("n")).agg(F.max("n")).first()[0] or 0
    if n > MOST_SETS:
        raise ValueError(f"{n} sets: average linkage is made in one task and takes {MOST_SETS} at most")

    def run(key, ids: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
        names = sorted(ids["set_id"])
        place = {s: i for i, s in enumerate(names)}
        distance = np.ones((len(names), len(names)))
        a, b = edges["a"].map(place), edges["b"].map(place)
        known = a.notna() & b.notna()
        a, b, s = a[known].astype(int).to_numpy(), b[known].astype(int).to_numpy(), edges["s"][known].to_numpy()
        distance[a, b] = distance[b, a] = np.maximum(0.0, 1 - s)
        merges = average_linkage(distance) if len(names) > 1 else []
        parts = [pd.DataFrame({"set_id": names, "threshold": t, "cluster": [names[c] for c in cut(len(names), merges, 1 - t)]}) for t in thresholds]
        return pd.concat(parts).assign(**{c: ids[c].iloc[0] for c in by})

    all_ = F.lit(1).alias("__all")
    ids = sets.select(all_, *by, "set_id").distinct().groupBy("__all", *by)
    edges = similarity.select(all_, *by, "a", "b", "s").groupBy("__all", *by)
    kind = sets.schema["set_id"].dataType.simpleString()
    keys = "".join(f"{c} {sets.schema[c].dataType.simpleString()}, " for c in by)
    return ids.cogroup(edges).applyInPandas(run, f"{keys}set_id {kind}, threshold double, cluster {kind}")


def representatives(members: DataFrame, iqrs: DataFrame, by: list[str] = ()) -> DataFrame:
    """Of each cluster the set of the largest interquartile range; of equal ones the first by `ord`, then by id."""
    first = F.min(F.struct(-F.col("iqr"), "ord", "set_id"))
    best = first["set_id"]
    return members.join(iqrs, [*by, "set_id"]).groupBy(*by, "threshold", "cluster").agg(best.alias("set_id"), F.count("*").alias("members"))
