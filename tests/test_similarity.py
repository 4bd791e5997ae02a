"""Set similarity join against all pairs, and how many rows it joins."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from omixel.operators import similarity


@pytest.fixture(scope="module")
def sets(spark):
    """Random sets, near copies, copies, sets of one feature, features that all or most sets have, repeated rows."""
    rng = random.Random(3)
    out = {f"r{i:03d}": set(rng.sample(range(10, 500), rng.randrange(1, 30))) | {0} for i in range(120)}
    for i in range(60):
        base = sorted(out[f"r{i:03d}"])
        out[f"s{i:03d}"] = set(base) - set(rng.sample(base, min(len(base) - 1, rng.randrange(3)))) | {1000 + i}
        out[f"t{i:03d}"] = set(base)
    out |= {"one": {7}, "two": {7}, "three": {8}}
    rows = [(s, f) for s, fs in out.items() for f in fs]
    return spark.createDataFrame(rows + rows[:50], "set_id string, feature int").repartition(4), out


def _plain(out, threshold):
    names = sorted(out)
    pairs = {(a, b): len(out[a] & out[b]) / len(out[a] | out[b]) for i, a in enumerate(names) for b in names[i + 1 :]}
    return {k: v for k, v in pairs.items() if v >= threshold and v > 0}


@pytest.mark.parametrize("limit", [1000, 7])
def test_all_pairs(sets, limit):
    df, out = sets
    got = {(r.a, r.b): r.jaccard for r in similarity.jaccard_pairs(df, limit).collect()}
    assert got == _plain(out, 0)


@pytest.mark.parametrize("threshold", [0.05, 0.5, 0.7, 0.8, 1.0])
@pytest.mark.parametrize("limit", [1000, 7])
def test_similar_pairs(sets, threshold, limit):
    df, out = sets
    got = {(r.a, r.b): r.jaccard for r in similarity.similar_pairs(df, threshold, limit).collect()}
    assert got == _plain(out, threshold) and got


def test_rows_joined(sets):
    """One feature is in nearly all sets, so a plain join meets all pairs there; in order of rarity few pairs meet at all."""
    df, out = sets
    m = df.distinct()
    everything = similarity.meeting(m).count()
    assert everything == sum(len(out[a] & out[b]) for i, a in enumerate(sorted(out)) for b in sorted(out)[i + 1 :])
    candidates = similarity.candidate_pairs(df, 0.7).count()
    assert len(_plain(out, 0.7)) <= candidates < everything / 20


def test_a_hot_feature_is_many_keys(spark):
    """A feature of 300 sets meets in blocks: each pair once, no key with more than a few blocks' rows."""
    hot = spark.createDataFrame([(i, 1) for i in range(300)], "set_id int, feature int")
    assert similarity.meeting(hot, 20).select("a.set_id", "b.set_id").distinct().count() == similarity.meeting(hot, 20).count() == 300 * 299 // 2


@pytest.mark.parametrize("threshold", [0, -1, 1.5])
def test_threshold(sets, threshold):
    with pytest.raises(ValueError):
        similarity.similar_pairs(sets[0], threshold)


def test_features_of_the_same_sets_are_one(spark):
    """Features that are in the same sets are joined once, with their number as weight; sizes, places and similarities are those of all of them."""
    out = {f"s{i:02d}": {f for f in range(3000) if f % 30 >= i} for i in range(30)}
    df = spark.createDataFrame([(s, f) for s, fs in out.items() for f in fs], "set_id string, feature int").repartition(4)
    m = similarity.alike(df)
    assert m.count() == sum(range(31)) and m.select("feature", "weight").distinct().count() == 30 and {r.weight for r in m.collect()} == {100}
    assert {(r.a, r.b): r.jaccard for r in similarity.similar_pairs(df, 0.7).collect()} == _plain(out, 0.7)


def test_no_table_of_members_is_broadcast(spark):
    """Members compress well on disk, so that their size there is below the bound for broadcasts; they are merged all the same."""
    df = spark.range(2000).select((F.col("id") % 40).alias("set_id"), F.col("id").alias("feature"))
    plan = similarity.similar_pairs(df, 0.7)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("strategy=merge") >= 2
