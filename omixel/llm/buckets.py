"""What shares a key is compared, bucket by bucket.

A bucket is the set of nodes that have one key.  Buckets of one node are no candidates.  Of buckets that hold the very same
nodes (a group of near copies shares many keys) the one of the least key is kept: whatever two nodes share, the least key
that they share is kept.  `dealt` gathers small buckets in bins, and cuts a large one into blocks, every two of which meet in a
task of their own; so a task holds a bounded number of rows, and no bucket is dropped or capped.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def kept_buckets(rows: DataFrame) -> DataFrame:
    """(key, node) rows -> those of the buckets that are compared.  Sizes and a 128-bit sum of each bucket's nodes are
    gathered before the shuffle, so a key that a third of all nodes has is one row a task."""
    of = lambda salt: F.bit_xor(F.xxhash64("node", F.lit(salt)))
    sizes = rows.groupBy("key").agg(F.count("*").alias("n"), of(0).alias("s"), of(1).alias("t")).filter("n > 1")
    least = sizes.groupBy("n", "s", "t").agg(F.min("key").alias("key")).select("key")
    return rows.join(least, "key", "left_semi")


def dealt(rows: DataFrame, limit: int, within: bool) -> DataFrame:
    """(key, node, size) -> (bin, low, high, key, node, block): group by (bin, low, high).

    A bin has sizes of about `limit` in all.  A bucket above that is cut into blocks by a hash of the node; within: whether
    a block also gets a task of its own (low = high), besides those with each other block."""
    total = rows.agg(F.sum("size")).first()[0] or 0
    bins = max(1, math.ceil(total / limit))
    blocks = rows.groupBy("key").agg(F.ceil(F.sum("size") / limit).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("node"), F.col("blocks").cast("long")).cast("int")
    others = F.sequence(F.lit(0), F.col("blocks") - 1)
    if not within:
        others = F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.filter(others, lambda x: x != F.col("block")))
    split = rows.join(blocks, "key").withColumn("block", block).withColumn("other", F.explode(others))
    bin_ = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("key"), F.lit(bins).cast("long"))).otherwise(F.col("key"))
    return split.select(bin_.alias("bin"), F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "key", "node", "block")


def members(keys: np.ndarray) -> list[np.ndarray]:
    """Row numbers of each bucket."""
    order = np.argsort(keys, kind="stable")
    ends = np.flatnonzero(np.append(keys[order][1:] != keys[order][:-1], True)) + 1 if len(keys) else []
    return np.split(order, ends[:-1]) if len(keys) else []


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least of 0 .. n - 1 that each of them is connected with by pairs (a, b)."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        np.minimum.at(new, label[a], least)
        np.minimum.at(new, label[b], least)
        new = new[new]
        if (new == label).all():
            return label
        label = new
