"""Products of wide tables by blocks: items x places, cut into blocks of items and slices of places.

A long table (item, place, value) becomes dense blocks of at most `block` items and `slice_` places, missing values as NaN; a block
is one row.  Every two blocks of one slice meet in a task, which multiplies them; what a pair of blocks gives is summed over
the slices.  So a cell is sent once for each block of items, not once for each item, and a task holds a few blocks."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK, SLICE = 256, 4096


def _parts(rows: DataFrame, by: list[str], item: str, place: str, block: int, slice_: int) -> tuple[int, int]:
    """How many blocks and slices the largest group needs, from estimated counts."""
    counts = rows.groupBy(*by).agg(F.approx_count_distinct(item).alias("items"), F.approx_count_distinct(place).alias("places"))
    row = counts.agg(F.max("items"), F.max("places")).first()
    return max(1, math.ceil((row[0] or 0) / block)), max(1, math.ceil((row[1] or 0) / slice_))


def packed(rows: DataFrame, by: list[str], item: str, place: str, value: str, n_blocks: int, n_slices: int) -> DataFrame:
    """(by, block, slice, ids, places, data), dealt by hashes; data: little-endian doubles of items x places, NaN where there is no value.

    Rows without a value are as good as absent; of repeated (item, place) rows the largest value counts."""
    part = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    here = rows.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    cells = here.select(*by, part(item, n_blocks).alias("block"), part(place, n_slices).alias("slice"), F.col(item).alias("item"), F.col(place).alias("place"), F.col(value).cast("double").alias("value"))

    def run(f: pd.DataFrame) -> pd.DataFrame:
        (i, ids), (j, places) = pd.factorize(f["item"], sort=True), pd.factorize(f["place"], sort=True)
        data = np.full((len(ids), len(places)), -np.inf)
        np.maximum.at(data, (i, j), f["value"].to_numpy())
        data[np.isneginf(data)] = np.nan
        return pd.DataFrame([[f["block"].iloc[0], f["slice"].iloc[0], list(ids), list(places), data.tobytes()]], columns=["block", "slice", "ids", "places", "data"]).assign(**{c: f[c].iloc[0] for c in by})

    kinds = [rows.schema[c].dataType.simpleString() for c in (item, place)]
    keys = "".join(f"{c} {rows.schema[c].dataType.simpleString()}, " for c in by)
    return cells.groupBy(*by, "block", "slice").applyInPandas(run, f"{keys}block int, slice int, ids array<{kinds[0]}>, places array<{kinds[1]}>, data binary")


def _dense(row: pd.Series) -> np.ndarray:
    return np.frombuffer(row["data"], "<f8").reshape(len(row["ids"]), -1)


def paired(blocks: DataFrame, n_blocks: int, by: list[str], make: Callable[[np.ndarray, np.ndarray], list[np.ndarray]], finish: Callable[[list, list, bool, np.ndarray], pd.DataFrame], schema: str) -> DataFrame:
    """For every two blocks (and each with itself): `make` of both at their common places, summed over slices, then `finish`(ids, ids, one block?, sums) as rows."""
    other = F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))
    meeting = blocks.withColumn("other", other).withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
    keys = "".join(f"{c} {blocks.schema[c].dataType.simpleString()}, " for c in by)
    ids = blocks.schema["ids"].dataType.simpleString()

    def multiply(f: pd.DataFrame) -> pd.DataFrame:
        low, high = int(f["low"].iloc[0]), int(f["high"].iloc[0])
        sides = [f[f["block"] == b] for b in (low, high)]
        if not len(sides[0]) or not len(sides[1]):  # a block that has no value in this slice
            return pd.DataFrame(columns=[*by, "low", "high", "left", "right", "sums"])
        a, b = (s.iloc[0] for s in sides)
        _, i, j = np.intersect1d(np.array(a["places"]), np.array(b["places"]), assume_unique=True, return_indices=True)
        sums = np.stack(make(_dense(a)[:, i], _dense(b)[:, j]))
        return pd.DataFrame([[low, high, a["ids"], b["ids"], sums.tobytes()]], columns=["low", "high", "left", "right", "sums"]).assign(**{c: f[c].iloc[0] for c in by})

    def add(f: pd.DataFrame) -> pd.DataFrame:
        # a block's items may differ between slices: sums are put where its items are
        left, right = (sorted({i for ids in f[c] for i in ids}) for c in ("left", "right"))
        at = [{i: k for k, i in enumerate(names)} for names in (left, right)]
        total = None
        for _, row in f.iterrows():
            sums = np.frombuffer(row["sums"], "<f8").reshape(-1, len(row["left"]), len(row["right"]))
            total = np.zeros((len(sums), len(left), len(right))) if total is None else total
            total[:, np.array([at[0][i] for i in row["left"]])[:, None], np.array([at[1][i] for i in row["right"]])[None]] += sums
        return finish(left, right, f["low"].iloc[0] == f["high"].iloc[0], total).assign(**{c: f[c].iloc[0] for c in by})

    products = meeting.groupBy(*by, "low", "high", "slice").applyInPandas(multiply, f"{keys}low int, high int, left {ids}, right {ids}, sums binary")
    return products.groupBy(*by, "low", "high").applyInPandas(add, keys + schema)


def _moments(x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """Of what both have: how many, sums, sums of squares, sums of products."""
    mx, my = ~np.isnan(x), ~np.isnan(y)
    x, y = np.where(mx, x, 0.0), np.where(my, y, 0.0)
    mx, my = mx.astype(float), my.astype(float)
    return [mx @ my.T, x @ my.T, mx @ y.T, (x * x) @ my.T, mx @ (y * y).T, x @ y.T]


def correlations(rows: DataFrame, item: str, place: str, value: str, by: list[str] = (), block: int = BLOCK, slice_: int = SLICE) -> DataFrame:
    """by, a < b, r, n: Pearson's correlation of every two items over the n places at which both have a value; pairs without a common place are absent.

    Values are taken as differences from their item's mean, so that sums of squares keep their digits.  r is null with one common place, or
    where one item does not vary over the common places (by less than 1e-12 of its mean square)."""
    by = list(by)
    n_blocks, n_slices = _parts(rows, by, item, place, block, slice_)
    centred = rows.withColumn("__value", F.col(value) - F.avg(value).over(Window.partitionBy(*by, item)))
    blocks = packed(centred, by, item, place, "__value", n_blocks, n_slices)
    kind = rows.schema[item].dataType.simpleString()

    def finish(left: list, right: list, same: bool, sums: np.ndarray) -> pd.DataFrame:
        n, sx, sy, sxx, syy, sxy = sums
        with np.errstate(all="ignore"):
            vx, vy = sxx - sx * sx / n, syy - sy * sy / n
            r = (sxy - sx * sy / n) / np.sqrt(vx * vy)
        r[(n < 2) | (vx <= 1e-12 * sxx) | (vy <= 1e-12 * syy)] = np.nan
        i, j = np.nonzero(n > 0)
        if same:
            i, j = i[i < j], j[i < j]
        a, b = np.array(left, object)[i], np.array(right, object)[j]
        r, swap = np.clip(r[i, j], -1.0, 1.0), a > b
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        return pd.DataFrame({"a": a, "b": b, "r": r, "n": n[i, j].astype("int64")})

    out = paired(blocks, n_blocks, by, _moments, finish, f"a {kind}, b {kind}, r double, n bigint")
    return out.withColumn("r", F.when(~F.isnan("r"), F.col("r")))


def products(rows: DataFrame, item: str, place: str, value: str, block: int = BLOCK, slice_: int = SLICE) -> DataFrame:
    """a <= b, product: the sum of products of every two items' values over all places; a missing value counts as 0."""
    n_blocks, n_slices = _parts(rows, [], item, place, block, slice_)
    packed_ = packed(rows, [], item, place, value, n_blocks, n_slices)
    kind = rows.schema[item].dataType.simpleString()

    def finish(left: list, right: list, same: bool, sums: np.ndarray) -> pd.DataFrame:
        a, b = (g.ravel() for g in np.meshgrid(np.array(left, object), np.array(right, object), indexing="ij"))
        swap = a > b
        a, b, v = np.where(swap, b, a), np.where(swap, a, b), sums[0].ravel()
        keep = ~swap if same else np.ones(len(a), bool)
        return pd.DataFrame({"a": a[keep], "b": b[keep], "product": v[keep]})

    zero = lambda m: np.where(np.isnan(m), 0.0, m)
    return paired(packed_, n_blocks, [], lambda x, y: [zero(x) @ zero(y).T], finish, f"a {kind}, b {kind}, product double")
