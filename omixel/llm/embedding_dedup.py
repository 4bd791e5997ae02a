"""Embedding near-dedup by Euclidean p-stable hashing.

Vectors are normalised; a hash floor((a . x + b) / WIDTH) with normal a and uniform b is equal for close vectors more often
than for others.  `m` such hashes make a key, one key a table, in `tables` tables.  m grows with the logarithm of
the number of vectors, so that an unrelated vector has company under a key in about COMPANY of the cases, and tables follow
from m so that a pair at the threshold is missed with a probability of at most MISS.  Vectors of one label that share a key are
compared exactly, in double precision, by matrix products, bucket by bucket; a pair that shares several keys counts under
the least of them.

Scale: a vector gives one row (key, node) a table, and what has no company under a key goes no further.  Buckets are
sized before the shuffle; a bucket of more than `block_vectors` is cut into blocks, every two of which meet in one
task.  A task counts the links of each vector and keeps one edge a vector to the least it is connected with, never all pairs.
Equal vectors of one label are one node with a count, so copies are not compared with each other.  Rows compared grow
with the vectors: no component of the candidates is ever formed, only one of the links.

Defined results: a vector that is null, empty, zero, or holds null, NaN or infinite components, and any vector of null label, links
with nothing and is its own component; vectors of unequal length are not compared; a null vec_id is carried along; rows that
share a vec_id are vectors of their own; other columns, whatever their names, play no part.  Nodes are 64-bit digests of
label and components.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import buckets, cluster
from .components import components
from .textarrays import mix

THRESHOLD, WIDTH, MISS, COMPANY, SEED = 0.98, 1.0, 5e-4, 0.05, 20240229
_NODES = "vec_id long, node long, label long, vector binary"


def collision(distance: float, width: float = WIDTH) -> float:
    """Probability that one p-stable hash of two vectors is equal."""
    r = width / distance
    normal = 0.5 * math.erfc(r / math.sqrt(2))
    return 1 - 2 * normal - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def table_plan(n: int, threshold: float = THRESHOLD) -> tuple[int, int]:
    """(hashes per key, tables) for n vectors."""
    near, far = collision(math.sqrt(2 - 2 * threshold)), collision(math.sqrt(2) * 0.9)
    m = max(4, math.ceil(math.log(max(n, 2) / COMPANY) / -math.log(far)))
    return m, math.ceil(math.log(MISS) / math.log(1 - near**m))


def _valid(column: pa.Array, labels: list) -> list[np.ndarray | None]:
    out = []
    for v, label in zip(column.to_pylist(), labels, strict=True):
        if v and label is not None and None not in v:
            a = np.array(v, np.float64)
            largest = np.abs(a).max()
            out.append(a if np.isfinite(largest) and largest > 0 else None)
        else:
            out.append(None)
    return out


def _identify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The node of each vector: a number of its label and its exact components."""
    for batch in batches:
        labels = batch.column("label").to_pylist()
        vectors = [None if v is None else v.tobytes() for v in _valid(batch.column("embedding"), labels)]
        nodes = [None if v is None else int.from_bytes(hashlib.blake2b(v, digest_size=8, key=str(x).encode()[:64]).digest(), "little", signed=True) for v, x in zip(vectors, labels, strict=True)]
        yield pa.record_batch([batch.column("vec_id"), pa.array(nodes, pa.int64()), batch.column("label"), pa.array(vectors, pa.binary())], names=["vec_id", "node", "label", "vector"])


def _unit(blobs: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(blobs), np.float64).reshape(len(blobs), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _hash(m: int, tables: int):
    """The vectors with their keys, one a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        projections: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            rows: dict[int, list[int]] = {}
            blobs = batch.column("vector").to_pylist()
            for i, b in enumerate(blobs):
                rows.setdefault(len(b) // 8, []).append(i)
            labels = np.array(batch.column("label").to_pylist(), np.int64)
            keys = np.zeros((len(blobs), tables), np.uint64)
            for dimension, at in rows.items():
                if dimension not in projections:
                    rng = np.random.default_rng([SEED, dimension])
                    projections[dimension] = rng.standard_normal((dimension, m * tables)), rng.uniform(0, WIDTH, m * tables)
                a, b = projections[dimension]
                for i in range(0, len(at), 1024):
                    some = at[i : i + 1024]
                    hashed = np.floor((_unit([blobs[j] for j in some]) @ a + b) / WIDTH).astype(np.int64).view(np.uint64).reshape(len(some), tables, m)
                    key = np.tile(mix(np.arange(1, tables + 1, dtype=np.uint64)), (len(some), 1)) + mix(labels[some].view(np.uint64) + np.uint64(dimension << 40))[:, None]
                    for j in range(m):
                        key = mix(key + hashed[:, :, j])
                    keys[some] = key
            yield pa.record_batch([*batch.columns, pa.array([k.tobytes() for k in keys], pa.binary())], names=[*batch.schema.names, "keys"])

    return run


def _key_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = [np.frombuffer(k, "<i8") for k in batch.column("keys").to_pylist()]
        nodes = np.repeat(np.array(batch.column("node").to_pylist(), np.int64), [len(k) for k in keys])
        yield pa.record_batch([pa.array(np.concatenate([np.zeros(0, np.int64), *keys])), pa.array(nodes)], names=["key", "node"])


def _compare(threshold: float, pairs_at_once: int = 1 << 14):
    """Some buckets, or two blocks of one (or one block): links of each node, and edges that connect what they connect."""

    def compare(table: pa.Table) -> pa.Table:
        nodes, first, own = np.unique(np.array(table["node"].to_pylist(), np.int64), return_index=True, return_inverse=True)
        data = table.select(["label", "copies", "vector", "keys"]).take(pa.array(first))
        blobs, labels, copies = data["vector"].to_pylist(), np.array(data["label"].to_pylist()), np.array(data["copies"].to_pylist(), np.int64)
        keys = np.array([np.frombuffer(k, "<i8") for k in data["keys"].to_pylist()])
        kinds: dict[tuple, list[int]] = {}
        for i, (b, x) in enumerate(zip(blobs, labels.tolist(), strict=True)):
            kinds.setdefault((len(b), x), []).append(i)
        kind, place, units = np.zeros(len(nodes), int), np.zeros(len(nodes), int), []
        for at in kinds.values():
            kind[at], place[at] = len(units), np.arange(len(at))
            units.append(_unit([blobs[i] for i in at]))
        del blobs, data
        low, high, key, block = (table[c].to_numpy() for c in ("low", "high", "key", "block"))
        counts, edges = np.zeros(len(nodes), np.int64), []

        def link(i: np.ndarray, j: np.ndarray, k: int) -> None:
            for at in range(0, len(i), pairs_at_once):
                a, b = i[at : at + pairs_at_once], j[at : at + pairs_at_once]
                shared = np.where(keys[a] == keys[b], keys[a], np.iinfo(np.int64).max).min(1) == k  # counted under the least shared key
                a, b = a[shared], b[shared]
                np.add.at(counts, a, copies[b])
                np.add.at(counts, b, copies[a])
                edges.append((a, b))

        for rows in buckets.members(key):
            alike = kind[own[rows]]
            for x in np.unique(alike):
                some, unit = rows[alike == x], units[x]
                left = own[some[block[some] == low[some]]]
                right = left if low[some[0]] == high[some[0]] else own[some[block[some] == high[some]]]
                if not len(left) or not len(right):
                    continue
                other = unit[place[right]]
                for i in range(0, len(left), 512):
                    part = left[i : i + 512]
                    r, c = np.nonzero(unit[place[part]] @ other.T >= threshold)
                    if left is right:
                        r, c = r[c > r + i], c[c > r + i]
                    link(part[r], right[c], int(key[some[0]]))
            if len(edges) > 1000:
                edges = [_starred(len(nodes), edges)]
        a, b = _starred(len(nodes), edges)
        some = np.flatnonzero(counts)
        return pa.table(
            {
                "a": pa.array(nodes[np.concatenate([a, some])], pa.int64()),
                "b": pa.array([*nodes[b].tolist(), *[None] * len(some)], pa.int64()),
                "links": pa.array([*[None] * len(a), *counts[some].tolist()], pa.int64()),
            }
        )

    return compare


def _starred(n: int, edges: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    none = np.zeros(0, np.int64)
    root = buckets.roots(n, np.concatenate([none, *(a for a, _ in edges)]), np.concatenate([none, *(b for _, b in edges)]))
    a = np.flatnonzero(root != np.arange(n))
    return a, root[a]


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, block_vectors: int = 2000) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    given = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("long").alias("label"))
    rows = cluster.written(given.mapInArrow(_identify, _NODES), "embedding-rows", lasting=True)
    with cluster.temporary(vectors.sparkSession):
        by_node = cluster.written(_linked(rows, threshold, block_vectors), "embedding-links", lasting=True)
    out = rows.select("vec_id", "node").join(by_node, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def _linked(rows: DataFrame, threshold: float, block_vectors: int) -> DataFrame:
    """node, n_links, component_id."""
    nodes = rows.filter("node is not null").groupBy("node", "label").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"), F.first("vector").alias("vector"))
    nodes = cluster.written(nodes, "embedding-nodes")
    m, tables = table_plan(nodes.count(), threshold)
    keyed = cluster.written(nodes.select("node", "label", "copies", "vector").mapInArrow(_hash(m, tables), "node long, label long, copies long, vector binary, keys binary"), "embedding-keys")
    company = cluster.written(buckets.kept_buckets(keyed.select("node", "keys").mapInArrow(_key_rows, "key long, node long")), "embedding-buckets")
    tasks = buckets.dealt(company.withColumn("size", F.lit(1)), block_vectors, within=True)
    found = tasks.join(keyed, "node").groupBy("bin", "low", "high").applyInArrow(_compare(threshold), "a long, b long, links long")
    found = cluster.written(found, "embedding-found")
    links = found.filter("links is not null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    connected = components(found.filter("b is not null").select("a", "b")).withColumnRenamed("id", "node")
    root = F.coalesce("component", "node").alias("root")
    member = nodes.select("node", "copies", "least").join(connected, "node", "left").join(links, "node", "left").select("node", "copies", "least", "links", root)
    smallest = member.groupBy("root").agg(F.min("least").alias("component_id"))
    return member.join(smallest, "root").select("node", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
