"""MinHash near-dedup with DartMinHash signatures.

A document is the set of its runs of SHINGLE words (all its words, if fewer), each with a weight: 1 + ln(how often it
occurs), so 1 in most texts.  Similarity is weighted Jaccard, sum of the lesser weights over sum of the greater.  Every element has
a field of hashed darts, a Poisson process over (weight, rank), generated cell by cell: unit steps of weight,
growing steps of rank.  A document keeps the darts that lie under its elements' weights and below a rank that
lets about k (ln k + 2) of them through, whatever its size; each dart falls on one of K coordinates, and
the earliest dart per coordinate makes the signature.  Where a coordinate stays empty, the rank limit doubles.
Two signatures agree at a coordinate with a probability of the weighted Jaccard similarity.

BANDS bands of ROWS coordinates give candidates (at similarity 0.8, all but 5e-8 of the pairs).  Documents of equal
weighted sets are one node.  Within the bucket of a band value, sketches (16 bits a coordinate) are compared first: a
node stays if it agrees with another one in LIKELY of the coordinates (a pair at 0.8 fails with probability 1e-8).  What is left
of a bucket is compared by exact similarity on the texts, and the components of what reaches the threshold are the classes.

Scale: a node gives one row (key, node) a band; a band value shared by a third of all nodes is counted before the
shuffle.  Buckets are compared one by one (module buckets): no component of candidates is formed, and a text goes only to the
buckets in which a sketch resembles its own.  A bucket beyond `block_elements` is cut into blocks and every two blocks meet
in a task of their own.  Within a task, pairs of texts are not enumerated: leaders are
compared with everything, and the triangle inequality of Jaccard distance leaves few other comparisons; no
link between two classes is lost.

Defined results: a null text, or one without words, is a class of its own; a null doc_id is carried along (a class has the
least doc_id that is not null, if any); repeated rows are members of their class like any other; other columns, whatever
their names, play no part and are carried along by deduplicated.  Nodes are told apart by 64-bit digests of their weighted sets.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import buckets, cluster
from .components import components
from .textarrays import Words, mix, tidy, window_hashes

SHINGLE, K, BANDS, ROWS, THRESHOLD, LIKELY = 5, 128, 32, 4, 0.8, 0.6
_RANK_EDGES = [0.0, 1 / 64, 1 / 16, 1 / 4, *(float(1 << i) for i in range(12))]
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct shingle hashes of all texts, sorted within each text; where each text's begin and end; their weights)."""
    words = Words(texts)
    hashes, n = words.hashes(), words.n_words
    count = np.where(n == 0, 0, np.maximum(n - SHINGLE + 1, 1))
    doc = np.repeat(np.arange(len(n)), count)
    starts = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count) + words.first[:-1][doc]
    values = window_hashes(hashes, starts, np.minimum(starts + SHINGLE, words.first[1:][doc])) if len(doc) else np.zeros(0, np.uint64)
    order = np.argsort(values, kind="stable")
    order = order[np.argsort(doc[order], kind="stable")]
    values, doc = values[order], doc[order]
    del order
    fresh = np.ones(len(values), bool)
    fresh[1:] = (values[1:] != values[:-1]) | (doc[1:] != doc[:-1])
    times = np.diff(np.append(np.flatnonzero(fresh), len(values)))
    values, doc = values[fresh], doc[fresh]
    return values, np.searchsorted(doc, np.arange(len(n) + 1)), 1 + np.log(times)


@functools.lru_cache(maxsize=None)
def _poisson_steps(mean: float) -> np.ndarray:
    """Cumulative Poisson probabilities."""
    n = np.arange(int(mean + 12 * np.sqrt(mean) + 24))
    logs = np.concatenate([[0.0], np.cumsum(np.log(n[1:]))])
    return np.cumsum(np.exp(n * np.log(mean) - mean - logs))


def _uniform(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(11)).astype(np.float64) * 2.0**-53


def signatures(elements: np.ndarray, edges: np.ndarray, weights: np.ndarray | None = None, k: int = K) -> np.ndarray:
    """One row of k dart numbers for each non-empty set elements[edges[i]:edges[i + 1]] with weights (1 if None)."""
    sizes = np.diff(edges)
    weights = np.ones(len(elements)) if weights is None else np.asarray(weights, np.float64)
    out = np.zeros((len(sizes), k), np.uint64)
    todo, darts = np.flatnonzero(sizes), k * (np.log(k) + 2)
    while len(todo):
        at = np.concatenate([np.arange(edges[i], edges[i + 1]) for i in todo])
        doc = np.repeat(np.arange(len(todo)), sizes[todo])
        limit = darts / np.bincount(doc, weights[at], len(todo))
        keys, ranks, numbers = _thrown(elements[at], weights[at], doc, limit, k)
        order = np.argsort((keys.astype(np.uint64) << np.uint64(40)) | (ranks * 2.0**40).astype(np.uint64), kind="stable")
        keys, numbers = keys[order], numbers[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        sign = np.zeros(len(todo) * k, np.uint64)
        sign[keys[first]] = numbers[first] | np.uint64(1)
        sign = sign.reshape(len(todo), k)
        out[todo] = sign
        todo = todo[(sign == 0).any(1)]
        darts *= 2
    return out


def _thrown(elements: np.ndarray, weights: np.ndarray, doc: np.ndarray, limit: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document * k + coordinate, rank / limit, number) of every dart under the weights and below the limits."""
    found = []
    limits = limit[doc]
    step = 0
    while True:
        low = _RANK_EDGES[step] if step < len(_RANK_EDGES) else _RANK_EDGES[-1] * 2.0 ** (step - len(_RANK_EDGES) + 1)
        high = _RANK_EDGES[step + 1] if step + 1 < len(_RANK_EDGES) else 2 * max(low, 1.0)
        rows = np.flatnonzero(limits > low)
        if not len(rows):
            break
        unit = 0
        while len(rows):
            seed = np.uint64((step * 0xA0761D6478BD642F + unit * 0xE7037ED1A0B428DB + 1) * int(_GOLDEN) % (1 << 64))
            h = mix(elements[rows] ^ seed)
            count = np.searchsorted(_poisson_steps(high - low), _uniform(h), side="right")
            total = int(count.sum())
            nth = np.arange(total) - np.repeat(np.cumsum(count) - count, count)
            row = np.repeat(rows, count)
            g = mix(np.repeat(h, count) + (nth.astype(np.uint64) + np.uint64(1)) * _GOLDEN)
            rank = low + (high - low) * _uniform(g)
            other = mix(g ^ _GOLDEN)
            weight = unit + _uniform(other)
            kept = (rank < limits[row]) & (weight < weights[row])
            row, rank, g, other = row[kept], rank[kept], g[kept], other[kept]
            found.append((doc[row] * k + (mix(other) % np.uint64(k)).astype(np.int64), rank / limits[row], g))
            unit += 1
            rows = rows[weights[rows] > unit]
        step += 1
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def band_values(signature: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    out = np.tile(mix(np.arange(1, bands + 1, dtype=np.uint64)), (len(signature), 1))
    parts = signature[:, : bands * rows].reshape(len(signature), bands, rows)
    for r in range(rows):
        out = mix(out * _GOLDEN + parts[:, :, r])
    return out


def _set_ids(values: np.ndarray, edges: np.ndarray, weights: np.ndarray) -> list[int | None]:
    flat, heavy = values.astype("<u8").tobytes(), weights.astype("<f4").tobytes()

    def digest(a: int, b: int) -> int:
        return int.from_bytes(hashlib.blake2b(flat[8 * a : 8 * b] + heavy[4 * a : 4 * b], digest_size=8).digest(), "little", signed=True)

    return [digest(a, b) if b > a else None for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]


_SIGNED = "doc_id long, text_hash long, set_id long, n_elements long, bands binary, sketch binary"


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            part = batch.slice(i, 256)
            values, edges, weights = shingle_sets(part.column("text"))
            signs = signatures(values, edges, weights)
            bands, sketches = band_values(signs).astype("<u8"), (mix(signs) >> np.uint64(48)).astype("<u2")
            ids = _set_ids(values, edges, weights)
            blobs = [pa.array([x.tobytes() if s is not None else None for x, s in zip(xs, ids, strict=True)], pa.binary()) for xs in (bands, sketches)]
            yield pa.record_batch([part.column("doc_id"), part.column("text_hash"), pa.array(ids, pa.int64()), pa.array(np.diff(edges), pa.int64()), *blobs], names=["doc_id", "text_hash", "set_id", "n_elements", "bands", "sketch"])
    tidy()


def _key_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = np.frombuffer(b"".join(batch.column("bands").to_pylist()), "<i8")
        yield pa.record_batch([pa.array(keys), pa.array(np.repeat(np.array(batch.column("node").to_pylist(), np.int64), BANDS))], names=["key", "node"])


def _likely(threshold: float):
    """Some buckets, or two blocks of one: its nodes that resemble another one, by sketch, in groups that are connected by that."""

    def run(table: pa.Table) -> pa.Table:
        sketches = np.frombuffer(b"".join(table["sketch"].to_pylist()), "<u2").reshape(table.num_rows, K)
        key, node, sizes = (table[c].to_numpy() for c in ("key", "node", "n_elements"))
        groups, found = [], []
        for rows in buckets.members(key):
            a, b = [], []
            step = max(1, (1 << 22) // (len(rows) * K))
            for i in range(0, len(rows), step):
                same = (sketches[rows[i : i + step], None, :] == sketches[None, rows, :]).mean(2) >= threshold
                r, c = np.nonzero(same)
                above = c > r + i
                root = buckets.roots(len(rows), r[above] + i, c[above])  # one edge a node is enough
                joined = np.flatnonzero(root != np.arange(len(rows)))
                a.append(joined)
                b.append(root[joined])
            root = buckets.roots(len(rows), np.concatenate(a), np.concatenate(b))
            often = np.bincount(root, minlength=len(rows))[root] > 1
            least = np.full(len(rows), np.iinfo(np.int64).max)
            np.minimum.at(least, root, node[rows])
            groups.append((mix(mix(key[rows[often]].view(np.uint64)) + least[root[often]].view(np.uint64))).view(np.int64))
            found.append(rows[often])
        at = np.concatenate([np.zeros(0, np.int64), *found])
        return pa.table({"key": pa.array(np.concatenate([np.zeros(0, np.int64), *groups])), "node": pa.array(node[at]), "size": pa.array(sizes[at])})

    return run


class _Forest:
    def __init__(self, n: int):
        self.parent, self.edges = list(range(n)), []

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = x = self.parent[self.parent[x]]
        return x

    def join(self, a: int, b: int) -> None:
        x, y = self.find(a), self.find(b)
        if x != y:
            self.parent[x] = y
            self.edges.append((a, b))


def linked(sets: list[np.ndarray], threshold: float = THRESHOLD, weights: list[np.ndarray] | None = None) -> list[tuple[int, int]]:
    """Pairs with weighted Jaccard >= threshold (weights 1 if None) that connect whatever such pairs connect, without trying all of them.

    A leader, the unassigned set of the commonest elements, is compared with all sets; those within reach join its
    cluster.  Distance 1 - J is a metric: a set x can reach a member of leader a's cluster only if
    d(a, x) <= radius + 1 - threshold; only those x, while not yet connected, are compared with the members."""
    n = len(sets)
    numbers, flat = np.unique(np.concatenate(sets), return_inverse=True)
    heavy = np.ones(len(flat)) if weights is None else np.concatenate(weights)
    lengths = np.array([len(s) for s in sets])
    edges = np.concatenate([[0], np.cumsum(lengths)])
    sizes = np.add.reduceat(heavy, edges[:-1])
    commonness = np.add.reduceat(np.bincount(flat)[flat].astype(float), edges[:-1]) / lengths
    held, forest = np.zeros(len(numbers)), _Forest(n)

    def likeness(i: int, among: np.ndarray | None = None) -> np.ndarray:
        own = slice(edges[i], edges[i + 1])
        held[flat[own]] = heavy[own]
        if among is None:
            common = np.add.reduceat(np.minimum(held[flat], heavy), edges[:-1])
            total = sizes
        else:
            common = np.array([np.minimum(held[flat[edges[j] : edges[j + 1]]], heavy[edges[j] : edges[j + 1]]).sum() for j in among.tolist()])
            total = sizes[among]
        held[flat[own]] = 0
        return common / (sizes[i] + total - common)

    reach = 1 - threshold + 1e-9
    free, open_pairs = np.ones(n, bool), []
    for i in np.argsort(-commonness, kind="stable").tolist():
        if not free[i]:
            continue
        near = likeness(i)
        members = np.flatnonzero(near >= threshold)
        for j in members.tolist():
            forest.join(i, j)
        own = members[free[members]]
        free[own] = False
        radius = 1 - near[members].min()
        outside = np.flatnonzero((near < threshold) & (1 - near <= radius + reach))
        if len(outside) and len(members) > 1:
            open_pairs.append((members, outside))
    for members, outside in open_pairs:
        for x in outside.tolist():
            root = forest.find(x)
            apart = members[[forest.find(m) != root for m in members.tolist()]]
            if len(apart):
                for m, s in zip(apart.tolist(), likeness(x, apart).tolist(), strict=True):
                    if s >= threshold:
                        forest.join(x, m)
    return forest.edges


def _verify(table: pa.Table) -> pa.Table:
    """Some buckets, or two blocks of one: the links that connect their nodes."""
    nodes, first, own = np.unique(table["node"].to_numpy(), return_index=True, return_inverse=True)
    values, edges, weights = shingle_sets(table["text"].take(pa.array(first)))
    pairs = []
    for rows in buckets.members(table["key"].to_numpy()):
        at = np.unique(own[rows])
        if len(at) > 1:
            parts = [slice(edges[i], edges[i + 1]) for i in at.tolist()]
            pairs += [(at[a], at[b]) for a, b in linked([values[p] for p in parts], weights=[weights[p] for p in parts])]
    del values, weights
    tidy()
    a, b = (np.array([p[i] for p in pairs], np.int64) for i in (0, 1))
    return pa.table({"a": pa.array(nodes[a], pa.int64()), "b": pa.array(nodes[b], pa.int64())})


def signed(docs: DataFrame) -> DataFrame:
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"), F.col("text").cast("string").alias("text"))
    return cluster.written(keyed.mapInArrow(_sign, _SIGNED), "minhash-signed", lasting=True)


def _links(docs: DataFrame, sign: DataFrame, block_elements: int, block_nodes: int) -> DataFrame:
    """set_id, component: of every set that is linked to another one."""
    eldest = F.min_by(F.struct("doc_id", "text_hash"), _age()).alias("rep")
    nodes = sign.filter("set_id is not null").groupBy(F.col("set_id").alias("node")).agg(eldest, *[F.first(c).alias(c) for c in ("n_elements", "bands", "sketch")])
    nodes = cluster.written(nodes, "minhash-nodes")
    candidates = cluster.written(buckets.kept_buckets(nodes.select("node", "bands").mapInArrow(_key_rows, "key long, node long")), "minhash-buckets")
    tasks = buckets.dealt(candidates.withColumn("size", F.lit(1)), block_nodes, within=False).join(nodes.select("node", "n_elements", "sketch"), "node")
    likely = tasks.groupBy("bin", "low", "high").applyInArrow(_likely(LIKELY), "key long, node long, size long")
    likely = cluster.written(buckets.kept_buckets(likely), "minhash-likely")

    # a node's text is that of one document, found by id and hash together: null or repeated ids are no hot key, and repeated rows give it once
    wanted = nodes.join(likely.select("node").distinct(), "node").select("node", F.col("rep.doc_id").alias("rep_id"), F.col("rep.text_hash").alias("rep_hash"))
    texts = docs.select(F.col("doc_id").cast("long").alias("rep_id"), F.xxhash64(F.col("text").cast("string")).alias("rep_hash"), F.col("text").cast("string").alias("text"))
    same = texts["rep_id"].eqNullSafe(wanted["rep_id"]) & (texts["rep_hash"] == wanted["rep_hash"])
    fetched = wanted.hint("merge").join(texts, same).groupBy("node").agg(F.first("text").alias("text"))
    fetched = buckets.dealt(likely, block_elements, within=False).join(cluster.written(fetched, "minhash-texts"), "node")
    return cluster.written(components(fetched.groupBy("bin", "low", "high").applyInArrow(_verify, "a long, b long")).withColumnRenamed("id", "set_id"), "minhash-links", lasting=True)


def _age() -> Column:
    return F.struct(cluster.id_order(F.col("doc_id")).alias("id"), F.col("text_hash").alias("hash"))


def classes(docs: DataFrame, block_elements: int = 500_000, block_nodes: int = 2000) -> DataFrame:
    """One row per document: doc_id, text_hash, class_id (the least doc_id of its class), kept.

    kept is true for the document that gives its class the id; of several texts of that doc_id, for the one of the least hash."""
    sign, age = signed(docs), _age()
    with cluster.temporary(docs.sparkSession):
        links = _links(docs, sign, block_elements, block_nodes)
    joined = sign.select("doc_id", "text_hash", "set_id").join(links, "set_id", "left").withColumn("node", F.coalesce("component", "set_id"))
    least = joined.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"), F.min(age).alias("first"))
    least = cluster.written(least, "minhash-classes")  # with a plain table on either side Spark can split a hot class
    out = joined.join(least, "node", "left").withColumn("class_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("least")))
    return out.select("doc_id", "text_hash", "class_id", F.coalesce(age == F.col("first"), F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """The documents without near copies: of each class the one of the least doc_id stays, once."""
    kept = classes(docs, **options).filter("kept").select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash")).distinct()
    keyed = docs.select(cluster.as_row(docs), F.col("doc_id").cast("long").alias("own_id"), F.xxhash64(F.col("text").cast("string")).alias("own_hash"))
    found = keyed.join(kept, F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_hash") == F.col("hash")), "left_semi")
    return found.dropDuplicates(["own_id", "own_hash"]).select(*cluster.of_row(docs))
