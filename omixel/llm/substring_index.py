"""Substring dedup with a log-structured index of window fingerprints.

Documents arrive in batches of ascending doc_id.  The index is a set of immutable runs; a run holds, for
each bucket of the hash space, the sorted distinct fingerprints of all windows of one or more earlier batches.
A batch is cut into chunks of consecutive ids.  Each chunk sends its sorted distinct window fingerprints to
the buckets, a bucket merges them with its part of every run, and answers each chunk with one bit per
fingerprint: seen before, or not.  What no run holds becomes the batch's own run, of level 0; `fan_in` runs of one level
are merged into one of the next, so that a fingerprint is rewritten once a level, which is log(batches) to the base `fan_in` times.  A window is a window of `size` words.  Its fingerprint is a 64-bit hash, by which runs are sorted and
merged, and a 16-bit check that verifies it: a hash of the same words that is made of their bytes independently of the first.
Windows count as equal, within a chunk, across chunks and in runs, only if both agree; those that agree in the hash alone
stand side by side.

Hot windows cost nothing extra: a chunk sends each fingerprint once, however often it holds it.  A bucket gets
a bounded number of them from a batch, since the number of buckets follows the batch.  A run's bucket is stored in PARTS
sorted parts; a batch's bucket is held in memory, and the parts of the runs stream past it, so history may grow beyond any
task's memory.  Compaction takes one part of one bucket at a time.  No window is ever a row.

Results are defined for every input: a null or blank text has no words and keeps the empty text; a null
doc_id counts as after all others; rows that share a doc_id are ordered by their text, and the later of
them counts as later; other columns, whatever their names, are ignored; of an empty table nothing comes.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cluster
from .textarrays import Words, pack, split_sorted, tidy, unpack, window_hashes

_RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"
_MESSAGE = "chunk long, bucket int, hashes binary, checks binary"
_MERGED = "chunk long, bucket int, part int, hashes binary, checks binary"
_MERGED_ARROW = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("part", pa.int32()), ("hashes", pa.binary()), ("checks", pa.binary())])
PARTS = 64


def ordered(table: pa.Table) -> pa.Table:
    """The rows of a chunk in the order that decides which copy is the earlier one."""
    table = table.select(["doc_id", "text"])
    return table.sort_by([("doc_id", "ascending"), ("text", "ascending")])


def chunk_windows(table: pa.Table, size: int) -> tuple[Words, np.ndarray, np.ndarray]:
    words = Words(table["text"])
    at, hashed = words.windows(size, words.hashes())
    tidy()
    return words, at, hashed


def _checks(words: Words, at: np.ndarray, size: int) -> np.ndarray:
    """16 bits of the second hash of the windows."""
    return (window_hashes(words.checks(), at, at + size) >> np.uint64(48)).astype("<u2")


def distinct(hashed: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, checks, first place, number of each given one) of the distinct fingerprints, sorted."""
    order = np.lexsort((checks, hashed))
    h, c = hashed[order], checks[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
    number = np.empty(len(h), np.int64)
    number[order] = np.cumsum(fresh) - 1
    return h[fresh], c[fresh], order[fresh], number


def _send(size: int, n_buckets: int):
    def send(table: pa.Table) -> pa.Table:
        chunk = table["chunk"][0].as_py()
        words, at, hashed = chunk_windows(ordered(table), size)
        unique, checks, _, _ = distinct(hashed, _checks(words, at, size))
        parts = split_sorted(unique, n_buckets)
        return pa.table(
            {
                "chunk": pa.array([chunk] * len(parts), pa.int64()),
                "bucket": pa.array([b for b, _, _ in parts], pa.int32()),
                "hashes": pa.array([pack(unique[i:j]) for _, i, j in parts], pa.binary()),
                "checks": pa.array([checks[i:j].tobytes() for _, i, j in parts], pa.binary()),
            }
        )

    return send


class _Bucket:
    """A batch's part of one bucket, and what of it is in the runs."""

    def __init__(self, rows: list[dict]):
        self.rows = sorted(rows, key=lambda r: r["chunk"])
        self.values = [unpack(r["hashes"]) for r in self.rows]
        checks = np.concatenate([np.frombuffer(r["checks"], "<u2") for r in self.rows])
        self.hashes, self.checks, self.first, self.number = distinct(np.concatenate(self.values), checks)
        self.known = np.zeros(len(self.hashes), bool)

    def meet(self, run: dict) -> None:
        """Mark what a part of a run holds."""
        hashes, checks = unpack(run["hashes"]), np.frombuffer(run["checks"], "<u2")
        at = np.searchsorted(self.hashes, hashes)
        while len(at):  # once, but for fingerprints that agree in the hash alone
            inside = at < len(self.hashes)
            at, hashes, checks = at[inside], hashes[inside], checks[inside]
            alike = self.hashes[at] == hashes
            at, hashes, checks = at[alike], hashes[alike], checks[alike]
            same = self.checks[at] == checks
            self.known[at[same]] = True
            at, hashes, checks = at[~same] + 1, hashes[~same], checks[~same]

    def answers(self, keep_run: bool, n_buckets: int) -> pa.RecordBatch:
        """One bit for each fingerprint of each chunk, and the parts of the new run."""
        seen = np.ones(len(self.number), bool)
        seen[self.first] = False
        seen |= self.known[self.number]
        bucket, rows, at = self.rows[0]["bucket"], [], 0
        for r, v in zip(self.rows, self.values, strict=True):
            bits = seen[at : at + len(v)]
            if bits.any():
                rows.append((r["chunk"], bucket, None, np.packbits(bits).tobytes(), b""))
            at += len(v)
        if keep_run:
            hashes, checks = self.hashes[~self.known], self.checks[~self.known]
            rows += [(-1 - bucket, bucket, p, pack(hashes[i:j]), checks[i:j].tobytes()) for p, i, j in _parts(hashes, bucket, n_buckets)]
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, _MERGED_ARROW.types, strict=True)], schema=_MERGED_ARROW)


def _parts(hashes: np.ndarray, bucket: int, n_buckets: int) -> list[tuple[int, int, int]]:
    """(part, from, to): equal ranges of the bucket's hashes."""
    finer = split_sorted(hashes, n_buckets * PARTS)
    return [(b - bucket * PARTS, i, j) for b, i, j in finer]


def _merge(keep_run: bool, n_buckets: int):
    """Rows sorted by bucket, in each the batch's chunks first (chunk >= 0) and then the runs (chunk null)."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        bucket: _Bucket | None = None
        for batch in batches:
            for r in batch.to_pylist():
                if rows and r["bucket"] != rows[0]["bucket"]:
                    yield (bucket or _Bucket(rows)).answers(keep_run, n_buckets)
                    rows, bucket = [], None
                if r["chunk"] is not None:
                    rows.append(r)
                elif rows:  # a bucket that the batch does not touch needs no answer
                    bucket = bucket or _Bucket(rows)
                    bucket.meet(r)
        if rows:
            yield (bucket or _Bucket(rows)).answers(keep_run, n_buckets)
        tidy()

    return merge


def _resolve(size: int, n_buckets: int):
    """One chunk: its documents and the answers of the buckets, or one bucket's part of the new run."""

    def resolve(docs: pa.Table, answers: pa.Table) -> pa.Table:
        fields = {"doc_id": [], "n_words": [], "n_removed": [], "kept_sha256": [], "bucket": [], "part": [], "hashes": [], "checks": []}
        if docs.num_rows:
            docs = ordered(docs)
            words, at, hashed = chunk_windows(docs, size)
            unique, _, first, inverse = distinct(hashed, _checks(words, at, size))
            seen = np.zeros(len(unique), bool)
            spans = {b: (i, j) for b, i, j in split_sorted(unique, n_buckets)}
            for r in answers.to_pylist():
                i, j = spans[r["bucket"]]
                seen[i:j] = np.unpackbits(np.frombuffer(r["hashes"], np.uint8), count=j - i).astype(bool)
            again = seen[inverse] | (first[inverse] != np.arange(len(at)))
            removed = words.covered(at[again], size)
            n = docs.num_rows
            fields |= {
                "doc_id": docs["doc_id"].to_pylist(),
                "n_words": words.n_words.tolist(),
                "n_removed": words.per_doc(removed).tolist(),
                "kept_sha256": [hashlib.sha256(x).hexdigest() for x in words.joined(~removed)],
                "bucket": [None] * n,
                "part": [None] * n,
                "hashes": [None] * n,
                "checks": [None] * n,
            }
        else:
            runs = answers.to_pylist()
            fields |= {k: [r[k] for r in runs] for k in ("bucket", "part", "hashes", "checks")}
            fields |= {k: [None] * len(runs) for k in ("doc_id", "n_words", "n_removed", "kept_sha256")}
        kinds = [pa.int64()] * 3 + [pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
        return pa.table({"run": pa.array([docs.num_rows == 0] * len(fields["doc_id"]), pa.bool_())} | {k: pa.array(v, t) for (k, v), t in zip(fields.items(), kinds, strict=True)})

    return resolve


def _compact(table: pa.Table) -> pa.Table:
    """One part of one bucket: several runs become one."""
    rows = table.to_pylist()
    merged = np.concatenate([unpack(r["hashes"]) for r in rows])
    checks = np.concatenate([np.frombuffer(r["checks"], "<u2") for r in rows])
    order = np.lexsort((checks, merged))
    return pa.table([[rows[0]["bucket"]], [rows[0]["part"]], [pack(merged[order])], [checks[order].tobytes()]], pa.schema([_MERGED_ARROW.field(i) for i in (1, 2, 3, 4)]))


class SubstringIndex:
    """Runs of window hashes below `path`; `dedup` takes batches whose ids rise from one to the next."""

    def __init__(self, spark: SparkSession, path: str | None = None, size: int = 20, n_buckets: int = 64, fan_in: int = 3, chunk_bytes: int = 2 << 20):
        self.spark, self.size, self.n_buckets, self.fan_in, self.chunk_bytes = spark, size, n_buckets, fan_in, chunk_bytes
        self.path = path or cluster.scratch(spark, "substring-index")
        self.runs: list[tuple[int, str]] = []  # level, folder
        self._made = 0

    _RUN = "bucket int, part int, hashes binary, checks binary"

    def _history(self) -> DataFrame:
        if not self.runs:
            return self.spark.createDataFrame([], self._RUN)
        return self._read(self.runs)

    def _read(self, runs: list[tuple[int, str]]) -> DataFrame:
        return self.spark.read.schema(self._RUN).parquet(*[path for _, path in runs])

    def dedup(self, docs: DataFrame, keep_run: bool = True, total_bytes: int | None = None) -> DataFrame:
        """One row per document: doc_id, n_words, n_removed, kept_sha256.  Adds the batch to the index if keep_run."""
        total = cluster.text_bytes(docs) if total_bytes is None else total_bytes
        out = f"{self.path}/batch-{self._made:06d}"
        self._made += 1
        with cluster.temporary(self.spark), cluster.shuffles_end_with_query(self.spark):
            chunks = cluster.with_chunk(docs, self.chunk_bytes, total)
            sent = chunks.groupBy("chunk").applyInArrow(_send(self.size, self.n_buckets), _MESSAGE)
            both = sent.unionByName(self._history().drop("part"), allowMissingColumns=True)
            ordered_ = both.repartition("bucket").sortWithinPartitions("bucket", F.col("chunk").asc_nulls_last())
            merged = ordered_.mapInArrow(_merge(keep_run, self.n_buckets), _MERGED)
            both = chunks.groupBy("chunk").cogroup(merged.groupBy("chunk")).applyInArrow(_resolve(self.size, self.n_buckets), "run boolean, " + _RESULT + ", " + self._RUN)
            both.write.partitionBy("run").parquet(out)
        if keep_run and self._has(f"{out}/run=true"):
            self.runs.append((0, f"{out}/run=true"))
            if self._full() is not None:
                self.compact()
        return self.spark.read.schema(_RESULT).parquet(f"{out}/run=false") if self._has(f"{out}/run=false") else self.spark.createDataFrame([], _RESULT)

    def _has(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def _full(self) -> int | None:
        """The lowest level with `fan_in` runs."""
        times = Counter(level for level, _ in self.runs)
        return min((level for level, n in times.items() if n >= self.fan_in), default=None)

    def compact(self) -> None:
        """Merge the runs of each full level into one of the next, then drop the merged ones."""
        while (level := self._full()) is not None:
            merged = [r for r in self.runs if r[0] == level]
            path = f"{self.path}/compacted-{self._made:06d}-{level + 1}"
            with cluster.shuffles_end_with_query(self.spark):
                self._read(merged).groupBy("bucket", "part").applyInArrow(_compact, self._RUN).write.parquet(path)
            self.runs = [*(r for r in self.runs if r[0] != level), (level + 1, path)]
            for _, old in merged:
                cluster.remove(self.spark, old)

    def drop_runs(self) -> None:
        for _, path in self.runs:
            cluster.remove(self.spark, path)
        self.runs = []


def batches_of(docs: DataFrame, n: int) -> list[tuple[int, int]]:
    """(least id, bytes of text) of at most n batches of ascending ids; the first takes all smaller ids too.

    A batch has about 1/n of rows and bytes, halved and added, so neither many rows nor long texts make it more than about twice as large, but for a range more.  Sizes of 16 ranges
    a batch are gathered; an id is never cut, so one that holds more than a batch is a larger one."""
    key = cluster.id_order(F.col("doc_id"))
    fine = cluster.id_bounds(docs, 16 * n)
    sized = docs.groupBy(cluster.range_of(key, fine).alias("range")).agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("bytes"), F.count("*").alias("rows"))
    sizes = {r["range"]: (r["bytes"], r["rows"]) for r in sized.collect()}
    n_bytes, n_rows = (max(1, sum(x[i] for x in sizes.values())) for i in (0, 1))
    out, before = [], 0.0
    for i, low in enumerate(fine):
        more, rows = sizes.get(i, (0, 0))
        if not out or (len(out) < n and before >= len(out) / n):
            out.append([low, 0])
        out[-1][1] += more
        before += (more / n_bytes + rows / n_rows) / 2
    return [tuple(x) for x in out]


def dedup_documents(docs: DataFrame, size: int = 20, batch_bytes: int = 64 << 30, least_batches: int = 4) -> DataFrame:
    """Dedup a whole table: batches of ascending ids, four where there are ids enough, through one index, which is dropped at the end.

    The batches before the last leave runs, `fan_in` of which are compacted, as they are where batches arrive over time."""
    spark = docs.sparkSession
    total = cluster.text_bytes(docs)
    batches = batches_of(docs, max(least_batches, math.ceil(total / batch_bytes)))
    index = SubstringIndex(spark, size=size, n_buckets=max(8, math.ceil(max(n for _, n in batches) / (6 << 20))))
    key, out = cluster.id_order(F.col("doc_id")), None
    for i, (low, n_bytes) in enumerate(batches):
        last = i + 1 == len(batches)
        batch = docs if i == 0 else docs.filter(key >= low)
        batch = batch if last else batch.filter(key < batches[i + 1][0])
        part = index.dedup(batch, keep_run=not last, total_bytes=n_bytes)
        out = part if out is None else out.unionByName(part)
    index.drop_runs()
    return out
