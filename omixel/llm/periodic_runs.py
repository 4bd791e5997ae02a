"""Runs: stretches of a text's words that repeat with a period, found in linear time by Lyndon arrays.

A run is a maximal stretch with smallest period q; here those of length >= max(least, exponent * q).  Words are numbered in the order in
which a batch has them, which is as good an ordered alphabet as any.  In a run, at each place
where the least rotation of its period begins, that rotation is the longest Lyndon word from there on, for the order of the
alphabet or for its reverse; so the pairs (place, next smaller suffix) of both orders hold all runs.

`lyndon` computes these pairs from left to right.  Whether one suffix is smaller than another is decided by how far both
agree, and no word is matched twice: the pair whose agreement reaches farthest is kept, and a later pair
within its reach takes its agreement from the copy of itself that lies one distance to the left (or, if it has none there, from the fact
that it agrees up to the reach); scanning only ever goes on from the reach.  Two neighbours in the chain of smaller suffixes, whose
agreements with a third differ, agree as far as the smaller of both.  No suffix structure and no hash of a stretch is used.
A run found is extended to the left from the first of its Lyndon words, less than a period.

Before that, stretches that can hold no run are put aside: of a run of period q every word past the first q has an equal one at most q
before it, so there are at least max(least - q, (exponent - 1) * q) such words in succession.  Distances to the word before are computed for
a batch at once; only what is left goes through `lyndon`.

A map without a shuffle; memory is some 100 bytes for each word of a batch or of the longest text.

Defined results: a null text has no words, an empty one neither: no runs, an empty rest; rows of one id are judged each
by itself; columns of docs stay as they are, and a new column of a name that docs has gets an underscore more; an empty
table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from . import cluster
from .textarrays import tidy

LEAST, EXPONENT = 24, 3
_BLOCK = 1 << 22  # bytes of text at once
_RUN = StructType([StructField(c, LongType()) for c in ("start", "length", "period")])
ADDED = ("__words", "__runs", "__rest")


def lyndon(x: list[int]) -> tuple[list[int], list[int]]:
    """For each place the next one with a smaller suffix (the length of x if there is none), and how far both suffixes agree."""
    n = len(x)
    after, agree = [n] * n, [0] * n
    before, agree_before = [-1] * n, [0] * n  # the last place with a smaller suffix, and how far both agree
    low = high = reach = 0  # x[low : low + reach - high] == x[high : reach]
    for r in range(1, n):
        left, m, child = r - 1, 0, -1
        while left >= 0:
            if child >= 0 and agree_before[child] != m:
                if agree_before[child] < m:
                    m = agree_before[child]
            else:
                scan = True
                if r + m < reach:
                    if left >= high:
                        a, b = left - high + low, r - high + low
                        known = agree[a] if after[a] == b else agree_before[b] if before[b] == a else n
                        if r + known < reach:
                            m, scan = known, False
                        else:
                            m = reach - r
                    else:
                        m = reach - r
                if scan:
                    while r + m < n and x[left + m] == x[r + m]:
                        m += 1
                    if r + m > reach:
                        low, high, reach = left, r, r + m
            if r + m < n and x[left + m] < x[r + m]:
                before[r], agree_before[r] = left, m
                break
            after[left], agree[left] = r, m
            child, left = left, before[left]
    return after, agree


def runs_of(x: list[int], least: int = LEAST, exponent: int = EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of length >= max(least, exponent * period), in order."""
    n, found = len(x), set()
    for sign in (1, -1):
        after, agree = (np.array(a, np.int64) for a in lyndon([sign * c for c in x]))
        at = np.arange(n)
        period = after - at
        good = (after < n) & (agree > (exponent - 2) * period)
        back = at - period
        good[good] &= ~((back[good] >= 0) & (after[back[good]] == at[good]) & (agree[back[good]] == agree[good] + period[good]))  # not the run's first Lyndon word
        for i in np.flatnonzero(good).tolist():
            q, start = int(period[i]), i
            while start > 0 and x[start - 1] == x[start - 1 + q]:
                start -= 1
            length = i + q + int(agree[i]) - start
            if length >= max(least, exponent * q):
                found.add((start, length, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def stretches(codes: np.ndarray, first: np.ndarray, least: int = LEAST, exponent: int = EXPONENT) -> list[tuple[int, int]]:
    """(from, to) of what can hold runs, of texts whose words begin at `first` (its last item is the end)."""
    n = len(codes)
    if not n:
        return []
    order = np.argsort(codes, kind="stable")
    gap = np.full(n, n + 1, np.int64)
    same = codes[order[1:]] == codes[order[:-1]]
    gap[order[1:][same]] = np.diff(order)[same]
    starts = np.repeat(first[:-1], np.diff(first))
    place = np.arange(n) - starts
    gap[gap > place] = n + 1
    steps = np.zeros(n + 1, np.int64)
    most, longest = 1, int(np.diff(first).max())
    while True:  # periods in (most / 2, most]
        need = max(least - most, (exponent - 1) * (most // 2 + 1), 1)
        if need > longest:
            break
        edges = np.diff(np.concatenate([[False], gap <= most, [False]]).astype(np.int8))
        a, b = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        long = b - a >= need
        a, b = a[long], b[long]
        np.add.at(steps, np.maximum(a - most, starts[a]) if len(a) else a, 1)
        np.add.at(steps, b, -1)
        most *= 2
    edges = np.diff(np.concatenate([[False], np.cumsum(steps[:-1]) > 0, [False]]).astype(np.int8))
    a, b = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    out = []
    for i, j in zip(a.tolist(), b.tolist(), strict=True):  # texts that touch
        cuts = first[np.searchsorted(first, i, side="right") : np.searchsorted(first, j)].tolist()
        out += zip([i, *cuts], [*cuts, j], strict=True)
    return out


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, and where each text's begin; the last item is the end."""
    parts = pc.ascii_split_whitespace(texts.cast(pa.large_string()).fill_null(""))
    flat = parts.flatten()
    there = pc.greater(pc.binary_length(flat), 0)
    counts = np.concatenate([[0], np.cumsum(there.to_numpy(zero_copy_only=False))])
    offsets = parts.offsets.to_numpy()
    return flat.filter(there), counts[offsets - offsets[0]]


def _judged(texts: pa.Array, rewrite: Callable | None, ids: list, least: int, exponent: int) -> list[pa.Array]:
    words, first = words_of(texts)
    sizes = np.diff(first)
    if rewrite is not None:
        source = np.arange(len(words))
        for d, (doc_id, n) in enumerate(zip(ids, sizes.tolist(), strict=True)):
            if (tail := rewrite(doc_id, n)) is not None:
                start, period = tail
                source[first[d] + start : first[d + 1]] = first[d] + start + np.arange(n - start) % period
        words = words.take(pa.array(source))
    codes = words.dictionary_encode().indices.to_numpy(zero_copy_only=False) if len(words) else np.zeros(0, np.int32)
    found: list[list[dict]] = [[] for _ in sizes]
    dropped = np.zeros(len(codes) + 1, np.int64)
    for i, j in stretches(codes, first, least, exponent):
        d = int(np.searchsorted(first, i, side="right")) - 1
        for start, length, period in runs_of(codes[i:j].tolist(), least, exponent):
            found[d].append({"start": i + start - int(first[d]), "length": length, "period": period})
            dropped[i + start + period] += 1
            dropped[i + start + length] -= 1
    kept = np.cumsum(dropped[:-1]) == 0
    ends = np.concatenate([[0], np.cumsum(kept)])[first]
    rest = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), words.filter(pa.array(kept))), pa.scalar(" ", pa.large_string()))
    kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
    return [pa.array(sizes, pa.int64()), pa.array(found, kind), rest.cast(pa.string())]


def judged(docs: DataFrame, least: int = LEAST, exponent: int = EXPONENT, rewrite: Callable[[int | None, int], tuple[int, int] | None] | None = None) -> DataFrame:
    """docs with __words (their number), __runs (array of start, length, period; by start, then period) and __rest: the words that are in no run
    past its first period, joined by single spaces.

    rewrite(doc_id, number of words), if given, returns (a, p) for texts that are to be taken with their words from a on repeated with period p."""
    place, id_place = docs.columns.index("text"), docs.columns.index("doc_id")
    added = [cluster.free_name(docs.columns, c) for c in ADDED]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.cumsum(pc.binary_length(batch.column(place)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)) // _BLOCK
            cuts = [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), batch.num_rows]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                if i < j:
                    part = batch.slice(i, j - i)
                    new = _judged(part.column(place), rewrite, part.column(id_place).to_pylist(), least, exponent)
                    yield pa.RecordBatch.from_arrays([*part.columns, *new], names=[*batch.schema.names, *added])
        tidy()

    if docs.schema["text"].dataType != StringType():
        docs = docs.withColumn("text", F.col("text").cast("string"))
    kinds = (LongType(), ArrayType(_RUN), StringType())
    return docs.mapInArrow(run, StructType([*docs.schema.fields, *[StructField(c, k) for c, k in zip(added, kinds, strict=True)]]))


def without_runs(docs: DataFrame, **options) -> DataFrame:
    """docs with each run cut down to its first period; texts without a run stay as they are."""
    runs, rest = (F.col(cluster.free_name(docs.columns, c)) for c in ADDED[1:])
    text = F.when(F.size(runs) > 0, rest).otherwise(F.col("text")).alias("text")
    return judged(docs, **options).select(*[text if c == "text" else F.col(f"`{c}`") for c in docs.columns])


def repeated_tail(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """Where one text in ten begins to repeat, and with which period: by a hash of its id."""
    g, rest = divmod(zlib.crc32(str(doc_id).encode()), 10)
    if rest or not n or doc_id is None:
        return None
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def strongest(runs: Column) -> Column:
    """Of an array of runs the one of the greatest length / period, exactly; of equals the first, then that of the shortest period."""
    worse = lambda a, b: b["length"] * a["period"] > a["length"] * b["period"]
    none = F.lit(None).cast(_RUN)
    return F.aggregate(runs, none, lambda best, r: F.when(best.isNull() | worse(best, r), r).otherwise(best))


def listed(runs: Column) -> Column:
    return F.array_join(F.transform(runs, lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
