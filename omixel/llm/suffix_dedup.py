"""Sparse suffix arrays: long passages that repeat across a corpus.

Of all suffixes only those are retained that begin at a minimiser: of any `length` consecutive words, the
position whose `k`-word prefix hashes lowest (leftmost of ties).  Equal passages retain equal positions,
so two documents that share a passage of `length` words share a retained suffix prefix.

1. Candidates.  Each chunk of consecutive ids sends the hashes of its retained suffixes' prefixes to the buckets of the
   hash space; prefixes of two chunks or more go back, and the hashes of the windows of `length` words
   around them are sent and answered the same way.  A suffix without a repeated hash has no match and is not sorted.
2. Sorting.  The other suffixes are sorted by their words (Spark's sort, within the partition of their leading words) and each is
   compared, word by word, with its neighbour: the common prefix is how far a match reaches to the right.  The words before
   them, read backwards, are sorted and compared likewise: how far it reaches to the left.
3. Extension.  A window that begins `a` words before its suffix is the same in two documents if they match `length - a` words to the right and
   `a` words to the left.  The sorted orders give that for all suffixes at once: runs of neighbours that match so far.  The earliest
   window of each run stays.  Overlapping windows join to maximal passages.

The sorted suffixes are read as a stream.  One that equals the one before it, on both sides, is answered at once and let go; what is new is held
until its leading words change.  Where more than `held` suffixes of the same leading words are new, and where leading words are in
`hot_chunks` chunks or more (these are split over several tasks by chunk, so that each task passes on one suffix of equal ones), the windows
that are left are passed on one by one, sorted by all their words, and each is compared with the one before it.  Both ways compare the same words.

A word goes if one of its windows of `length` words also begins earlier: in a document of smaller id, or
earlier in the same document.  That is decided on words, not on hashes.  A chunk first sorts its own suffixes and sends on
what is new in it, once, so a passage in a third of all documents is one row a chunk; nothing is emitted in pairs.

Defined results: a null or blank text has no words and is left as it is; a null doc_id counts as after all
others; rows that share a doc_id are ordered by text; texts shorter than `length` words never change; any
other columns, whatever their names, are carried along unchanged.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from . import cluster
from .textarrays import Words, mix, pack, split_sorted, tidy, unpack, window_hashes

_MESSAGE = "chunk long, bucket int, hashes binary"
_ARROW = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("hashes", pa.binary())])
_POSITION_BITS = 28
_SUFFIX = "prefix long, suffix binary, before binary, chunk long, anchor int, windows long, settled boolean, hot boolean"
_PASSED = "chunk long, anchor int, repeated long, words binary"
_PASSED_ARROW = pa.schema([("chunk", pa.int64()), ("anchor", pa.int32()), ("repeated", pa.int64()), ("words", pa.binary())])
_FOUND = "chunk long, anchor int, repeated long"
#: new suffixes of the same leading words that a task holds
HELD = 8192
#: leading words of so many chunks are split over tasks
HOT_CHUNKS = 2048


def retained(words: Words, hashes: np.ndarray, at: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For the window at each word of `at` the word its retained suffix begins at; prefix hash of every word."""
    n = len(hashes)
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    prefix = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    prefix[: n - k + 1] = window_hashes(hashes, np.arange(n - k + 1), np.arange(k, n + 1))
    low = np.uint64((1 << max(_POSITION_BITS, n.bit_length())) - 1)
    keyed = (mix(prefix) & ~low) | np.arange(n, dtype=np.uint64)
    width, have = length - k + 1, 1
    while have < width:  # minima over ever longer runs of positions
        step = min(have, width - have)
        keyed[: n - step] = np.minimum(keyed[: n - step], keyed[step:])
        have += step
    return (keyed[at] & low).astype(np.int64), prefix


def ordered(docs: pa.Table) -> pa.Table:
    return docs.sort_by([("doc_id", "ascending"), ("text", "ascending")])


class _Chunk:
    def __init__(self, docs: pa.Table, length: int, k: int):
        self.words = Words(ordered(docs)["text"])
        hashes = self.words.hashes()
        self.at, self.windows = self.words.windows(length, hashes)
        self.anchor, self.prefix = retained(self.words, hashes, self.at, length, k)
        tidy()


def _messages(chunk: int, unique: np.ndarray, n_buckets: int) -> pa.Table:
    parts = split_sorted(unique, n_buckets)
    return pa.table([[chunk] * len(parts), [b for b, _, _ in parts], [pack(unique[i:j]) for _, i, j in parts]], schema=_ARROW)


def _send_prefixes(length: int, k: int, n_buckets: int):
    def send(table: pa.Table) -> pa.Table:
        c = _Chunk(table.select(["doc_id", "text"]), length, k)
        return _messages(table["chunk"][0].as_py(), np.unique(c.prefix[np.unique(c.anchor)]), n_buckets)

    return send


def _heard(answers: pa.Table) -> np.ndarray:
    parts = [unpack(b) for b in answers["hashes"].to_pylist()]
    return np.sort(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def _told(answers: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(hashes that are in other chunks too, hot ones)."""
    hot = pc.less(answers["bucket"], 0)
    return _heard(answers.filter(pc.invert(hot))), _heard(answers.filter(hot))


def _isin(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    if not len(among):
        return np.zeros(len(values), bool)
    at = np.searchsorted(among, values)
    return among[np.minimum(at, len(among) - 1)] == values


def _send_windows(length: int, k: int, n_buckets: int):
    def send(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows or not answers.num_rows:
            return _ARROW.empty_table()
        c, chunk = _Chunk(docs.select(["doc_id", "text"]), length, k), docs["chunk"][0].as_py()
        heard, hot = _told(answers)
        asked = _messages(chunk, np.unique(c.windows[_isin(c.prefix[c.anchor], heard)]), n_buckets)
        # hot prefixes come back with the answers: a negative bucket leaves them as they are
        return pa.concat_tables([asked, pa.table([[chunk], [-1 - chunk % n_buckets], [pack(hot)]], schema=_ARROW)]) if len(hot) else asked

    return send


def _shared(hot_chunks: int | None = None):
    """One bucket: hashes that are in several chunks, told to all of these; with a negative bucket those in `hot_chunks` or more."""

    def share(table: pa.Table) -> pa.Table:
        if table["bucket"][0].as_py() < 0:
            return table.select(_ARROW.names)
        rows = sorted(table.to_pylist(), key=lambda r: r["chunk"])
        values = [unpack(r["hashes"]) for r in rows]
        _, place, times = np.unique(np.concatenate(values), return_inverse=True, return_counts=True)
        times = times[place]  # a chunk sends a hash once
        out, i = {"chunk": [], "bucket": [], "hashes": []}, 0
        for r, v in zip(rows, values, strict=True):
            own = times[i : i + len(v)]
            i += len(v)
            hot = v[own >= hot_chunks] if hot_chunks else v[:0]
            for bucket, got in ((r["bucket"], v[own > 1]), (-1 - r["bucket"], hot)):
                if len(got):
                    out["chunk"].append(r["chunk"])
                    out["bucket"].append(bucket)
                    out["hashes"].append(pack(got))
        return pa.table(out, _ARROW)

    return share


def _stream(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The words, each with one space after it, and where each begins."""
    size = ends - starts + 1
    stop = np.cumsum(size)
    source = np.arange(int(stop[-1]) if len(stop) else 0) - np.repeat(stop - size - starts, size)
    flat = data[np.minimum(source, len(data) - 1)] if len(source) else np.zeros(0, np.uint8)
    flat[stop - 1] = 0x20
    return flat.tobytes(), np.concatenate([[0], stop])


def contexts(words: Words, anchors: np.ndarray, windows: np.ndarray, length: int, k: int) -> tuple[list[bytes], list[bytes]]:
    """Of each anchor the words from it on, and those before it, the nearest first, as far as its windows reach."""
    left, right = np.zeros(len(anchors), np.int64), np.zeros(len(anchors), np.int64)
    for a in range(length - k + 1):
        has = ((windows >> np.uint64(a)) & np.uint64(1)).astype(bool)
        left[has] = a
        right[has & (right == 0)] = length - a
    flat, at = _stream(words.data, words.starts, words.ends)
    suffixes = [flat[i:j] for i, j in zip(at[anchors].tolist(), at[anchors + right].tolist(), strict=True)]
    flat, at = _stream(words.data, words.starts[::-1], words.ends[::-1])
    n = len(words.starts)
    return suffixes, [flat[i:j] for i, j in zip(at[n - anchors].tolist(), at[n - anchors + left].tolist(), strict=True)]


def _word_numbers(texts: list[bytes], width: int) -> np.ndarray:
    """One row a text: numbers of its words, equal for equal words; -1 after its end."""
    parts = pc.split_pattern(pa.array(texts, pa.large_binary()), " ")
    counts = np.diff(parts.offsets.to_numpy())
    numbers = parts.flatten().dictionary_encode().indices.to_numpy()
    row = np.repeat(np.arange(len(texts)), counts)
    column = np.arange(len(numbers)) - np.repeat(np.cumsum(counts) - counts, counts)
    real = column < counts[row] - 1  # what follows the last space is no word
    out = np.full((len(texts), width), -1, np.int32)
    out[row[real], column[real]] = numbers[real]
    return out


def _common(numbers: np.ndarray) -> np.ndarray:
    """How many leading words each row shares with the row before it (-1 for the first)."""
    same = numbers[1:] == numbers[:-1]
    reach = np.where(same.all(1), numbers.shape[1], same.argmin(1)) if numbers.shape[1] else np.zeros(len(same), int)
    return np.concatenate([[-1], reach])


def repeated_windows(suffixes: list[bytes], before: list[bytes], age: np.ndarray, windows: np.ndarray, length: int, k: int) -> np.ndarray:
    """Of each suffix which of its windows also begin at an earlier one; bit a: the window that begins a words before the suffix.

    windows: those that are asked for, all of `length` words within a document; contexts may end where these end."""
    n = len(suffixes)
    right, left = (np.array(sorted(range(n), key=texts.__getitem__), np.int64) for texts in (suffixes, before))
    reach_right = _common(_word_numbers([suffixes[i] for i in right.tolist()], length))
    reach_left = _common(_word_numbers([before[i] for i in left.tolist()], length - k))
    out, run_right, run_left = np.zeros(n, np.uint64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for a in range(length - k + 1):
        rows = np.flatnonzero((windows >> np.uint64(a)) & np.uint64(1))
        if len(rows) < 2:
            continue
        run_right[right], run_left[left] = np.cumsum(reach_right < length - a), np.cumsum(reach_left < a)
        run = run_right[rows] * (n + 1) + run_left[rows]
        order = np.lexsort((age[rows], run))
        again = np.zeros(len(rows), bool)
        again[1:] = run[order][1:] == run[order][:-1]
        out[rows[order[again]]] |= np.uint64(1 << a)
    return out


class _Candidates:
    """The suffixes of a chunk with windows that may repeat, and which of these repeat within the chunk."""

    def __init__(self, c: _Chunk, elsewhere: np.ndarray, length: int, k: int):
        _, inverse, times = np.unique(c.windows, return_inverse=True, return_counts=True)
        maybe = np.flatnonzero(elsewhere | (times[inverse] > 1))
        self.anchors, own = np.unique(c.anchor[maybe], return_inverse=True)
        bit = np.uint64(1) << (c.anchor[maybe] - c.at[maybe]).astype(np.uint64)
        asked, shared = np.zeros(len(self.anchors), np.uint64), np.zeros(len(self.anchors), np.uint64)
        np.bitwise_or.at(asked, own, bit)
        np.bitwise_or.at(shared, own[elsewhere[maybe]], bit[elsewhere[maybe]])
        self.repeated = repeated_windows(*contexts(c.words, self.anchors, asked, length, k), self.anchors, asked, length, k)
        self.open = shared & ~self.repeated  # new in this chunk, and perhaps in another one too


def _send_suffixes(length: int, k: int, salts: int):
    """Of each chunk what is new in it, as suffixes to sort, and, settled, the windows that repeat within it."""
    schema = pa.schema(
        [("prefix", pa.int64()), ("suffix", pa.binary()), ("before", pa.binary()), ("chunk", pa.int64()), ("anchor", pa.int32()), ("windows", pa.int64()), ("settled", pa.bool_()), ("hot", pa.bool_())]
    )

    def send(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return schema.empty_table()
        c, chunk = _Chunk(docs.select(["doc_id", "text"]), length, k), docs["chunk"][0].as_py()
        heard, hot_prefixes = _told(answers)
        found = _Candidates(c, _isin(c.windows, heard), length, k)
        own = mix(np.array([chunk % (1 << 64)], np.uint64))
        out = []
        for windows, settled in ((found.open, False), (found.repeated, True)):
            at = np.flatnonzero(windows)
            anchors, none = found.anchors[at], [b""] * len(at)
            words = (none, none) if settled else contexts(c.words, anchors, windows[at], length, k)
            hot = np.zeros(len(at), bool) if settled else _isin(c.prefix[anchors], hot_prefixes)
            # settled rows only pass: they are dealt out evenly, whatever their words
            key = mix(anchors.astype(np.uint64) + np.uint64((chunk << 20) % (1 << 64))) if settled else c.prefix[anchors]
            key = np.where(hot, mix(key + own % np.uint64(salts)), key)
            columns = [key.view(np.int64), *words, np.full(len(at), chunk), anchors, windows[at].view(np.int64), np.full(len(at), settled), hot]
            out.append(pa.table([pa.array(x, f.type) for x, f in zip(columns, schema, strict=True)], schema=schema))
        return pa.concat_tables(out)

    return send


def _as_before(columns: list[pa.Array], last: tuple | None) -> np.ndarray:
    """Which rows equal, in all columns, the row before; `last` stands before the first."""
    same = np.ones(len(columns[0]), bool)
    for i, c in enumerate(columns):
        same[1:] &= pc.equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
        same[:1] &= last is not None and c[0].as_py() == last[i]
    return same


def _seen(same: np.ndarray, windows: np.ndarray, seen: int, length: int, k: int) -> tuple[np.ndarray, int]:
    """Of each row the windows that rows which equal it had before it, and all that the last row and its equals have.

    seen: those of the row before the first, for rows that equal that one."""
    group, again, open_ = np.cumsum(~same), np.zeros(len(same), np.uint64), 0
    for a in range(length - k + 1):
        bit = np.uint64(1 << a)
        rows = np.flatnonzero(windows & bit)
        repeated = np.zeros(len(rows), bool)
        repeated[1:] = group[rows[1:]] == group[rows[:-1]]
        if seen >> a & 1:
            repeated |= group[rows] == 0
        again[rows[repeated]] |= bit
        if (group[-1] == 0 and seen >> a & 1) or (len(rows) and group[rows[-1]] == group[-1]):
            open_ |= 1 << a
    return again, open_


def _passed(chunk: np.ndarray, anchor: np.ndarray, windows: np.ndarray, words: list[bytes] | None = None) -> pa.RecordBatch:
    """Windows that are known to repeat, or, with their words, some that are to be compared further."""
    at = np.flatnonzero(windows)
    given = pa.nulls(len(at), pa.binary()) if words is None else pa.array([words[i] for i in at.tolist()], pa.binary())
    return pa.record_batch([pa.array(chunk[at], pa.int64()), pa.array(anchor[at], pa.int32()), pa.array(windows[at].view(np.int64)), given], schema=_PASSED_ARROW)


def _extend(length: int, k: int, most: int):
    """Suffixes sorted by prefix, words on both sides and age: the windows that also begin in an earlier chunk; settled ones pass.

    At most `most` new suffixes of one prefix and a batch are in memory."""

    def resolved(table: pa.Table) -> pa.RecordBatch:
        chunk, anchor = (table[c].to_numpy().astype(np.int64) for c in ("chunk", "anchor"))
        windows, age = table["windows"].to_numpy().view(np.uint64), np.empty(table.num_rows, np.int64)
        age[np.lexsort((anchor, chunk))] = np.arange(table.num_rows)
        return _passed(chunk, anchor, repeated_windows(table["suffix"].to_pylist(), table["before"].to_pylist(), age, windows, length, k))

    def singly(table: pa.Table) -> Iterator[pa.RecordBatch]:
        """Each window as a row, with its words: those from the suffix on, and those before it."""
        chunk, anchor = (table[c].to_numpy().astype(np.int64) for c in ("chunk", "anchor"))
        windows = table["windows"].to_numpy().view(np.uint64)
        right, left = ([x.split(b" ") for x in table[c].to_pylist()] for c in ("suffix", "before"))
        for a in range(length - k + 1):
            rows = np.flatnonzero(windows & np.uint64(1 << a))
            if len(rows):
                words = [b" ".join(right[i][: length - a]) + b"\n" + b" ".join(left[i][:a]) for i in rows.tolist()]
                yield _passed(chunk[rows], anchor[rows], np.full(len(rows), 1 << a, np.uint64), words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n_held, last, seen, passing = [], 0, None, 0, None
        for batch in batches:
            settled = batch["settled"]
            done = batch.filter(settled)
            if done.num_rows:
                yield _passed(done["chunk"].to_numpy(), done["anchor"].to_numpy(), done["windows"].to_numpy().view(np.uint64))
            batch = batch.filter(pc.invert(settled))
            if not batch.num_rows:
                continue
            windows = batch["windows"].to_numpy().view(np.uint64)
            same = _as_before([batch[c] for c in ("prefix", "suffix", "before")], last)
            again, seen = _seen(same, windows, seen, length, k)
            last = tuple(batch[c][-1].as_py() for c in ("prefix", "suffix", "before"))
            if again.any():
                yield _passed(batch["chunk"].to_numpy(), batch["anchor"].to_numpy(), again)
            fresh = windows & ~again
            table = pa.Table.from_batches([batch.set_column(batch.schema.get_field_index("windows"), "windows", pa.array(fresh.view(np.int64)))]).filter(pa.array(fresh != 0))
            alone = table["hot"].to_numpy()
            if passing is not None:
                alone = alone | (table["prefix"].to_numpy() == passing)
            if alone.any():
                yield from singly(table.filter(pa.array(alone)))
                table = table.filter(pa.array(~alone))
            if not table.num_rows:
                continue
            held.append(table)
            n_held += table.num_rows
            if n_held >= most:
                table = pa.concat_tables(held)
                prefix = table["prefix"].to_numpy()
                cut = int(np.searchsorted(prefix, prefix[-1]))  # suffixes of the last prefix may go on in the next batch
                if cut:
                    yield resolved(table.slice(0, cut))
                rest = table.slice(cut)
                if rest.num_rows >= most:
                    passing = int(prefix[-1])
                    yield from singly(rest)
                    rest = rest.slice(0, 0)
                held, n_held = [rest.combine_chunks()], rest.num_rows
        if n_held:
            yield resolved(pa.concat_tables(held))
        tidy()

    return run


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows sorted by words and age: those whose words equal the ones before; what has no words is known to repeat."""
    last = None
    for batch in batches:
        if batch.num_rows:
            words = batch["words"]
            keep = words.is_null().to_numpy(zero_copy_only=False)
            there = np.flatnonzero(~keep)
            if len(there):
                words = words.take(pa.array(there))
                keep[there[_as_before([words], last)]] = True
                last = (words[-1].as_py(),)
            yield batch.filter(pa.array(keep)).select(["chunk", "anchor", "repeated"])


def _resolve(length: int, k: int, texts: bool):
    def resolve(docs: pa.Table, answers: pa.Table) -> pa.Table:
        docs = ordered(docs)
        w = Words(docs["text"])
        anchors, repeated = answers["anchor"].to_numpy().astype(np.int64), answers["repeated"].to_numpy().view(np.uint64)
        starts = [anchors[((repeated >> np.uint64(a)) & np.uint64(1)).astype(bool)] - a for a in range(length - k + 1)]
        gone = w.covered(np.concatenate(starts), length)
        n_gone = w.per_doc(gone)
        if texts:
            out, offsets = docs["text"].to_pylist(), w.offsets
            for d in np.flatnonzero(n_gone).tolist():
                i, j = w.first[d], w.first[d + 1]
                edges = np.append(w.starts[i:j], offsets[d + 1])  # a word with the white space after it
                kept = np.repeat(~gone[i:j], np.diff(edges))
                whole = w.data[offsets[d] : offsets[d + 1]]
                out[d] = (whole[: edges[0] - offsets[d]].tobytes() + whole[edges[0] - offsets[d] :][kept].tobytes()).decode()
            return pa.table({"row": docs["row"], "text": pa.array(out, pa.string()), "n_removed": pa.array(n_gone, pa.int64())})
        edges = np.diff(np.concatenate([[0], gone.view(np.int8), [0]]))
        begins, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        spans: list[list] = [[] for _ in range(docs.num_rows)]
        at = np.searchsorted(w.first, begins, side="right") - 1
        for d, b, e in zip(at.tolist(), begins.tolist(), ends.tolist(), strict=True):
            while b < e:  # a run of removed words may go on into the next documents
                stop = min(e, int(w.first[d + 1]))
                if stop > b:
                    spans[d].append({"begin": b - int(w.first[d]), "end": stop - int(w.first[d])})
                b, d = stop, d + 1
        return pa.table(
            {
                "doc_id": docs["doc_id"],
                "n_words": pa.array(w.n_words, pa.int64()),
                "n_removed": pa.array(n_gone, pa.int64()),
                "spans": pa.array(spans, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))),
                "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in w.joined(~gone)], pa.string()),
            }
        )

    return resolve


_SPANS = StructType(
    [
        StructField("doc_id", LongType()),
        StructField("n_words", LongType()),
        StructField("n_removed", LongType()),
        StructField("spans", ArrayType(StructType([StructField("begin", LongType()), StructField("end", LongType())]))),
        StructField("kept_sha256", StringType()),
    ]
)


def _plan(docs: DataFrame, length: int, k: int, chunk_bytes: int, texts: bool, held: int, hot_chunks: int) -> DataFrame:
    if not 0 <= length - k <= 62:
        raise ValueError(f"a suffix of {k} words or more lies in at most 63 windows, so {k} <= length <= {k + 62}")
    total = cluster.text_bytes(docs)
    n_buckets = max(8, math.ceil(total / (16 << 20)))
    row, schema = None, _SPANS
    if texts:
        row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"])
    chunks = cluster.with_chunk(docs, chunk_bytes, total, row)
    if texts:
        schema = StructType([chunks.schema["row"], StructField("text", StringType()), StructField("n_removed", LongType())])
    by_chunk = chunks.groupBy("chunk")
    prefixes = by_chunk.applyInArrow(_send_prefixes(length, k, n_buckets), _MESSAGE)
    shared = prefixes.groupBy("bucket").applyInArrow(_shared(hot_chunks), _MESSAGE)
    windows = chunks.groupBy("chunk").cogroup(shared.groupBy("chunk")).applyInArrow(_send_windows(length, k, n_buckets), _MESSAGE)
    candidates = windows.groupBy("bucket").applyInArrow(_shared(), _MESSAGE)
    salts = math.ceil(total / chunk_bytes / hot_chunks) + 1
    suffixes = chunks.groupBy("chunk").cogroup(candidates.groupBy("chunk")).applyInArrow(_send_suffixes(length, k, salts), _SUFFIX)
    ordered = suffixes.repartition("prefix").sortWithinPartitions("prefix", "suffix", "before", "chunk", "anchor")
    passed = ordered.mapInArrow(_extend(length, k, held), _PASSED)
    # equal words meet in one task; what is known already is dealt out evenly
    met = passed.repartition(F.xxhash64("words", F.when(F.col("words").isNull(), F.struct("chunk", "anchor"))))
    repeated = met.sortWithinPartitions("words", "chunk", "anchor").mapInArrow(_compare, _FOUND)
    return chunks.groupBy("chunk").cogroup(repeated.groupBy("chunk")).applyInArrow(_resolve(length, k, texts), schema)


def repeated_passages(docs: DataFrame, length: int = 50, k: int = 16, chunk_bytes: int = 2 << 20, held: int = HELD, hot_chunks: int = HOT_CHUNKS) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, spans (word ranges that go), kept_sha256."""
    return _plan(docs, length, k, chunk_bytes, False, held, hot_chunks)


def without_repeats(docs: DataFrame, length: int = 50, k: int = 16, chunk_bytes: int = 2 << 20, held: int = HELD, hot_chunks: int = HOT_CHUNKS) -> DataFrame:
    """The documents with repeated passages cut out of `text`; n_chars, where there is one, follows the text."""
    out = _plan(docs, length, k, chunk_bytes, True, held, hot_chunks)
    columns = []
    for c in docs.columns:
        if c == "text":
            columns.append(F.col("text"))
        elif c == "n_chars":
            columns.append(F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema[c].dataType)).otherwise(F.col("row").getField(c)).alias(c))
        else:
            columns.append(F.col("row").getField(c).alias(c))
    return out.select(*columns)
