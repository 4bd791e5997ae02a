"""Class-based bigram language model: exchange clustering, class transitions, word emissions.

Tokens are the words of a text (A-Z in lower case) and one end token.  The TOP most frequent training words are
put into CLASSES classes by exchange clustering: each word in turn moves to the class that most raises
the likelihood of the class bigrams, until none moves.  Every other word that occurs LEAST times or more then joins the class that
most raises it, by the classes of its neighbours, in which words beyond the TOP count as rare.  Words that occur less often share one
class, the rare one, which stands for unseen words too; the end token is one.
P(word | previous) = P(class | previous class) * P(word | class); transitions are smoothed by class frequency, the
rare class leaves one share to all unseen words, so the probabilities of all known words and of "unseen" sum to 1.

All counts cover the whole training corpus and grow with it: each task counts its words before the
shuffle and sends sorted hashes with counts to buckets.  Only the TOP words (from at most PARTS rows, however many buckets there are), their bigram counts (at most
(TOP + 2) ** 2 numbers) and the class bigrams reach the driver.  A word's class lies in its bucket beside its count; it is found there from
the word's counts of (class before) and (class after), at most 2 (CLASSES + 2) a word.  The vocabulary is never broadcast: each chunk of
documents sends its distinct words to the buckets and gets counts and classes back, from which the class bigrams of all words
are counted and the documents scored.  A word in every document is one entry a task or chunk.

Words are told apart by 64-bit hashes.  Defined results: a null text is empty and has the end token only; documents
with null doc_id are scored but not learned from; with no training document every token is unseen; repeated
rows count as often as they occur; other columns, whatever their names, play no part; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import cluster
from .textarrays import Words, pack, split_sorted, unpack

TOP, CLASSES, SWEEPS, SMOOTHING, LEAST = 1024, 64, 12, 2.0, 2
#: rows that describe the vocabulary on the driver; parts of the bigram table; tasks whose bigrams are summed together first
PARTS, BIGRAM_PARTS, TASKS_AT_ONCE = 64, 256, 128
END = np.uint64(0xE0D0E0D0E0D0E0D1)
_ZSTD = pa.Codec("zstd", 1)
_COUNTS = "bucket int, hashes binary, counts binary"
_COUNTS_ARROW = pa.schema([("bucket", pa.int32()), ("hashes", pa.binary()), ("counts", pa.binary())])
_FLUSH_WORDS = 1 << 20


def held_out(doc_id: Column, modulus: int = 7, remainder: int = 2) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % modulus == remainder, F.lit(False))


def _numbers(values: np.ndarray, kind: str = "<u8") -> bytes:
    return len(values).to_bytes(8, "little") + _ZSTD.compress(values.astype(kind).tobytes(), asbytes=True)


def _read_numbers(blob: bytes, kind: str = "<u8") -> np.ndarray:
    n = int.from_bytes(blob[:8], "little")
    return np.frombuffer(_ZSTD.decompress(blob[8:], decompressed_size=n * np.dtype(kind).itemsize, asbytes=True), kind)


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all tokens, first token of each document and the end): each document ends with END."""
    words = Words(texts, lower=True)
    n = len(words.n_words)
    first = words.first + np.arange(n + 1)
    out = np.empty(first[-1], np.uint64)
    ends = first[1:] - 1
    own = np.ones(len(out), bool)
    own[ends] = False
    out[own], out[ends] = words.hashes(), END
    return out, first


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[begin], np.add.reduceat(counts, begin) if len(begin) else counts


def _slices(texts: pa.Array, n: int = 256) -> Iterator[pa.Array]:
    for i in range(0, len(texts), n):
        yield texts.slice(i, n)


def _count_words(n_buckets: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = [], []

        def flush() -> pa.RecordBatch:
            k, c = _summed(np.concatenate(keys), np.concatenate(counts)) if keys else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            parts = split_sorted(k, n_buckets)
            return pa.record_batch([pa.array([b for b, _, _ in parts], pa.int32()), pa.array([pack(k[i:j]) for _, i, j in parts], pa.binary()), pa.array([_numbers(c[i:j]) for _, i, j in parts], pa.binary())], schema=_COUNTS_ARROW)

        for batch in batches:
            for texts in _slices(batch.column("text")):
                k, c = np.unique(_tokens(texts)[0], return_counts=True)
                keys.append(k)
                counts.append(c)
                if len(keys) >= 32:
                    k, c = _summed(np.concatenate(keys), np.concatenate(counts))
                    keys, counts = [k], [c]
                    if len(k) > _FLUSH_WORDS:
                        yield flush()
                        keys, counts = [], []
        yield flush()

    return count


def _sum_bucket(table: pa.Table) -> pa.Table:
    keys = np.concatenate([unpack(b) for b in table["hashes"].to_pylist()])
    counts = np.concatenate([_read_numbers(b) for b in table["counts"].to_pylist()])
    keys, counts = _summed(keys, counts)
    return pa.table([[table["bucket"][0].as_py()], [pack(keys)], [_numbers(counts)]], schema=_COUNTS_ARROW)


_DESCRIBED = "part int, types long, tokens long, top binary, top_counts binary"
_DESCRIBED_ARROW = pa.schema([("part", pa.int32()), ("types", pa.int64()), ("tokens", pa.int64()), ("top", pa.binary()), ("top_counts", pa.binary())])


def _most_frequent(part: int, types: int, tokens: int, keys: np.ndarray, counts: np.ndarray) -> dict:
    top = np.lexsort((keys, -counts.astype(np.int64)))[: TOP + 1]
    return {"part": part, "types": types, "tokens": tokens, "top": keys[top].astype("<u8").tobytes(), "top_counts": counts[top].astype("<u8").tobytes()}


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of all buckets of a task: distinct words, tokens, and the most frequent words, in one row."""
    from pyspark import TaskContext

    types, tokens, top, top_counts = 0, 0, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    for batch in batches:
        for r in batch.to_pylist():
            keys, counts = unpack(r["hashes"]), _read_numbers(r["counts"])
            row = _most_frequent(0, 0, 0, np.concatenate([top, keys]), np.concatenate([top_counts, counts]))
            top, top_counts = (np.frombuffer(row[c], "<u8") for c in ("top", "top_counts"))
            types, tokens = types + len(keys), tokens + int(counts.sum())
    yield pa.RecordBatch.from_pylist([_most_frequent(TaskContext.get().partitionId() % PARTS, types, tokens, top, top_counts)], _DESCRIBED_ARROW)


def _describe_all(table: pa.Table) -> pa.Table:
    """The rows of several tasks in one: at most PARTS of them reach the driver."""
    keys, counts = (np.concatenate([np.frombuffer(b, "<u8") for b in table[c].to_pylist()]) for c in ("top", "top_counts"))
    return pa.Table.from_pylist([_most_frequent(table["part"][0].as_py(), sum(table["types"].to_pylist()), sum(table["tokens"].to_pylist()), keys, counts)], _DESCRIBED_ARROW)


def _symbols(hashes: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    """Numbers of the sorted top words; then one for all others, and one for END."""
    n = len(vocabulary)
    at = np.searchsorted(vocabulary, hashes)
    found = (at < n) & (vocabulary[np.minimum(at, max(n - 1, 0))] == hashes) if n else np.zeros(len(hashes), bool)
    return np.where(hashes == END, n + 1, np.where(found, at, n))


def _count_bigrams(vocabulary: np.ndarray, parts: int = BIGRAM_PARTS):
    """Bigram counts of a task, by part of the table; the bucket is the part and a number of the task."""
    size = len(vocabulary) + 2

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() // TASKS_AT_ONCE * parts
        total = np.zeros(size * size, np.int64)
        for batch in batches:
            for texts in _slices(batch.column("text")):
                s = _symbols(_tokens(texts)[0], vocabulary)  # END before the first token, and between documents
                before = np.concatenate([[size - 1], s[:-1]])
                code, n = np.unique(before * size + s, return_counts=True)
                total[code] += n
        codes = np.flatnonzero(total)
        part = codes * parts // (size * size)
        rows = [(p, codes[part == p]) for p in np.unique(part)]
        yield pa.record_batch([pa.array([first + p for p, _ in rows], pa.int32()), pa.array([pack(c.astype(np.uint64)) for _, c in rows], pa.binary()), pa.array([_numbers(total[c]) for _, c in rows], pa.binary())], schema=_COUNTS_ARROW)

    return count


def _xlogx(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log(np.maximum(x, 1)), 0.0)


def exchange_classes(bigrams: np.ndarray, n_classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """A class for each symbol.  bigrams: counts of (previous, next); the last two symbols keep classes of their own.

    A move is worth what it adds to sum f(n(c, d)) - sum f(n(c, .)) - sum f(n(., d)), f(x) = x log x."""
    n = len(bigrams) - 2
    k = max(1, min(n_classes, n)) if n else 0
    total = k + 2
    of = np.concatenate([np.argsort(np.argsort(-bigrams[:n, :].sum(1), kind="stable")) % k if n else np.zeros(0, int), [k, k + 1]]).astype(int)
    one_hot = np.eye(total)[of]
    right = bigrams @ one_hot  # (word, class after it)
    left = bigrams.T @ one_hot  # (word, class before it)
    pair = one_hot.T @ right
    order = np.argsort(-bigrams[:n, :].sum(1), kind="stable")

    for _ in range(sweeps):
        moved = 0
        for w in order:
            a, own = of[w], bigrams[w, w]
            r, ell = right[w].copy(), left[w].copy()
            r[a] -= own
            ell[a] -= own  # neighbours other than w itself
            pair[a, :] -= r
            pair[:, a] -= ell
            pair[a, a] -= own
            rows, columns = pair.sum(1) + ell, pair.sum(0) + r  # w follows and precedes the same words in any class
            row_gain = _xlogx(pair[:k] + r) - _xlogx(pair[:k])
            column_gain = _xlogx(pair[:, :k].T + ell) - _xlogx(pair[:, :k].T)
            d = np.arange(k)
            gain = row_gain.sum(1) - row_gain[d, d] + column_gain.sum(1) - column_gain[d, d]
            gain += _xlogx(pair[d, d] + r[:k] + ell[:k] + own) - _xlogx(pair[d, d])
            gain -= _xlogx(rows[:k] + r.sum() + own) - _xlogx(rows[:k]) + _xlogx(columns[:k] + ell.sum() + own) - _xlogx(columns[:k])
            b = int(gain.argmax())
            if gain[b] <= gain[a] + 1e-9:
                b = a
            pair[b, :] += r
            pair[:, b] += ell
            pair[b, b] += own
            if b != a:
                moved += 1
                of[w] = b
                right[:, a] -= bigrams[:, w]
                right[:, b] += bigrams[:, w]
                left[:, a] -= bigrams[w, :]
                left[:, b] += bigrams[w, :]
        if not moved:
            break
    return of


def _transitions(pair: np.ndarray) -> np.ndarray:
    frequency = (pair.sum(0) + 1) / (pair.sum() + len(pair))
    return np.log10((pair + SMOOTHING * frequency) / (pair.sum(1, keepdims=True) + SMOOTHING))


class Model:
    """What scoring needs besides the words' counts and classes: sizes, classes of the top words, log10 transitions."""

    def __init__(self, tokens: int, types: int, vocabulary: np.ndarray, counts: np.ndarray, bigrams: np.ndarray):
        self.tokens, self.types, self.vocabulary = tokens, types, vocabulary
        self.classes = exchange_classes(bigrams)
        n = int(self.classes.max()) + 1
        one_hot = np.eye(n)[self.classes]
        self.rare, self.end = n - 2, n - 1
        self.pair = one_hot.T @ bigrams @ one_hot
        self.transitions = _transitions(self.pair)
        ends = int(bigrams[:, -1].sum())
        self.sizes = sizes = one_hot[: len(counts)].T @ counts if len(counts) else np.zeros(n)
        with np.errstate(divide="ignore"):
            self.emissions = np.log10(counts / sizes[self.classes[: len(counts)]]) if len(counts) else np.zeros(0)
        self.rare_tokens = tokens - int(counts.sum()) - ends
        self.rare_types = types - len(counts) - (ends > 0)

    def widen(self, pair: np.ndarray, sizes: np.ndarray, rare_types: int) -> None:
        """Class bigrams and class sizes of all words take the place of those of the top words."""
        self.pair, self.sizes, self.transitions = pair, sizes, _transitions(pair)
        self.rare_tokens, self.rare_types = int(sizes[self.rare]), rare_types


_NEAR = "bucket int, hashes binary, codes binary, counts binary"
_NEAR_ARROW = pa.schema([("bucket", pa.int32()), ("hashes", pa.binary()), ("codes", pa.binary()), ("counts", pa.binary())])
_WORDS = "bucket int, hashes binary, counts binary, classes binary, sizes array<long>, rare_types long"
_WORDS_ARROW = pa.schema([("bucket", pa.int32()), ("hashes", pa.binary()), ("counts", pa.binary()), ("classes", pa.binary()), ("sizes", pa.list_(pa.int64())), ("rare_types", pa.int64())])


def _summed_pairs(keys: np.ndarray, codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((codes, keys))
    keys, codes, counts = keys[order], codes[order], counts[order]
    begin = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (codes[1:] != codes[:-1])])) if len(keys) else np.zeros(0, np.int64)
    return keys[begin], codes[begin], np.add.reduceat(counts, begin) if len(begin) else counts


def _count_neighbours(model: Model, n_buckets: int):
    """Of each word beyond the top: how often it follows each class, and (codes from the number of classes on) precedes each."""
    n = len(model.vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []
        rows = 0

        def flush() -> pa.RecordBatch:
            k, d, c = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.uint64), np.zeros(0, np.uint8), np.zeros(0, np.int64))
            k, d, c = _summed_pairs(k, d, c)
            parts = split_sorted(k, n_buckets)
            return pa.record_batch([pa.array([b for b, _, _ in parts], pa.int32()), *(pa.array([f(x[i:j]) for _, i, j in parts], pa.binary()) for f, x in ((pack, k), (_bytes, d), (_numbers, c)))], schema=_NEAR_ARROW)

        for batch in batches:
            for texts in _slices(batch.column("text")):
                hashes, _ = _tokens(texts)
                symbols = _symbols(hashes, model.vocabulary)
                classes = model.classes[symbols]
                at = np.flatnonzero(symbols == n)  # an end token follows any word
                before = np.where(at > 0, classes[at - 1], model.end)
                codes = np.concatenate([before, model.end + 1 + classes[at + 1]]).astype(np.uint8)
                found.append(_summed_pairs(np.concatenate([hashes[at], hashes[at]]), codes, np.ones(2 * len(at), np.int64)))
                rows += len(found[-1][0])
                if rows > _FLUSH_WORDS:
                    yield flush()
                    found, rows = [], 0
        yield flush()

    return count


def _bytes(values: np.ndarray) -> bytes:
    return _numbers(values, "u1")


def best_classes(pair: np.ndarray, of: np.ndarray, codes: np.ndarray, counts: np.ndarray, block: int = 1 << 14) -> np.ndarray:
    """For words 0, 1, ... the class that most raises the likelihood when the word is added to it.

    of: the word of each entry, rising; codes and counts as _count_neighbours has them."""
    total = len(pair)
    k = total - 2
    table = np.vstack([pair[:, :k], pair[:k].T])  # the row of a code: the cell that each class adds to
    now = _xlogx(table)
    rows, columns = pair[:k].sum(1), pair[:, :k].sum(0)
    edges = np.append(np.flatnonzero(np.diff(of, prepend=-1)), len(of))
    out = np.zeros(len(edges) - 1, np.int64)
    i = 0
    while i < len(out):
        j = max(i + 1, int(np.searchsorted(edges, edges[i] + block, side="right")) - 1)
        here = slice(edges[i], edges[j])
        gain = np.add.reduceat(_xlogx(table[codes[here]] + counts[here, None]) - now[codes[here]], edges[i:j] - edges[i], axis=0)
        n = np.add.reduceat(np.where(codes[here] < total, counts[here], 0), edges[i:j] - edges[i])[:, None]
        gain -= _xlogx(rows + n) - _xlogx(rows) + _xlogx(columns + n) - _xlogx(columns)
        out[i:j] = gain.argmax(1)
        i = j
    return out


def _classify(model: Model):
    def classify(counted: pa.Table, near: pa.Table) -> pa.Table:
        keys, counts = unpack(counted["hashes"][0].as_py()), _read_numbers(counted["counts"][0].as_py()).astype(np.int64)
        classes = model.classes[_symbols(keys, model.vocabulary)].astype(np.uint8)
        if near.num_rows:
            words, codes, n = _summed_pairs(*(np.concatenate([f(b) for b in near[c].to_pylist()]) for c, f in (("hashes", unpack), ("codes", lambda b: _read_numbers(b, "u1")), ("counts", lambda b: _read_numbers(b).astype(np.int64)))))
            at = np.searchsorted(keys, words)
            often = counts[at] >= LEAST
            at, codes, n = at[often], codes[often], n[often]
            if len(at):
                classes[np.unique(at)] = best_classes(model.pair, at, codes, n)
        sizes = np.bincount(classes, counts, model.end + 1).astype(np.int64)
        return pa.table([[counted["bucket"][0].as_py()], [pack(keys)], [_numbers(counts)], [_bytes(classes)], [sizes.tolist()], [int((classes == model.rare).sum())]], schema=_WORDS_ARROW)

    return classify


def trained(docs: DataFrame, path: str, n_buckets: int, modulus: int = 7, remainder: int = 2) -> Model:
    """Writes the training words, with counts and classes, in buckets to `path`; the model's transitions are still those of the top words."""
    spark, out, path = docs.sparkSession, path, f"{path}-counts"
    training = docs.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), modulus, remainder)).select(F.col("text").cast("string").alias("text"))
    training.mapInArrow(_count_words(n_buckets), _COUNTS).groupBy("bucket").applyInArrow(_sum_bucket, _COUNTS).write.parquet(path)
    described = spark.read.schema(_COUNTS).parquet(path).mapInArrow(_describe, _DESCRIBED).groupBy("part").applyInArrow(_describe_all, _DESCRIBED).collect()
    keys = np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(bytes(r.top), "<u8") for r in described)])
    counts = np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(bytes(r.top_counts), "<u8") for r in described)]).astype(np.int64)
    words = keys != END
    keys, counts = keys[words], counts[words]
    top = np.lexsort((keys, -counts))[:TOP]
    top = top[np.argsort(keys[top])]
    vocabulary, counts = keys[top], counts[top]
    size = len(vocabulary) + 2
    bigrams = np.zeros(size * size, np.int64)
    of_tasks = training.mapInArrow(_count_bigrams(vocabulary), _COUNTS).groupBy("bucket").applyInArrow(_sum_bucket, _COUNTS)
    for r in of_tasks.withColumn("bucket", F.col("bucket") % BIGRAM_PARTS).groupBy("bucket").applyInArrow(_sum_bucket, _COUNTS).collect():
        bigrams[unpack(bytes(r.hashes)).astype(np.int64)] = _read_numbers(bytes(r.counts))
    model = Model(sum(r.tokens for r in described), sum(r.types for r in described), vocabulary, counts, bigrams.reshape(size, size).astype(np.float64))
    near = training.mapInArrow(_count_neighbours(model, n_buckets), _NEAR)
    spark.read.schema(_COUNTS).parquet(path).groupBy("bucket").cogroup(near.groupBy("bucket")).applyInArrow(_classify(model), _WORDS).write.parquet(out)
    return model


def _ask(n_buckets: int):
    def ask(table: pa.Table) -> pa.Table:
        chunk, unique = table["chunk"][0].as_py(), np.unique(_tokens(table["text"].combine_chunks())[0])
        parts = split_sorted(unique, n_buckets)
        return pa.table([[chunk] * len(parts), [b for b, _, _ in parts], [pack(unique[i:j]) for _, i, j in parts]], schema=_ASKED_ARROW)

    return ask


_ASKED = "chunk long, bucket int, payload binary"
_ASKED_ARROW = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("payload", pa.binary())])


_ANSWERS = "chunk long, bucket int, counts binary, classes binary"
_ANSWERS_ARROW = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("counts", pa.binary()), ("classes", pa.binary())])


def _answer(rare: int):
    def answer(asked: pa.Table, words: pa.Table) -> pa.Table:
        keys, counts, classes = (np.zeros(1, np.uint64), np.zeros(1, np.uint64), np.zeros(1, np.uint8))
        for r in words.to_pylist():
            keys, counts, classes = unpack(r["hashes"]), _read_numbers(r["counts"]), _read_numbers(r["classes"], "u1")
        out = []
        for blob in asked["payload"].to_pylist():
            wanted = unpack(blob)
            at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            found = keys[at] == wanted
            out.append((_numbers(np.where(found, counts[at], 0)), _bytes(np.where(found, classes[at], rare))))
        return pa.table([asked["chunk"], asked["bucket"], *(pa.array([o[i] for o in out], pa.binary()) for i in (0, 1))], schema=_ANSWERS_ARROW)

    return answer


def _told(docs: pa.Table, answers: pa.Table, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first token of each document and the end, counts, classes, classes before) of the tokens of a chunk."""
    hashes, first = _tokens(docs["text"].combine_chunks())
    unique, inverse = np.unique(hashes, return_inverse=True)
    rows = sorted(answers.to_pylist(), key=lambda r: r["bucket"])  # buckets rise with the hash
    counts = np.concatenate([_read_numbers(r["counts"]) for r in rows]).astype(np.float64)[inverse]
    classes = np.concatenate([_read_numbers(r["classes"], "u1") for r in rows]).astype(np.int64)
    classes[unique == END] = end  # also where nothing was learned
    classes = classes[inverse]
    return first, counts, classes, np.concatenate([[end], classes[:-1]])


def _count_pairs(end: int):
    def count(docs: pa.Table, answers: pa.Table) -> pa.Table:
        first, _, classes, before = _told(docs, answers, end)
        learn = np.repeat(docs["learn"].to_numpy(), np.diff(first))
        code, n = np.unique((before * (end + 1) + classes)[learn], return_counts=True)
        return pa.table({"code": pa.array(code, pa.int32()), "n": pa.array(n, pa.int64())})

    return count


def _score(model: Model):
    def score(docs: pa.Table, answers: pa.Table) -> pa.Table:
        first, counts, classes, before = _told(docs, answers, model.end)
        n_tokens = np.diff(first)
        sums = lambda x: np.add.reduceat(x, first[:-1])  # noqa: E731  every document has its end token
        base = np.log10((counts + 1) / (model.tokens + 1.0 * (model.types + 1)))
        emission = np.zeros(len(classes))
        own = classes < model.rare
        emission[own] = np.log10(counts[own] / model.sizes[classes[own]])
        other = classes == model.rare
        emission[other] = np.log10((counts[other] + 1) / (model.rare_tokens + model.rare_types + 1))
        return pa.table(
            {
                "doc_id": docs["doc_id"],
                "n_tokens": pa.array(n_tokens, pa.int64()),
                "n_known": pa.array(sums((counts > 0).astype(np.int64)), pa.int64()),
                "train_tokens": pa.array(np.full(len(n_tokens), model.tokens), pa.int64()),
                "base_score": pa.array(sums(base), pa.float64()),
                "score": pa.array(sums(model.transitions[before, classes] + emission), pa.float64()),
            }
        )

    return score


def scored(docs: DataFrame, modulus: int = 7, remainder: int = 2, chunk_bytes: int = 4 << 20) -> DataFrame:
    """One row per document: doc_id, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    total = cluster.text_bytes(docs)
    n_buckets = max(8, math.ceil(total / (16 << 20)))
    path = cluster.scratch(spark, "lm-words")
    learn = F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), modulus, remainder)
    chunks = cluster.with_chunk(docs, chunk_bytes, total).withColumn("learn", learn)
    with cluster.shuffles_end_with_query(spark):
        model = trained(docs, path, n_buckets, modulus, remainder)
        words = spark.read.schema(_WORDS).parquet(path)
        asked = chunks.groupBy("chunk").applyInArrow(_ask(n_buckets), _ASKED)
        answers = cluster.written(asked.groupBy("bucket").cogroup(words.groupBy("bucket")).applyInArrow(_answer(model.rare), _ANSWERS), "lm-answers")
        pair, sizes = np.zeros((model.end + 1) ** 2), np.zeros(model.end + 1)
        pairs = chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_count_pairs(model.end), "code int, n long")
        for r in pairs.groupBy("code").agg(F.sum("n").alias("n")).collect():
            pair[r.code] = r.n
        for r in words.select(F.posexplode("sizes").alias("class", "n")).groupBy("class").agg(F.sum("n").alias("n")).collect():
            sizes[r["class"]] = r.n
        rare_types = words.agg(F.coalesce(F.sum("rare_types"), F.lit(0))).first()[0]
    model.widen(pair.reshape(model.end + 1, -1), sizes, rare_types)
    out = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_score(model), out)
