"""Hierarchical packing of documents into sequences of several context sizes.

A document's ids are cut into whole windows of the largest tier and a remainder.  The remainder goes to
the smallest tier that holds it.  From the largest tier down, each window starts with one remainder of its
tier, and the gap after it is filled with remainders of shorter tiers, the shortest tier first, the last of them cut to
fit; where none is left, with those of its own tier.  A window is thus full.  What is left over at the end of a
partition is cut into sequences whose lengths are powers of two, so nothing is padded.

Within each tier windows are dealt to step groups of `step_tokens` tokens, in order of their attention cost
(sum of squared piece lengths) and back and forth, so that all steps of a tier cost about the same.

No shuffle: every partition of the input is packed on its own, in blocks of a bounded number of tokens.  A hot
source or a very long document is just more windows.  Sequence ids carry the number of the partition.

Defined results: a null or empty text is the end id alone; rows that share a doc_id (copies that a mix repeats, too) are packed
as documents of their own, told apart by `document`; other columns, whatever their names, play no part; an empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .textarrays import tidy

TIERS = (512, 1024, 2048, 4096)
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long, document long"
_COLUMNS = [x.split()[0] for x in PIECES.split(", ")]
_BLOCK_TOKENS = 1 << 20


class _Piece:
    """ids[start : start + length] of one document."""

    __slots__ = ("doc", "start", "length")

    def __init__(self, doc: int, start: int, length: int):
        self.doc, self.start, self.length = doc, start, length

    def cut(self, n: int) -> _Piece:
        """Take the first n ids off."""
        head = _Piece(self.doc, self.start, n)
        self.start += n
        self.length -= n
        return head


class _Pool(deque):
    """Pieces that wait, and how many tokens they have."""

    tokens = 0

    def add(self, p: _Piece) -> None:
        self.append(p)
        self.tokens += p.length

    def take(self) -> _Piece:
        p = self.popleft()
        self.tokens -= p.length
        return p


def pack_block(lengths: list[tuple[int, int, int]], tiers: tuple[int, ...]) -> tuple[list[tuple[int, list[_Piece]]], list[_Piece]]:
    """(doc, start, length) pieces -> full windows as (tier, pieces), and what is left over, less than the smallest tier."""
    top, windows = tiers[-1], []
    pools = {t: _Pool() for t in tiers}

    def route(p: _Piece) -> None:
        pools[next(t for t in tiers if p.length <= t)].add(p)

    for doc, start, length in lengths:
        p = _Piece(doc, start, length)
        while p.length >= top:
            windows.append((top, [p.cut(top)]))
        if p.length:
            route(p)
    for i in reversed(range(len(tiers))):
        tier, pool = tiers[i], pools[tiers[i]]
        fillers = [pools[t] for t in tiers[: i + 1]]  # the shortest first, its own last
        while pool:
            if pool.tokens < tier and not any(fillers[:-1]):
                break  # too little for a window
            if i and len(pool) == 1 and sum(f.tokens for f in fillers) < tier:
                break
            window = [pool.take()]
            gap = tier - window[0].length
            while gap:
                source = next((f for f in fillers if f), None)
                if source is None:
                    break
                p = source.take()
                if p.length > gap:
                    p, rest = p.cut(gap), p
                    route(rest)
                gap -= p.length
                window.append(p)
            if gap:
                for p in window:
                    pool.add(p)
                break
            windows.append((tier, window))
        if i:  # a smaller tier can still use what this one could not
            while pool:
                p = pool.take()
                while p.length > tiers[i - 1]:
                    pools[tiers[i - 1]].add(p.cut(tiers[i - 1]))
                if p.length:
                    route(p)
    return windows, list(pools[tiers[0]])


def powers_of_two(pieces: list[_Piece], tiers: tuple[int, ...]) -> list[tuple[int, list[_Piece]]]:
    """Sequences whose lengths are powers of two, the largest first."""
    total, out, pieces = sum(p.length for p in pieces), [], deque(pieces)
    while total:
        size = min(1 << (total.bit_length() - 1), tiers[-1])
        window, gap = [], size
        while gap:
            p = pieces[0]
            p = pieces.popleft() if p.length <= gap else p.cut(gap)
            window.append(p)
            gap -= p.length
        out.append((size, window))
        total -= size
    return out


def _step_groups(windows: list[tuple[int, list[_Piece]]], step_tokens: int, counters: dict[int, int], last: bool) -> list[int | None]:
    """A step group for each window: numbers of (tier, group) made unique within the partition.

    Of each tier as many windows get one as fill whole groups; the others (None) wait for the next block, but for the last block's."""
    groups: list[int | None] = [None] * len(windows)
    for tier in {t for t, _ in windows}:
        mine = [i for i, (t, _) in enumerate(windows) if t == tier]
        each = max(1, step_tokens // tier)
        if not last:
            mine = mine[: len(mine) // each * each]
        mine.sort(key=lambda i: -sum(p.length**2 for p in windows[i][1]))
        n = -(-len(mine) // each)
        base = counters.get(tier, 0)
        for rank, i in enumerate(mine):
            lap, at = divmod(rank, n)
            groups[i] = ((base + (at if lap % 2 == 0 else n - 1 - at)) << 13) | tier
        counters[tier] = base + n
    return groups


def _partition(path: str, end: int, tiers: tuple[int, ...], step_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from .tokens import tokenizer

        encode, number = tokenizer(path).encode, TaskContext.get().partitionId() << 36
        docs: dict[int, tuple] = {}  # ids of the documents that have unpacked pieces
        open_pieces: list[tuple[int, int, int]] = []
        pending, made, counters = 0, 0, {}

        waiting: list[tuple[int, list[_Piece]]] = []  # full windows of step groups that are not full

        def emit(windows: list[tuple[int, list[_Piece]]], last: bool) -> pa.RecordBatch:
            nonlocal made, waiting
            windows = waiting + windows
            rows: list[list] = [[] for _ in _COLUMNS]
            groups = _step_groups(windows, step_tokens, counters, last)
            waiting = [w for w, group in zip(windows, groups, strict=True) if group is None]
            for (tier, pieces), group in zip(windows, groups, strict=True):
                if group is None:
                    continue
                offset = 0
                for p in pieces:
                    doc_id, ids = docs[p.doc]
                    values = (doc_id, p.start, p.length, zlib.crc32(ids[p.start : p.start + p.length]), len(ids), number + made, offset, tier, number + group, number + p.doc)
                    for column, v in zip(rows, values, strict=True):
                        column.append(v)
                    offset += p.length
                made += 1
            kinds = [pa.int32() if c == "tier" else pa.int64() for c in _COLUMNS]
            return pa.record_batch([pa.array(r, k) for r, k in zip(rows, kinds, strict=True)], names=_COLUMNS)

        next_doc = 0
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            for i in range(0, len(ids), 128):
                for doc_id, encoded in zip(ids[i : i + 128], encode(texts.slice(i, 128).to_pylist(), end), strict=True):
                    docs[next_doc] = (doc_id, encoded)
                    open_pieces.append((next_doc, 0, len(encoded)))
                    pending += len(encoded)
                    next_doc += 1
                if pending >= _BLOCK_TOKENS:
                    windows, rest = pack_block(open_pieces, tiers)
                    yield emit(windows, last=False)
                    open_pieces = [(p.doc, p.start, p.length) for p in rest]
                    docs = {p.doc: docs[p.doc] for p in [*rest, *(p for _, w in waiting for p in w)]}
                    pending = sum(p.length for p in rest)
        windows, rest = pack_block(open_pieces, tiers)
        yield emit(windows + powers_of_two(rest, tiers), last=True)
        docs.clear()
        tidy()

    return run


def packed(docs: DataFrame, tokenizer_path: str | None = None, end: int = 2, tiers: tuple[int, ...] = TIERS, step_tokens: int = 1 << 16) -> DataFrame:
    """One row per piece: where its ids come from, and the sequence, offset, tier and step group they go to."""
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("word_bpe_49k.json")
    texts = docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text")
    return texts.mapInArrow(_partition(tokenizer_path, end, tuple(sorted(tiers)), step_tokens), PIECES)
