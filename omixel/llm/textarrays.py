"""Words of many texts as numpy arrays, and 64-bit hashes of words and word windows.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D of the UTF-8 text, kept unchanged.
Everything works on whole columns at once; a null text has no words.
"""

from __future__ import annotations

import contextlib
import ctypes

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: odd 64-bit multipliers of the two polynomial hashes
_BYTE_BASE = 0x9E3779B97F4A7C15 | 1
_WORD_BASE = 0xD6E8FEB86659FD93 | 1
#: of a second hash of bytes, which shares nothing with the first
_CHECK_BASE = 0xA24BAED4963EE407 | 1
_BLOCK = 1 << 19  # bytes of text hashed at once
_ZSTD = pa.Codec("zstd", 1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def tidy() -> None:
    """Give freed memory back: a worker lives on for other stages, and its executor counts what it holds."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


class _Powers:
    """Powers of an odd number and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = max(n, 2 * len(self.up))
            out = []
            for x in (self.base, self.inverse):
                a = np.full(size, x, np.uint64)
                a[0] = 1
                out.append(np.multiply.accumulate(a))
            self.up, self.down = out
        return self.up[:n], self.down[:n]


_bytes_powers, _words_powers, _check_powers = _Powers(_BYTE_BASE), _Powers(_WORD_BASE), _Powers(_CHECK_BASE)


def _range_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: _Powers) -> np.ndarray:
    """Polynomial hash of values[s:e] for each s, e, the same wherever the range lies."""
    up, down = powers.get(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return (sums[ends] - sums[starts]) * down[starts]


class Words:
    """The words of a column of texts: byte ranges, documents and hashes."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
        texts = texts.cast(pa.large_string()).fill_null("")
        n = len(texts)
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
        raw = texts.buffers()[2] if n else None
        whole = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
        self.data = whole[offsets[0] : offsets[-1]]
        if lower:
            lut = np.arange(256, dtype=np.uint8)
            lut[65:91] += 32
            self.data = lut[self.data]
        self.offsets = offsets - offsets[0]
        word = ~_SPACE[self.data]
        begins = self.offsets[:-1][self.offsets[:-1] < len(self.data)]
        before = np.zeros(len(word), bool)
        before[1:] = word[:-1]
        before[begins] = False
        after = np.zeros(len(word), bool)
        after[:-1] = word[1:]
        after[begins[begins > 0] - 1] = False
        self.starts = np.flatnonzero(word & ~before)
        self.ends = np.flatnonzero(word & ~after) + 1
        #: words of document d are first[d] .. first[d + 1]
        self.first = np.searchsorted(self.starts, self.offsets)
        self.n_words = np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        return self._hashed(_bytes_powers)

    def checks(self) -> np.ndarray:
        """A second 64-bit hash of each word, independent of the first: made of its bytes, not of that."""
        return ~self._hashed(_check_powers)

    def _hashed(self, powers: _Powers) -> np.ndarray:
        out = np.empty(len(self.starts), np.uint64)
        i = 0
        while i < len(out):
            low = self.starts[i]
            j = max(i + 1, int(np.searchsorted(self.ends, low + _BLOCK, side="right")))
            s, e = self.starts[i:j] - low, self.ends[i:j] - low
            block = self.data[low : low + e[-1]].astype(np.uint64) + np.uint64(1)
            out[i:j] = mix(_range_hash(block, s, e, powers) + (e - s).astype(np.uint64))
            i = j
        return out

    def windows(self, size: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first word, hash) of each window of `size` consecutive words of one document."""
        room = np.maximum(self.n_words - size + 1, 0)
        total = int(room.sum())
        at = np.arange(total) + np.repeat(self.first[:-1] - (np.cumsum(room) - room), room)
        return at, window_hashes(hashes, at, at + size)

    def covered(self, at: np.ndarray, size: int) -> np.ndarray:
        """Which words lie in one of the windows that begin at `at`."""
        steps = np.zeros(len(self.starts) + 1, np.int64)
        np.add.at(steps, at, 1)
        np.add.at(steps, np.minimum(at + size, len(self.starts)), -1)
        return np.cumsum(steps[:-1]) > 0

    def per_doc(self, flags: np.ndarray) -> np.ndarray:
        """Sum of `flags` over the words of each document."""
        sums = np.concatenate([[0], np.cumsum(flags)])
        return sums[self.first[1:]] - sums[self.first[:-1]]

    def joined(self, keep: np.ndarray) -> list[bytes]:
        """For each document its kept words, joined by single spaces."""
        out, d, n = [], 0, len(self.n_words)
        while d < n:  # some documents at a time: the index arrays take many times the bytes of their texts
            stop = max(d + 1, int(np.searchsorted(self.offsets, self.offsets[d] + _BLOCK, side="right")) - 1)
            out += self._joined(keep, d, min(stop, n))
            d = stop
        return out

    def _joined(self, keep: np.ndarray, d: int, stop: int) -> list[bytes]:
        i, j = self.first[d], self.first[stop]
        kept = keep[i:j]
        s, e = self.starts[i:j][kept], self.ends[i:j][kept]
        size = e - s + 1
        ends = np.cumsum(size)
        source = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - size - s, size)
        np.minimum(source, len(self.data) - 1, out=source)
        flat = self.data[source]
        flat[ends - 1] = 0x20
        flat = flat.tobytes()
        counts = np.concatenate([[0], np.cumsum(kept)])[self.first[d : stop + 1] - i]
        edge = np.concatenate([[0], ends])[counts].tolist()
        return [flat[a : b - 1] if b > a else b"" for a, b in zip(edge[:-1], edge[1:], strict=True)]


def window_hashes(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word sequence hashes[s:e]."""
    out = np.empty(len(starts), np.uint64)
    i, block = 0, 1 << 16
    while i < len(out):
        j = min(len(out), i + block)
        low, high = int(starts[i:j].min()), int(ends[i:j].max())
        out[i:j] = mix(_range_hash(hashes[low:high], starts[i:j] - low, ends[i:j] - low, _words_powers))
        i = j
    return out


def pack(values: np.ndarray) -> bytes:
    """Sorted unsigned 64-bit numbers as compressed byte planes of their differences."""
    deltas = np.diff(values, prepend=np.uint64(0)).astype("<u8")
    planes = np.ascontiguousarray(deltas.view(np.uint8).reshape(-1, 8).T)
    return len(values).to_bytes(8, "little") + _ZSTD.compress(planes.tobytes(), asbytes=True)


def unpack(blob: bytes) -> np.ndarray:
    n = int.from_bytes(blob[:8], "little")
    raw = np.frombuffer(_ZSTD.decompress(blob[8:], decompressed_size=8 * n, asbytes=True), np.uint8)
    return np.cumsum(np.ascontiguousarray(raw.reshape(8, n).T).view("<u8").ravel(), dtype=np.uint64)


def buckets_of(values: np.ndarray, n: int) -> np.ndarray:
    """The bucket of each hash; it rises with the hash."""
    return ((values >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)


def split_sorted(values: np.ndarray, n: int) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of the non-empty buckets of sorted hashes."""
    edges = np.searchsorted(buckets_of(values, n), np.arange(n + 1))
    return [(b, int(edges[b]), int(edges[b + 1])) for b in range(n) if edges[b] < edges[b + 1]]
