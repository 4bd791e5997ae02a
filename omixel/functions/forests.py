"""Regression forests on few rows, of many targets at once: rows are bits of a word, cuts are words."""

from __future__ import annotations

from functools import cache

import numpy as np

from .solvers import EQUAL, NONE, RegressionForest, subset_sums

#: a node whose best cut may be another one than those at hand
LEFT = -2


class Partings:
    """Distinct cuts in order of (column, place), each with the least of another column that parts the rows alike, (-1, -1) where there is none.

    Of all ways to part a node's rows the best one is looked for among the cuts, and the search ends at the first that is found.  A node of k rows
    has 2^(k - 1) ways at most, so of many cuts few are looked at.  `whole`: these are all cuts, not the first ones only."""

    #: rows of a node up to which all its ways are tried, ways that are looked for one by one, numbers handled at once, bits looked up at once
    MOST, TRIES, CELLS, CHUNK = 20, 24, 1 << 17, 13
    #: rows in a word
    FIT = 32

    def __init__(self, packed: np.ndarray, named: np.ndarray, n: int, whole: bool = True):
        """packed: rows of bytes as numpy's packbits gives them; named: (column, place, other column, its place)."""
        order, words = np.lexsort((named[:, 1], named[:, 0])), np.zeros((len(packed), 4), np.uint8)
        words[:, : packed.shape[1]] = packed[order]
        self.codes = words.view(">u4").ravel().astype(np.uint32)
        self.column, self.place, self.second = named[order, 0], named[order, 1], named[order, 2:]
        self.bits = np.uint32(1) << np.arange(31, 31 - n, -1, dtype=np.uint32)
        self.whole, self.compared = whole, 0

    def own(self, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the cuts that have their first name of a column begin and end."""
        return np.searchsorted(self.column, columns, "left"), np.searchsorted(self.column, columns, "right")

    def rows(self, words: np.ndarray) -> np.ndarray:
        return (words[:, None] & self.bits) > 0

    def first(self, inside: np.ndarray, below: np.ndarray, start: int = 0, step: int = 64) -> np.ndarray:
        """Of each the first cut from `start` on that parts the rows `inside` into `below` and the others; -1 where none does."""
        out, other, left, step = np.full(len(inside), -1, np.int64), inside ^ below, np.arange(len(inside)), max(step, 64)
        while len(left) and start < len(self.codes):
            part, still = self.codes[start : start + step], []
            many = max(1, 2 * self.CELLS // len(part))
            for i in range(0, len(left), many):
                q = left[i : i + many]
                x = part & inside[q, None]
                hit = x == below[q, None]
                hit |= x == other[q, None]
                at = hit.argmax(1)
                found = hit[np.arange(len(q)), at]
                out[q[found]] = start + at[found]
                still.append(q[~found])
            self.compared += len(left) * len(part)
            left, start, step = np.concatenate(still), start + step, min(2 * step, 2 * self.CELLS)
        return out

    def _name(self, at: int, low: int, high: int) -> tuple[int, int]:
        return (int(self.second[at, 0]), int(self.second[at, 1])) if low <= at < high else (int(self.column[at]), int(self.place[at]))

    def _least(self, inside: np.ndarray, below: np.ndarray, at: int, low: int, high: int) -> int:
        """The first cut that parts the rows so, -1 where none does; cuts `low` to `high`, those of the own column, count by their second names; at: what `first` gives."""
        if not low <= at < high:
            return at
        own = self.codes[low:high] & inside
        found = [*(low + np.flatnonzero(((own == below) | (own == inside ^ below)) & (self.second[low:high, 1] >= 0)))]
        found += [p for p in self.first(inside, below, high, 1024) if p >= 0]
        return int(min(found, key=lambda p: self._name(p, low, high), default=-1))

    def best(self, rows: np.ndarray, w: np.ndarray, apart: np.ndarray, squares: np.ndarray, low: np.ndarray, high: np.ndarray, least: int) -> np.ndarray:
        """Of nodes of k rows each the cut of the greatest gain, of equal ones the first, -1 where none gains; low, high: where their own column's cuts are.

        apart: values as differences from the node's mean.  Where these are not all cuts, LEFT where it may be another one."""
        k, total = rows.shape[1], w.sum(1)
        if k > self.MOST:
            return np.array([self._every(*node, least) for node in zip(rows, w, apart, total, squares, low, high, strict=True)], np.int64) if self.whole else np.full(len(rows), LEFT)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain, below = _sums(w[:, :-1] * apart[:, :-1]), _sums(w[:, :-1])  # either side may be the lower one: that without the last row is
            gain *= gain  # what is apart adds up to none
            gain /= below * (total[:, None] - below)
        gain[:, _uneven(k, least)] = -1.0
        equal, bits = EQUAL * squares / total, self.bits[rows]
        inside = np.bitwise_or.reduce(bits, 1)
        out, open_ = np.full(len(rows), -1, np.int64), np.arange(len(rows))
        for _ in range(self.TRIES if self.whole else 1):
            here = gain if len(open_) == len(gain) else gain[open_]
            way = here.argmax(1)
            top = here[np.arange(len(open_)), way]
            ties = np.count_nonzero(here >= (top - equal[open_])[:, None], axis=1)
            some = top > equal[open_]
            open_, way, ties = open_[some], way[some], ties[some]
            at = self.first(inside[open_], _words(bits[open_], way), step=1 << (k - 2))
            for i in np.flatnonzero((at >= 0) & ((ties > 1) | ((at >= low[open_]) & (at < high[open_])))):
                b = open_[i]
                at[i] = self._least(inside[b : b + 1], _words(bits[b : b + 1], way[i : i + 1]), at[i], low[b], high[b])
                if at[i] >= 0 and ties[i] > 1:
                    at[i] = self._tied(bits[b], gain[b], gain[b, way[i]] - equal[b], low[b], high[b])
            out[open_] = at
            gain[open_, way] = -1.0
            open_ = open_[at < 0]
            if not len(open_):
                return out
        for b in open_:
            out[b] = self._looked_up(bits[b], gain[b], equal[b], low[b], high[b]) if self.whole else LEFT
        return out

    def _tied(self, bits: np.ndarray, gain: np.ndarray, from_: float, low: int, high: int) -> int:
        """The first of the cuts in those ways that gain so much."""
        ways = np.flatnonzero(gain >= from_)
        inside, below = np.bitwise_or.reduce(bits)[None], _words(np.broadcast_to(bits, (len(ways), len(bits))), ways)
        if len(ways) > self.TRIES:
            hit = np.zeros(len(self.codes), bool)
            for i in range(0, len(hit), self.CELLS):
                x = self.codes[i : i + self.CELLS] & inside
                hit[i : i + self.CELLS] = np.isin(x, below) | np.isin(x ^ inside, below)
            own = low + np.flatnonzero(hit[low:high] & (self.second[low:high, 1] >= 0))
            hit[low:high] = False
            found = [*own, *([hit.argmax()] if hit.any() else [])]
        else:
            first = self.first(np.broadcast_to(inside, below.shape), below, step=1024)
            found = [p for p in (self._least(inside, b[None], at, low, high) for b, at in zip(below, first, strict=True)) if p >= 0]
        return int(min(found, key=lambda p: self._name(p, low, high)))

    def _looked_up(self, bits: np.ndarray, gain: np.ndarray, equal: float, low: int, high: int) -> int:
        """The same as `best` from a table that has of all ways to part the rows the first cut that does so."""
        codes = np.zeros(len(self.codes), np.int32)
        for i in range(0, len(self.bits), self.CHUNK):
            chunk = self.bits[i : i + self.CHUNK][::-1]
            values = np.where(np.isin(chunk, bits), 1 << np.searchsorted(-bits.astype(np.int64), -chunk.astype(np.int64)), 0).astype(np.int32)
            codes += subset_sums(values).take((self.codes // chunk[0]) & ((1 << len(chunk)) - 1))
        self.compared += len(codes)
        codes = np.where(codes >= len(gain), 2 * len(gain) - 1 - codes, codes)
        table = np.full(len(gain), NONE, np.int64)
        for part in (slice(high, None), slice(0, low)):  # of equal ones the last to be written is the first
            table[codes[part][::-1]] = np.arange(len(codes))[part][::-1]
        for p in low + np.flatnonzero(self.second[low:high, 1] >= 0):
            if table[codes[p]] == NONE or self._name(p, low, high) < self._name(table[codes[p]], low, high):
                table[codes[p]] = p
        gain = np.where(table == NONE, -1.0, gain)
        found = gain.max()
        return int(min(table[gain >= found - equal], key=lambda p: self._name(p, low, high))) if found > equal else -1

    def _every(self, rows: np.ndarray, w: np.ndarray, apart: np.ndarray, total: float, squares: float, low: int, high: int, least: int) -> int:
        """The same as `best` of many rows: the gains of all cuts."""
        gain, of = np.zeros(len(self.codes)), np.stack([w * apart, w, np.ones(len(rows))], 1)
        for i in range(0, len(gain), self.CELLS):
            s, below, n = (((self.codes[i : i + self.CELLS, None] & self.bits[rows]) > 0).astype(float) @ of).T
            with np.errstate(divide="ignore", invalid="ignore"):
                gain[i : i + self.CELLS] = np.where((n < least) | (len(rows) - n < least), 0.0, s**2 / (below * (total - below)))
        self.compared += len(gain)
        gain[low:high][self.second[low:high, 1] < 0] = 0.0
        found, equal = gain.max(initial=0.0), EQUAL * squares / total
        alike = np.flatnonzero(gain >= found - equal)
        return int(min(alike, key=lambda p: self._name(p, low, high))) if found > equal else -1


@cache
def _subsets(k: int) -> np.ndarray:
    return ((np.arange(1 << k) >> np.arange(k)[:, None]) & 1).astype(float)


def _sums(values: np.ndarray) -> np.ndarray:
    """Of each row the sums of all subsets of its values."""
    half = values.shape[1] // 2
    low, high = values[:, :half] @ _subsets(half), values[:, half:] @ _subsets(values.shape[1] - half)
    return (high[:, :, None] + low[:, None, :]).reshape(len(values), -1)


@cache
def _uneven(k: int, least: int) -> np.ndarray:
    """Of the ways to part k rows those that leave less than `least` on a side."""
    n = np.bitwise_count(np.arange(1 << (k - 1)))
    return np.flatnonzero((n < least) | (k - n < least))


def _words(bits: np.ndarray, way: np.ndarray) -> np.ndarray:
    return np.bitwise_or.reduce(np.where((way[:, None] >> np.arange(bits.shape[1])) & 1, bits, 0), 1).astype(bits.dtype)


def _chosen(cuts: Partings, inside: np.ndarray, weights: np.ndarray, y: np.ndarray, low: np.ndarray, high: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of nodes the cut that is best, as `best` says, their weighted mean and squares; inside: their rows that have a weight."""
    here = cuts.rows(inside)
    w = np.where(here, weights, 0.0)
    mean, at = (w * y).sum(1) / w.sum(1), np.full(len(inside), -1, np.int64)
    apart, k = y - mean[:, None], here.sum(1)
    squares = (w * apart**2).sum(1)
    some = (k >= 2 * least) & (squares > 1e-24 * (w * y**2).sum(1))  # not all the same
    for size in np.unique(k[some]):
        of, many = np.flatnonzero(some & (k == size)), max(1, cuts.CELLS >> min(int(size) - 1, cuts.MOST))
        for i in range(0, len(of), many):
            b = of[i : i + many]
            rows = np.nonzero(here[b])[1].reshape(len(b), size)
            at[b] = cuts.best(rows, *(np.take_along_axis(x[b], rows, 1) for x in (w, apart)), squares[b], low[b], high[b], least)
    return at, mean, squares


def completed(cuts: Partings, own: np.ndarray, y: np.ndarray, trees: int, seeds: list[list[int]], least: int = 2) -> np.ndarray:
    """y with what forests tell of the rows where it is not known; row by row a target, cut by all columns but its own.

    The trees are those of RegressionForest, all targets' grown by one level at a time; nodes without rows that are asked for are not cut further.
    Targets of which a node is LEFT keep their gaps."""
    values, n = np.where(np.isnan(y), 0.0, y), y.shape[1]
    weights = np.concatenate([np.zeros((0, n)), *(RegressionForest(v, trees, s, least).weights for v, s in zip(y, seeds, strict=True))])
    word = lambda rows: np.bitwise_or.reduce(np.where(rows, cuts.bits, np.uint32(0)), 1)
    asked, (low, high) = word(np.isnan(y)), cuts.own(own)
    told, left, tree = np.zeros(weights.shape), np.zeros(len(y), bool), np.arange(len(weights))
    inside, all_ = word(weights > 0), word(np.ones(weights.shape, bool))
    while len(tree):
        target = tree // trees
        at, mean, _ = _chosen(cuts, inside, weights[tree], values[target], low[target], high[target], least)
        left[target[at == LEFT]] = True
        leaf = (at == -1) & ~left[target]
        i, row = np.nonzero(cuts.rows(all_[leaf]))
        told[tree[leaf][i], row] = mean[leaf][i]
        cut = (at >= 0) & ~left[target]
        tree, inside, all_, below = np.tile(tree[cut], 2), np.tile(inside[cut], 2), np.tile(all_[cut], 2), cuts.codes[at[cut]]
        side = np.concatenate([below, ~below])
        more = (all_ & side & asked[tree // trees]) > 0
        tree, inside, all_ = tree[more], (inside & side)[more], (all_ & side)[more]
    told = told.reshape(len(y), trees, n).mean(1)
    told[left] = np.nan
    return np.where(np.isnan(y), told, y)


def searched(cuts: Partings, forest: RegressionForest, own: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What forest.search gives: of each open node the best gain, the rows below that cut, and its (column, place)."""
    tree, node = forest.nodes()
    w = np.where(forest.place[tree] == node[:, None], forest.weights[tree], 0.0)
    inside = np.bitwise_or.reduce(np.where(w > 0, cuts.bits, np.uint32(0)), 1)
    low, high = (np.full(len(tree), x) for x in cuts.own(own))
    at, mean, squares = _chosen(cuts, inside, forest.weights[tree], np.broadcast_to(forest.y, w.shape), low, high, forest.least)
    if not len(cuts.codes):
        return np.zeros(len(tree)), np.zeros(w.shape, bool), np.full((len(tree), 2), -1)
    below = cuts.rows(cuts.codes[at])
    s, n, total = (w * (forest.y - mean[:, None]) * below).sum(1), (w * below).sum(1), w.sum(1)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(at >= 0, s**2 * (1 / n + 1 / (total - n)) / squares, 0.0)
    named = np.where(((at >= low) & (at < high))[:, None], cuts.second[at], np.stack([cuts.column[at], cuts.place[at]], 1))
    return gain, below, named
