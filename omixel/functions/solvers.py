"""Small dense models in numpy: penalised logistic regression, trees, shrinkage covariance.  Used inside Arrow tasks."""

from __future__ import annotations

import numpy as np


def standardise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(scaled, means, deviations): population deviation, 1 where it is 0."""
    mean, deviation = x.mean(0), x.std(0)
    deviation = np.where(deviation > 0, deviation, 1.0)
    return (x - mean) / deviation, mean, deviation


def balanced_weights(y: np.ndarray) -> np.ndarray:
    n1 = max(1, int(y.sum()))
    n0 = max(1, len(y) - int(y.sum()))
    return np.where(y == 1, len(y) / (2 * n1), len(y) / (2 * n0))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def logistic_l2(x: np.ndarray, y: np.ndarray, c: float, start: np.ndarray | None = None, rounds: int = 50) -> np.ndarray:
    """Coefficients, intercept last, of C * sum(w loss) + |coef|^2 / 2 by Newton's method with halved steps."""
    z = np.hstack([x, np.ones((len(x), 1))])
    w, penalty = balanced_weights(y), np.append(np.ones(x.shape[1]), 0.0)
    b = np.zeros(z.shape[1]) if start is None else start.copy()

    def loss(v: np.ndarray) -> float:
        m = z @ v
        return c * float(w @ (np.logaddexp(0, m) - y * m)) + 0.5 * float(penalty @ v**2)

    now = loss(b)
    for _ in range(rounds):
        p = sigmoid(z @ b)
        gradient = c * z.T @ (w * (p - y)) + penalty * b
        hessian = c * (z.T * (w * p * (1 - p))) @ z + np.diag(penalty + 1e-10)
        step, t = np.linalg.solve(hessian, gradient), 1.0
        while t > 1e-8 and loss(b - t * step) > now:
            t /= 2
        b = b - t * step
        before, now = now, loss(b)
        if before - now < 1e-10 * max(1.0, abs(now)):
            break
    return b


def logistic_elastic_net(x: np.ndarray, y: np.ndarray, c: float, l1_ratio: float, start: np.ndarray | None = None, rounds: int = 400, tolerance: float = 1e-6) -> np.ndarray:
    """Coefficients, intercept last: C * sum(w loss) + l1_ratio |coef|_1 + (1 - l1_ratio) |coef|^2 / 2, by accelerated proximal steps."""
    n, p = x.shape
    z, w = np.hstack([x, np.ones((n, 1))]), balanced_weights(y)
    scale = 1 / (c * w.sum())
    l1, l2 = np.append(np.full(p, l1_ratio * scale), 0.0), np.append(np.full(p, (1 - l1_ratio) * scale), 0.0)
    w = w / w.sum()
    largest = np.linalg.norm(z * np.sqrt(w)[:, None], 2) ** 2 / 4 + l2.max()
    b = np.zeros(p + 1) if start is None else start.copy()
    ahead, t = b.copy(), 1.0
    for _ in range(rounds):
        gradient = z.T @ (w * (sigmoid(z @ ahead) - y)) + l2 * ahead
        moved = ahead - gradient / largest
        new = np.sign(moved) * np.maximum(np.abs(moved) - l1 / largest, 0)
        if (ahead - new) @ (new - b) > 0:
            t = 1.0
        following = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead = new + (t - 1) / following * (new - b)
        change = np.abs(new - b).max()
        b, t = new, following
        if change < tolerance * max(1.0, np.abs(b).max()):
            break
    return b


def elastic_nets(x: np.ndarray, y: np.ndarray, weights: np.ndarray, c: np.ndarray, l1_ratio: np.ndarray, rounds: int = 1000, tolerance: float = 1e-5) -> np.ndarray:
    """What logistic_elastic_net gives for many problems on one matrix at once: a column of coefficients, intercept last, for each
    column of sample weights (0: left out), C and l1 ratio.  All gradients are two matrix products; columns that have settled leave."""
    n, p = x.shape
    z = np.hstack([x, np.ones((n, 1))])
    total = weights.sum(0)
    scale = 1 / (c * total)
    w = weights / total
    l2 = (1 - l1_ratio) * scale
    groups, of = np.unique(w, axis=1, return_inverse=True)  # one norm for each distinct column of weights
    norms = np.array([np.linalg.norm(z * np.sqrt(g)[:, None], 2) ** 2 / 4 for g in groups.T])
    step = 1 / (norms[of.ravel()] + l2)
    out = np.zeros((p + 1, len(c)))
    active = np.arange(len(c))
    b, ahead, t = out.copy(), out.copy(), np.ones(len(c))
    penalised = np.append(np.ones(p), 0.0)[:, None]
    wa, l1a, l2a, sa = w, penalised * (l1_ratio * scale * step), penalised * l2, step
    wy = wa * y[:, None]
    zt = np.ascontiguousarray(z.T)
    for i in range(rounds):
        m = z @ ahead
        np.clip(m, -500, 500, out=m)
        np.exp(-m, out=m)
        m += 1
        gradient = zt @ (wa / m - wy)
        gradient += l2a * ahead
        moved = ahead - gradient * sa
        new = moved - np.clip(moved, -l1a, l1a)
        step_taken = new - b
        t[((ahead - new) * step_taken).sum(0) > 0] = 1.0
        following = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead = new + (t - 1) / following * step_taken
        b, t = new, following
        if i % 10 == 9:
            moving = np.abs(step_taken).max(0) >= tolerance * np.maximum(1.0, np.abs(b).max(0))
            if not moving.all():
                out[:, active[~moving]] = b[:, ~moving]
                active = active[moving]
                b, ahead, t, wa, wy, l1a, l2a, sa = b[:, moving], ahead[:, moving], t[moving], wa[:, moving], wy[:, moving], l1a[:, moving], l2a[:, moving], sa[moving]
                if not len(active):
                    break
    out[:, active] = b
    return out


def cross_validated_elastic_net(x: np.ndarray, y: np.ndarray, l1_ratios: tuple[float, ...], n_cs: int = 10, folds: int = 5) -> np.ndarray:
    """Coefficients, intercept last, at the C and l1 ratio of the best mean held-out area under the ROC curve; all folds' and
    points' fits are one batch.  Raises ValueError where the smaller class has fewer than two members."""
    k = min(folds, int(np.bincount(y.astype(int), minlength=2).min()))
    if k < 2:
        raise ValueError("a class has fewer than two members")
    fold, cs = stratified_folds(y, k), np.logspace(-4, 4, n_cs)
    ratio, c = (g.ravel() for g in np.meshgrid(l1_ratios, cs, indexing="ij"))
    masks = [fold != f for f in range(k)]
    weights = np.zeros((len(y), k))
    for f, train in enumerate(masks):
        weights[train, f] = balanced_weights(y[train])
    fits = elastic_nets(x, y, np.repeat(weights, len(c), axis=1), np.tile(c, k), np.tile(ratio, k), rounds=400).reshape(x.shape[1] + 1, k, len(c))
    scores = np.zeros((len(c), k))
    for f, train in enumerate(masks):
        margin = x[~train] @ fits[:-1, f] + fits[-1, f]
        ones, zeros = margin[y[~train] == 1][:, None], margin[y[~train] == 0][None]
        scores[:, f] = ((ones > zeros) + 0.5 * (ones == zeros)).mean((0, 1))
    best = int(scores.mean(1).argmax())
    return elastic_nets(x, y, balanced_weights(y)[:, None], c[best : best + 1], ratio[best : best + 1], rounds=5000)[:, 0]


def auc(y: np.ndarray, score: np.ndarray) -> float:
    n1 = int(y.sum())
    n0 = len(y) - n1
    if not n1 or not n0:
        return float("nan")
    order = np.argsort(score, kind="stable")
    s, ranks = score[order], np.arange(1, len(y) + 1, dtype=float)
    edges = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
    stops = np.append(edges[1:], len(s))
    ranks = np.repeat((edges + 1 + stops) / 2.0, stops - edges)
    return float((ranks[y[order] == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0))


def kappa(y: np.ndarray, predicted: np.ndarray) -> float:
    agree = float((y == predicted).mean())
    chance = float(y.mean() * predicted.mean() + (1 - y.mean()) * (1 - predicted.mean()))
    return (agree - chance) / (1 - chance) if chance < 1 else float("nan")


def stratified_folds(y: np.ndarray, k: int) -> np.ndarray:
    """A fold for each item; each class is dealt out in turn, in order."""
    fold = np.zeros(len(y), int)
    for label in (0, 1):
        at = np.flatnonzero(y == label)
        fold[at] = np.arange(len(at)) % k
    return fold


def cross_validated(x: np.ndarray, y: np.ndarray, l1_ratios: tuple[float, ...] = (), n_cs: int = 10, folds: int = 5, scoring: str = "accuracy") -> tuple[np.ndarray, float, float]:
    """(coefficients, C, l1 ratio) of the point with the best mean held-out score, refitted on all; L2 where no ratios are given.

    Raises ValueError where the smaller class has fewer than two members, as no folds can then hold both."""
    k = min(folds, int(np.bincount(y.astype(int), minlength=2).min()))
    if k < 2:
        raise ValueError("a class has fewer than two members")
    fold, cs = stratified_folds(y, k), np.logspace(-4, 4, n_cs)
    fit = (lambda a, b, c, r, s: logistic_elastic_net(a, b, c, r, s)) if l1_ratios else (lambda a, b, c, r, s: logistic_l2(a, b, c, s))
    ratios = l1_ratios or (0.0,)
    scores = np.zeros((len(ratios), len(cs), k))
    for f in range(k):
        train = fold != f
        for i, r in enumerate(ratios):
            b = None
            for j, c in enumerate(cs):  # from strong to weak penalty, each from the last
                b = fit(x[train], y[train], c, r, b)
                margin = x[~train] @ b[:-1] + b[-1]
                scores[i, j, f] = auc(y[~train], margin) if scoring == "roc_auc" else ((margin > 0) == (y[~train] == 1)).mean()
    i, j = np.unravel_index(np.nanmean(scores, 2).argmax(), scores.shape[:2])
    b = None
    for c in cs[: j + 1]:
        b = fit(x, y, c, ratios[i], b)
    return b, float(cs[j]), float(ratios[i])


class Forest:
    """Classification trees on bootstraps with random feature subsets and balanced class weights."""

    def __init__(self, n_trees: int = 200, depth: int = 3, seed: int = 42):
        self.n_trees, self.depth, self.seed, self.trees = n_trees, depth, seed, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Forest:
        rng, w = np.random.default_rng(self.seed), balanced_weights(y)
        features = max(1, int(np.sqrt(x.shape[1])))
        for _ in range(self.n_trees):
            weight = w * np.bincount(rng.integers(0, len(y), len(y)), minlength=len(y))
            self.trees.append(self._grow(x, y, weight, self.depth, features, rng))
        return self

    def _grow(self, x, y, w, depth, features, rng):
        total, ones = w.sum(), (w * y).sum()
        share = ones / total if total else 0.5
        if not depth or not 0 < share < 1:
            return share
        best = (1e-12, None, None)
        parent = total * share * (1 - share)
        for f in rng.permutation(x.shape[1])[:features]:
            order = np.argsort(x[:, f], kind="stable")
            order = order[w[order] > 0]
            v = x[order, f]
            cw, c1 = np.cumsum(w[order])[:-1], np.cumsum((w * y)[order])[:-1]
            ok = np.flatnonzero(v[1:] > v[:-1])
            if len(ok):
                a, a1 = cw[ok], c1[ok]
                b, b1 = total - a, ones - a1
                gain = parent - a1 * (1 - a1 / a) - b1 * (1 - b1 / b)
                i = int(gain.argmax())
                if gain[i] > best[0]:
                    best = (gain[i], f, (v[ok[i]] + v[ok[i] + 1]) / 2)
        _, f, at = best
        if f is None:
            return share
        left = x[:, f] <= at
        return f, at, self._grow(x, y, np.where(left, w, 0), depth - 1, features, rng), self._grow(x, y, np.where(left, 0, w), depth - 1, features, rng)

    def probability(self, x: np.ndarray) -> np.ndarray:
        def walk(tree, rows: np.ndarray) -> np.ndarray:
            if not isinstance(tree, tuple):
                return np.full(len(rows), tree)
            f, at, low, high = tree
            left = x[rows, f] <= at
            out = np.empty(len(rows))
            out[left], out[~left] = walk(low, rows[left]), walk(high, rows[~left])
            return out

        return np.mean([walk(t, np.arange(len(x))) for t in self.trees], 0)


#: gains that differ by less are equal
EQUAL = 1e-9


class Cuts:
    """Where columns can be cut in two: for each cut its column and which rows lie below, in order of columns and of values in them.

    A column has a cut between any two neighbouring values; of more than `bins` those at evenly spaced ranks.  A cut of `distinct` may have a
    second column that cuts the rows in the same way; it counts where the first one is left out."""

    #: rows with a weight up to which a tree's cuts are a table of all ways to part them
    MOST = 18
    CHUNK = 13

    def __init__(self, x: np.ndarray, bins: int = 255):
        n = len(x)
        order = np.argsort(x, 0, kind="stable")
        rank = np.empty_like(order)
        np.put_along_axis(rank, order, np.broadcast_to(np.arange(n)[:, None], x.shape), 0)
        v = np.take_along_axis(x, order, 0)
        column, below = [], []
        for f in range(x.shape[1]):
            at = np.flatnonzero(v[1:, f] > v[:-1, f]) + 1
            if len(at) > bins:
                at = at[np.linspace(0, len(at) - 1, bins).astype(int)]
            column.append(np.full(len(at), f))
            below.append(rank[:, f] < at[:, None])
        column = np.concatenate(column) if column else np.zeros(0, int)
        first = np.stack([column, np.arange(len(column))], 1)
        self._order(np.concatenate(below) if below else np.zeros((0, n), bool), first, np.full_like(first, -1))

    @classmethod
    def distinct(cls, below: np.ndarray, first: np.ndarray, second: np.ndarray) -> Cuts:
        """Of cuts of which no two part the rows in the same way; first, second: (column, place in it), the second (-1, -1) where there is none."""
        out = cls.__new__(cls)
        order = np.lexsort(first.T[::-1])
        out._order(below[order], first[order], second[order])
        return out

    def _order(self, below: np.ndarray, first: np.ndarray, second: np.ndarray) -> None:
        self.below, self.column = below, first[:, 0]
        k = np.flatnonzero(second[:, 1] >= 0)
        both, cut = np.concatenate([first, second[k]]), np.concatenate([np.arange(len(first)), k])
        order = np.lexsort(both.T[::-1])
        #: by rank: (column, place) and the cut; of cuts: their first and second rank
        self.named, self.cut = both[order], cut[order]
        rank = np.empty(len(both), np.int64)
        rank[order] = np.arange(len(both))
        self.first, self.second = rank[: len(first)].astype(np.int32), np.full(len(first), -1, np.int32)
        self.second[k] = rank[len(first) :]
        self.chunks = [below[:, i : i + self.CHUNK] @ (1 << np.arange(below[:, i : i + self.CHUNK].shape[1])) for i in range(0, below.shape[1], self.CHUNK)]

    def ranks(self, own: int) -> np.ndarray:
        """The ranks that count where column `own` is left out, in order."""
        low, high = np.searchsorted(self.column, [own, own + 1])
        more = self.second[low:high]
        return np.sort(np.concatenate([self.first[:low], self.first[high:], more[more >= 0]]))

    def table(self, rows: np.ndarray, own: int) -> np.ndarray:
        """Of each way to part `rows` (a bit for each) the least rank of a cut that does so, whichever side is below; NONE where there is none."""
        codes = np.zeros(len(self.below), np.int64)
        for i, chunk in enumerate(self.chunks):
            bits = np.zeros(min(self.CHUNK, self.below.shape[1] - i * self.CHUNK), np.int64)
            here = (rows >= i * self.CHUNK) & (rows < i * self.CHUNK + len(bits))
            bits[rows[here] - i * self.CHUNK] = 1 << np.flatnonzero(here)
            if here.any():
                codes += subset_sums(bits).take(chunk)
        low, high = np.searchsorted(self.column, [own, own + 1])
        out = np.full(1 << len(rows), NONE, np.int32)
        for part in (slice(high, None), slice(0, low)):  # of equal ones the last to be written is the least
            out[codes[part][::-1]] = self.first[part][::-1]
        more = np.flatnonzero(self.second[low:high] >= 0) + low
        np.minimum.at(out, codes[more], self.second[more])
        return np.minimum(out, out[::-1])


#: no cut
NONE = np.iinfo(np.int32).max


def subset_sums(values: np.ndarray) -> np.ndarray:
    """The sum of each subset, a bit for each value."""
    out = np.zeros(1, values.dtype)
    for v in values:
        out = np.concatenate([out, out + v])
    return out


def narrowed(table: np.ndarray, kept: np.ndarray) -> np.ndarray:
    """The table of those bits that are kept: the least over the others."""
    for bit in np.flatnonzero(~kept)[::-1]:
        halves = table.reshape(-1, 2, 1 << bit)
        table = np.minimum(halves[:, 0], halves[:, 1]).ravel()
    return table


class RegressionForest:
    """Regression trees on bootstraps of the rows where y is known, all grown by one level at a time; no bound on depth.

    place: of each tree and row the node it is in; ~node where the node is a leaf.  A bootstrap is a weight of each row; a leaf has `least` rows of it."""

    STRIP = 1024

    def __init__(self, y: np.ndarray, trees: int, seed: list[int], least: int = 2, place: np.ndarray | None = None):
        self.known, self.least = ~np.isnan(y), least
        self.y, n = np.where(self.known, y, 0.0), int(self.known.sum())
        self.weights = np.zeros((trees, len(y)))
        self.weights[:, self.known] = np.random.default_rng(seed).multinomial(n, np.full(n, 1 / n), trees)
        self.place = np.zeros((trees, len(y)), np.int32) if place is None else place.reshape(trees, len(y)).copy()

    def nodes(self) -> tuple[np.ndarray, np.ndarray]:
        """(tree, node) of the nodes that are no leaves yet, in order."""
        tree, row = np.nonzero(self.place >= 0)
        width = int(self.place.max(initial=0)) + 1
        return np.divmod(np.unique(tree * width + self.place[tree, row]), width)

    def search(self, cuts: Cuts, own: int = -1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each open node the best gain, as a share of its squares that the cut explains (0: none), the rows below that cut, and its (column, place); of equal ones the first.

        Column `own` is left out."""
        tree, node = self.nodes()
        best, rank = np.zeros(len(tree)), np.full(len(tree), -1)
        small = (self.weights > 0).sum(1) <= cuts.MOST
        for t in np.unique(tree[small[tree]]):
            rows = np.flatnonzero(self.weights[t] > 0)
            table = cuts.table(rows, own)
            for k in np.flatnonzero(tree == t):
                here = self.place[t, rows] == node[k]
                best[k], rank[k] = self._best(t, rows[here], narrowed(table, here))
        large = np.flatnonzero(~small[tree])
        if len(large):
            best[large], rank[large] = self._scanned(tree[large], node[large], cuts, cuts.ranks(own))
        if not len(cuts.cut):
            return best, np.zeros((len(tree), len(self.y)), bool), np.full((len(tree), 2), -1)
        return best, cuts.below[cuts.cut[rank]], cuts.named[rank]

    def _best(self, tree: int, rows: np.ndarray, table: np.ndarray) -> tuple[float, int]:
        """Gain and rank of the best of all ways to part the rows that a cut makes."""
        n, half = len(rows), len(table) // 2  # either side may be the lower one
        if n < 2 * self.least or half < 2:
            return 0.0, -1
        w, y = self.weights[tree, rows], self.y[rows]
        apart = y - y @ w / w.sum()
        squares = w @ apart**2
        if squares <= 1e-24 * (w @ y**2):
            return 0.0, -1  # all the same
        w_low, s_low, n_low = (subset_sums(v)[1:half] for v in (w, w * apart, np.ones(n, np.int64)))
        gain = s_low**2 * (1 / w_low + 1 / (w.sum() - w_low)) / squares  # what is apart adds up to none
        gain[(n_low < self.least) | (n - n_low < self.least) | (table[1:half] == NONE)] = 0.0
        found = gain.max()
        return (float(found), int(table[1:half][gain >= found - EQUAL].min())) if found > EQUAL else (0.0, -1)

    def _scanned(self, tree: np.ndarray, node: np.ndarray, cuts: Cuts, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gains and ranks of the best cuts, of many rows: all cuts in turn."""
        inside = (self.place[tree] == node[:, None]) & (self.weights[tree] > 0)
        w = np.where(inside, self.weights[tree], 0.0).T
        count, total = inside.T.astype(float), w.sum(0)
        rows, apart = count.sum(0), self.y[:, None] - self.y @ w / total
        s, squares = w * apart, (w * apart**2).sum(0)
        squares[squares <= 1e-24 * (self.y**2 @ w)] = np.inf  # all the same
        best, at = np.zeros(len(tree)), np.full(len(tree), -1)
        for i in range(0, len(ranks), self.STRIP):
            strip = ranks[i : i + self.STRIP]
            low = cuts.below[cuts.cut[strip]].astype(float)
            n_low, w_low, s_low = low @ count, low @ w, low @ s
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = s_low**2 * (1 / w_low + 1 / (total - w_low)) / squares  # what is apart adds up to none
            gain[(n_low < self.least) | (rows - n_low < self.least)] = 0.0
            found = gain.max(0)
            top = (gain >= found - EQUAL).argmax(0)
            better = found > best + EQUAL
            best[better], at[better] = found[better], strip[top[better]]
        return best, at

    def cut(self, gain: np.ndarray, below: np.ndarray) -> None:
        """Cut the open nodes; those without a gain become leaves."""
        tree, node = self.nodes()
        here = self.place[tree] == node[:, None]
        fresh = int(np.where(self.place < 0, ~self.place, self.place).max(initial=0)) + 1
        low = fresh + 2 * np.arange(len(tree), dtype=np.int32)
        to = np.where(gain[:, None] > 0, np.where(below, low[:, None], low[:, None] + 1), ~node[:, None])
        k, row = np.nonzero(here)
        self.place[tree[k], row] = to[k, row]

    def grow(self, cuts: Cuts, own: int = -1) -> None:
        """Whole trees: one with few weighted rows node by node, its table narrowed on the way, the others level by level."""
        for t in np.flatnonzero((self.weights > 0).sum(1) <= cuts.MOST):
            rows, leaf = np.flatnonzero(self.weights[t] > 0), 0
            open_ = [(rows, cuts.table(rows, own), np.arange(len(self.y)))]
            while open_:
                rows, table, all_ = open_.pop()
                rank = self._best(t, rows, table)[1] if len(rows) >= 2 * self.least else -1
                if rank < 0:
                    self.place[t, all_] = ~leaf
                    leaf += 1
                    continue
                below = cuts.below[cuts.cut[rank]]
                for side in (below, ~below):
                    part = rows[side[rows]]
                    open_.append((part, narrowed(table, side[rows]) if len(part) >= 2 * self.least else None, all_[side[all_]]))
        while (self.place >= 0).any():
            self.cut(*self.search(cuts, own)[:2])

    def values(self) -> np.ndarray:
        """The mean over trees of the leaf that each row is in."""
        out = np.zeros(len(self.y))
        for place, w in zip(~self.place, self.weights, strict=True):
            leaf = np.unique(place, return_inverse=True)[1]
            out += (np.bincount(leaf, w * self.y) / np.bincount(leaf, w))[leaf]
        return out / len(self.place)


def ledoit_wolf(x: np.ndarray) -> tuple[np.ndarray, float]:
    """(covariance shrunk to a multiple of the identity, shrinkage)."""
    n, p = x.shape
    c = x - x.mean(0)
    s = c.T @ c / n
    mu = np.trace(s) / p
    delta = ((s - mu * np.eye(p)) ** 2).sum() / p
    beta = min(delta, float(((c**2).T @ (c**2) / n - s**2).sum()) / n / p)
    shrinkage = beta / delta if delta > 0 else 0.0
    return (1 - shrinkage) * s + shrinkage * mu * np.eye(p), float(shrinkage)
