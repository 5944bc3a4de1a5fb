"""Gradient-boosted trees for two classes, with calibrated probabilities."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


@dataclass(frozen=True)
class BoostedTrees:
    """Complete trees of one depth. In node i a row goes to 2 i + 1, or to 2 i + 2 if its feature is above the cut."""

    features: np.ndarray  # (trees, inner nodes)
    cuts: np.ndarray
    values: np.ndarray  # (trees, leaves)
    base: float
    slope: float = 1.0
    offset: float = 0.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        rows, inner = np.arange(len(x)), self.features.shape[1]
        total = np.full(len(x), self.base)
        for feature, cut, value in zip(self.features, self.cuts, self.values, strict=True):
            node = np.zeros(len(x), np.int64)
            while len(node) and node[0] < inner:
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            total += value[node - inner]
        return total

    def chance(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.slope * self.raw(x) + self.offset)


#: Bins of a feature at most, and the grain of gradients: sums of multiples of it are exact, whatever their order.
BINS = 32
_GRAIN = float(1 << 24)

#: Trees over bins: features, cuts as bin numbers (255: everything goes left) and values of the leaves.
BinnedTree = tuple[np.ndarray, np.ndarray, np.ndarray]


def bin_edges(histograms: np.ndarray, bins: int = BINS) -> list[np.ndarray]:
    """The lower quantiles of features that hold whole numbers from 0, from how often each number occurs (features x numbers)."""
    edges = []
    for counts in histograms:
        until = np.cumsum(counts)
        at = np.floor(np.linspace(0, 1, bins)[1:-1] * (until[-1] - 1))
        edges.append(np.unique(np.searchsorted(until, at, side="right")).astype(float))
    return edges


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], 1).astype(np.uint8)


def _leaf(x: np.ndarray, features: np.ndarray, cuts: np.ndarray, levels: int) -> np.ndarray:
    rows, node = np.arange(len(x)), np.zeros(len(x), np.int64)
    for _ in range(levels):
        node = 2 * node + 1 + (x[rows, features[node]] > cuts[node])
    return node


def add_trees(x: np.ndarray, score: np.ndarray, trees: list[BinnedTree]) -> np.ndarray:
    """Scores with the values that trees give to binned rows."""
    for features, cuts, values in trees:
        score = score + values[_leaf(x, features, cuts, (len(cuts) + 1).bit_length() - 1) - len(cuts)]
    return score


def _gradients(x: np.ndarray, y: np.ndarray, weight: np.ndarray, score: np.ndarray, trees: list[BinnedTree], tree: BinnedTree, level: int) -> np.ndarray:
    """Sums of first and second derivatives by node of a level, feature and bin."""
    p = _sigmoid(add_trees(x, score, trees))
    sums = [np.round(v * _GRAIN) / _GRAIN * weight for v in (p - y, np.maximum(p * (1 - p), 1e-9))]
    count = 1 << level
    at = (_leaf(x, tree[0], tree[1], level) - (count - 1)) * BINS
    cells = [at + x[:, f] for f in range(x.shape[1])]
    return np.stack([np.stack([np.bincount(c, v, count * BINS) for c in cells]) for v in sums]).ravel()


def grow_trees(over, keep, edges: list[np.ndarray], base: float, rounds: int = 60, depth: int = 4, rate: float = 0.2, ridge: float = 1.0, every: int = 10) -> tuple[BoostedTrees, list[BinnedTree]]:
    """Trees that lower the logistic loss step by step; each split has the greatest gain by sums of gradients per bin.

    `over` applies a function of (binned rows, labels, weights, scores) to all blocks of rows and adds up the arrays it returns, whose size
    does not depend on the rows: one pass a level. After `every` rounds `keep` is given the trees since, to store their scores.
    """
    width, inner = len(edges), (1 << depth) - 1
    grown: list[BinnedTree] = []
    since: list[BinnedTree] = []
    for t in range(rounds):
        tree = (np.zeros(inner, np.int64), np.full(inner, 255, np.int64), np.zeros(inner + 1))
        for level in range(depth):
            count = 1 << level
            sums = over(lambda x, y, w, s, level=level, tree=tree, since=tuple(since): _gradients(x, y, w, s, since, tree, level)).reshape(2, width, count, BINS)
            whole = sums[:, 0].sum(2)
            best, taken = np.zeros(count), whole.copy()  # without a split all rows go left
            for f in range(width):
                left = sums[:, f, :, : len(edges[f])].cumsum(2)
                if not left.shape[2]:
                    continue
                right = whole[:, :, None] - left
                gain = left[0] ** 2 / (left[1] + ridge) + right[0] ** 2 / (right[1] + ridge) - (whole[0] ** 2 / (whole[1] + ridge))[:, None]
                cut = gain.argmax(1)
                found = gain[np.arange(count), cut]
                better = found > best + 1e-9
                best = np.where(better, found, best)
                where = count - 1 + np.flatnonzero(better)
                tree[0][where], tree[1][where] = f, cut[better]
                taken[:, better] = left[:, better, cut[better]]
        first, second = np.stack([taken, whole - taken], 2).reshape(2, -1)
        tree[2][:] = -rate * first / (second + ridge)
        grown.append(tree)
        since.append(tree)
        if len(since) == every and t + 1 < rounds:
            keep(since)
            since = []
    real = [np.array([edges[f][c] if c < 255 else np.inf for f, c in zip(features, cuts, strict=True)]) for features, cuts, _ in grown]
    return BoostedTrees(np.stack([tree[0] for tree in grown]), np.stack(real), np.stack([tree[2] for tree in grown]), base), grown


def first_score(right: float, n: float) -> float:
    """The score of all rows before the first tree."""
    return float(np.log((right + 0.5) / (n - right + 0.5)))


def fit_trees(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 4, rate: float = 0.2, ridge: float = 1.0) -> BoostedTrees:
    """Trees fitted to rows in memory, by `grow_trees`."""
    edges = [np.unique(np.quantile(column, np.linspace(0, 1, BINS)[1:-1], method="lower")) for column in x.T]
    base = first_score(y.sum(), len(y))
    rows, score = binned(x, edges), [np.full(len(x), base)]

    def keep(trees: list[BinnedTree]) -> None:
        score[0] = add_trees(rows, score[0], trees)

    return grow_trees(lambda part: part(rows, y, np.ones(len(x)), score[0]), keep, edges, base, rounds, depth, rate, ridge)[0]


def calibrated(model: BoostedTrees, x: np.ndarray, y: np.ndarray, steps: int = 50) -> BoostedTrees:
    """The model with the slope and offset of a logistic curve fitted to its scores of rows that it was not fitted on."""
    return calibrate(model, model.raw(x), y, np.ones(len(y)), steps)


def calibrate(model: BoostedTrees, z: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 50) -> BoostedTrees:
    """The same from scores, labels and how many rows have them."""
    n1 = (y * weight).sum()
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (weight.sum() - n1 + 2))
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = _sigmoid(a * z + b)
        w = np.maximum(p * (1 - p), 1e-9) * weight
        hessian = np.array([[(w * z * z).sum() + 1e-3, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-3]])
        change = np.linalg.solve(hessian, [(weight * (p - target) * z).sum() + 1e-3 * (a - 1), (weight * (p - target)).sum()])
        change *= min(1.0, 1.0 / max(1e-12, np.abs(change).max()))
        a, b = a - change[0], b - change[1]
    return BoostedTrees(model.features, model.cuts, model.values, model.base, float(max(a, 1e-3)), float(b))


def threshold(chance: np.ndarray, y: np.ndarray, precision: float, least: float = 0.5, weight: np.ndarray | None = None) -> float:
    """A cut of `least` or more above which rows are right as often as asked: halfway from the least such chance to the next one
    below it. Above 1 if there is none."""
    order = np.argsort(-chance, kind="stable")
    n = np.ones(len(y)) if weight is None else weight[order]
    p, right = chance[order], np.cumsum(y[order] * n) / np.cumsum(n)
    last = np.concatenate([p[1:] != p[:-1], [True]])[: len(p)]  # equal chances stand or fall together
    good = np.flatnonzero(last & (right >= precision) & (p >= least))
    if not len(good):
        return 1.01
    below = p[good[-1] + 1] if good[-1] + 1 < len(p) else 0.0
    return float(max(least, (p[good[-1]] + below) / 2))
