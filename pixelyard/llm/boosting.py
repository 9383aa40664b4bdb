"""Small models for classifiers that are fitted on a bounded sample: boosted trees, additive
lookup tables with pairs, and isotonic calibration. They run on the driver on at most some tens of
thousands of rows; scoring is vectorised and runs in Spark's tasks."""

from __future__ import annotations

import numpy as np


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def bin_edges(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """Inner edges of about equally filled bins, for each column."""
    return [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1], method="inverted_cdf")) for c in x.T]


def to_bins(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)], 1)


class GradientBoosting:
    """Boosted trees for a 0/1 label with logistic loss; histogram splits, one depth for all leaves."""

    def __init__(self, rounds: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 48, penalty: float = 2.0):
        self.rounds, self.depth, self.rate, self.bins, self.penalty = rounds, depth, rate, bins, penalty

    def fit(self, x: np.ndarray, y: np.ndarray) -> GradientBoosting:
        self.edges = bin_edges(x, self.bins)
        binned, width = to_bins(x, self.edges), self.bins + 1
        base = (y.sum() + 1) / (len(y) + 2)
        self.start = float(np.log(base / (1 - base)))
        f, self.trees = np.full(len(y), self.start), []
        for _ in range(self.rounds):
            p = _sigmoid(f)
            grad, hess = y - p, p * (1 - p)
            node, tree = np.zeros(len(y), np.int64), []
            for level in range(self.depth):
                nodes = 1 << level
                best = np.full(nodes, 1e-6)
                feature, cut = np.zeros(nodes, np.int64), np.full(nodes, width)
                for k in range(binned.shape[1]):
                    cell = node * width + binned[:, k]
                    g = np.bincount(cell, grad, nodes * width).reshape(nodes, width).cumsum(1)
                    h = np.bincount(cell, hess, nodes * width).reshape(nodes, width).cumsum(1)
                    gt, ht = g[:, -1:], h[:, -1:]
                    gain = g**2 / (h + self.penalty) + (gt - g) ** 2 / (ht - h + self.penalty) - gt**2 / (ht + self.penalty)
                    at = gain.argmax(1)
                    got = gain[np.arange(nodes), at]
                    better = got > best
                    best[better], feature[better], cut[better] = got[better], k, at[better]
                tree.append((feature, cut))
                node = 2 * node + (binned[np.arange(len(y)), feature[node]] > cut[node])
            leaves = 1 << self.depth
            values = self.rate * np.bincount(node, grad, leaves) / (np.bincount(node, hess, leaves) + self.penalty)
            f += values[node]
            self.trees.append((tree, values))
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        binned, rows = to_bins(x, self.edges), np.arange(len(x))
        out = np.full(len(x), self.start)
        for tree, values in self.trees:
            node = np.zeros(len(x), np.int64)
            for feature, cut in tree:
                node = 2 * node + (binned[rows, feature[node]] > cut[node])
            out += values[node]
        return out


class Isotonic:
    """A rising map from margins to probabilities: pooled adjacent violators, joined by straight lines."""

    def fit(self, margin: np.ndarray, y: np.ndarray) -> Isotonic:
        blocks: list[list[float]] = []  # margin, share of ones, weight
        for i in np.argsort(margin, kind="stable"):
            blocks.append([float(margin[i]), float(y[i]), 1.0])
            while len(blocks) > 1 and (blocks[-2][1] >= blocks[-1][1] or blocks[-2][0] == blocks[-1][0]):
                m, v, w = blocks.pop()
                last = blocks[-1]
                total = last[2] + w
                blocks[-1] = [(last[0] * last[2] + m * w) / total, (last[1] * last[2] + v * w) / total, total]
        # Shrunk towards one half by one row, so that no margin is taken for certain.
        self.at = np.array([b[0] for b in blocks])
        self.value = np.maximum.accumulate(np.array([(b[1] * b[2] + 0.5) / (b[2] + 1) for b in blocks]))
        return self

    def __call__(self, margin: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(margin, self.at, self.value) + 1e-4 * (_sigmoid(margin) - 0.5), 0.0, 1.0)


def _shallow(grad: np.ndarray, hess: np.ndarray, cuts: int, penalty: float) -> np.ndarray:
    """Step values of a tree of at most ``cuts`` cuts over the ordered bins of one feature."""
    pieces = [(0, len(grad))]
    g, h = np.concatenate([[0.0], grad.cumsum()]), np.concatenate([[0.0], hess.cumsum()])
    for _ in range(cuts):
        best, place = 1e-9, None
        for i, (a, b) in enumerate(pieces):
            if b - a < 2:
                continue
            mid = np.arange(a + 1, b)
            left, right = (g[mid] - g[a]) ** 2 / (h[mid] - h[a] + penalty), (g[b] - g[mid]) ** 2 / (h[b] - h[mid] + penalty)
            gain = left + right - (g[b] - g[a]) ** 2 / (h[b] - h[a] + penalty)
            if gain.max() > best:
                best, place = gain.max(), (i, a, int(mid[gain.argmax()]), b)
        if place is None:
            break
        i, a, m, b = place
        pieces[i : i + 1] = [(a, m), (m, b)]
    out = np.zeros(len(grad))
    for a, b in pieces:
        out[a:b] = (g[b] - g[a]) / (h[b] - h[a] + penalty)
    return out


class AdditiveModel:
    """A generalised additive model with pairwise interactions.

    In each cycle every feature in turn gets one shallow tree on the current residuals, at a low
    rate; the trees add up to a lookup table for each feature. The pairs whose coarse cells still
    explain most of the residuals then get tables of their own in the same way, by alternating
    trees along their two axes within halves. A score is the sum of one lookup for each table.
    """

    def __init__(self, cycles: int = 150, rate: float = 0.1, bins: int = 48, cuts: int = 3, pairs: int = 6, coarse: int = 8, penalty: float = 2.0):
        self.cycles, self.rate, self.bins, self.cuts, self.pairs, self.coarse, self.penalty = cycles, rate, bins, cuts, pairs, coarse, penalty

    def fit(self, x: np.ndarray, y: np.ndarray) -> AdditiveModel:
        self.edges, self.rough = bin_edges(x, self.bins), bin_edges(x, self.coarse)
        binned, rough, width, side = to_bins(x, self.edges), to_bins(x, self.rough), self.bins + 1, self.coarse + 1
        base = (y.sum() + 1) / (len(y) + 2)
        self.start = float(np.log(base / (1 - base)))
        f = np.full(len(y), self.start)
        self.tables = np.zeros((x.shape[1], width))
        for _ in range(self.cycles):
            for k in range(x.shape[1]):
                p = _sigmoid(f)
                step = self.rate * _shallow(np.bincount(binned[:, k], y - p, width), np.bincount(binned[:, k], p * (1 - p), width), self.cuts, self.penalty)
                self.tables[k] += step
                f += step[binned[:, k]]
        p = _sigmoid(f)
        found = []
        for i in range(x.shape[1]):
            for j in range(i + 1, x.shape[1]):
                cell = rough[:, i] * side + rough[:, j]
                g, h = np.bincount(cell, y - p, side * side), np.bincount(cell, p * (1 - p), side * side)
                found.append((-float((g**2 / (h + self.penalty)).sum()), i, j))
        self.chosen = [(i, j) for _, i, j in sorted(found)[: self.pairs]]
        self.grids = np.zeros((len(self.chosen), side, side))
        for _ in range(self.cycles // 3):
            for n, (i, j) in enumerate(self.chosen):
                p = _sigmoid(f)
                cell = rough[:, i] * side + rough[:, j]
                g, h = np.bincount(cell, y - p, side * side).reshape(side, side), np.bincount(cell, p * (1 - p), side * side).reshape(side, side)
                first = _shallow(g.sum(1), h.sum(1), 1, self.penalty)  # one cut along i, then trees along j in both halves
                step = np.zeros((side, side))
                for half in np.unique(first):
                    rows = first == half
                    step[rows] = self.rate * _shallow(g[rows].sum(0), h[rows].sum(0), self.cuts - 1, self.penalty)
                self.grids[n] += step
                f += step.ravel()[cell]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        binned, rough = to_bins(x, self.edges), to_bins(x, self.rough)
        total = np.full(len(x), self.start)
        for k in range(x.shape[1]):
            total += self.tables[k][binned[:, k]]
        for n, (i, j) in enumerate(self.chosen):
            total += self.grids[n][rough[:, i], rough[:, j]]
        return _sigmoid(total)
