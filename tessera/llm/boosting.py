"""Gradient-boosted trees for log-loss over histograms, and isotonic calibration, in numpy."""

from __future__ import annotations

import numpy as np

BINS = 64


class BoostedTrees:
    """Complete binary trees of a fixed depth: ``feature`` and ``cut`` by node, ``leaf`` values by tree."""

    def __init__(self, trees: int = 150, depth: int = 3, rate: float = 0.15, min_rows: int = 4, l2: float = 1.0):
        self.trees, self.depth, self.rate, self.min_rows, self.l2 = trees, depth, rate, min_rows, l2

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        n, width = x.shape
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS)[1:-1])) if n else np.zeros(0) for j in range(width)]
        binned = np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)], axis=1) if n else np.zeros((0, width), int)
        prior = min(max(y.mean() if n else 0.0, 1e-3), 1 - 1e-3)
        self.base = float(np.log(prior / (1 - prior)))
        inner = (1 << self.depth) - 1
        self.feature, self.cut, self.leaf = np.zeros((self.trees, inner), int), np.full((self.trees, inner), BINS), np.zeros((self.trees, inner + 1))
        margin = np.full(n, self.base)
        for t in range(self.trees if n else 0):
            p = 1 / (1 + np.exp(-margin))
            grad, hess = p - y, np.maximum(p * (1 - p), 1e-6)
            node = np.zeros(n, int)
            for level in range(self.depth):
                first, count = (1 << level) - 1, 1 << level
                best = np.full(count, 1e-9)
                for j in range(width):
                    at = node * (BINS + 1) + binned[:, j]
                    g, h, c = (np.bincount(at, w, count * (BINS + 1)).reshape(count, -1) for w in (grad, hess, None))
                    gl, hl, cl = g.cumsum(1)[:, :-1], h.cumsum(1)[:, :-1], c.cumsum(1)[:, :-1]
                    ga, ha, ca = g.sum(1)[:, None], h.sum(1)[:, None], c.sum(1)[:, None]
                    gain = gl**2 / (hl + self.l2) + (ga - gl) ** 2 / (ha - hl + self.l2) - ga**2 / (ha + self.l2)
                    gain[(cl < self.min_rows) | (ca - cl < self.min_rows)] = 0
                    top = gain.argmax(1)
                    for k in np.flatnonzero(gain[np.arange(count), top] > best):
                        best[k] = gain[k, top[k]]
                        self.feature[t, first + k], self.cut[t, first + k] = j, top[k]
                node = 2 * node + (binned[np.arange(n), self.feature[t, first + node]] > self.cut[t, first + node])
            g, h = np.bincount(node, grad, inner + 1), np.bincount(node, hess, inner + 1)
            self.leaf[t] = -self.rate * g / (h + self.l2)
            margin += self.leaf[t, node]
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        binned = np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)], axis=1)
        rows, out = np.arange(len(x)), np.full(len(x), self.base)
        for t in range(self.trees):
            node = np.zeros(len(x), int)
            for level in range(self.depth):
                at = (1 << level) - 1 + node
                node = 2 * node + (binned[rows, self.feature[t, at]] > self.cut[t, at])
            out += self.leaf[t, node]
        return out


class Isotonic:
    """Non-decreasing least-squares fit by pooling adjacent violators; between the pools' means values are interpolated."""

    def fit(self, x: np.ndarray, y: np.ndarray) -> Isotonic:
        order = np.argsort(x, kind="stable")
        pools: list[list[float]] = []
        for a, b in zip(x[order].tolist(), y[order].tolist(), strict=True):
            pools.append([b, 1.0, a, a])
            while len(pools) > 1 and (pools[-2][0] >= pools[-1][0] or pools[-2][3] == pools[-1][2]):
                v, w, lo, hi = pools.pop()
                u, m, lo0, _ = pools.pop()
                pools.append([(u * m + v * w) / (m + w), m + w, lo0, hi])
        self.x = np.array([e for p in pools for e in (p[2], p[3])])
        self.y = np.array([p[0] for p in pools for _ in (0, 1)])
        return self

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.interp(x, self.x, self.y) if len(self.x) else np.zeros(len(x))
