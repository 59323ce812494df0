"""Gradient boosted trees for two classes, in numpy, over features cut into at most 32 bins."""

from __future__ import annotations

import numpy as np

BINS = 32


class BoostedTrees:
    """Logistic loss; trees of fixed depth as flat arrays. ``fit`` needs both classes."""

    def __init__(self, rounds: int = 40, depth: int = 3, rate: float = 0.2, least_weight: float = 5.0, ridge: float = 1.0) -> None:
        self.rounds, self.depth, self.rate, self.least_weight, self.ridge = rounds, depth, rate, least_weight, ridge
        self.slope, self.shift = 1.0, 0.0

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], axis=1).astype(np.uint8)

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for j in range(x.shape[1])]
        b = self._binned(x)
        rate = np.clip(y.mean(), 1e-4, 1 - 1e-4)
        self.base = float(np.log(rate / (1 - rate)))
        raw = np.full(len(y), self.base)
        self.trees = []
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-raw))
            tree, step = self._tree(b, p - y, np.maximum(p * (1 - p), 1e-9))
            self.trees.append(tree)
            raw += step
        return self

    def _tree(self, b: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[tuple, np.ndarray]:
        n_nodes = 2 ** (self.depth + 1) - 1
        feature, cut, value = np.full(n_nodes, -1), np.zeros(n_nodes, np.int64), np.zeros(n_nodes)
        node = np.zeros(len(g), np.int64)
        for at in range(n_nodes):
            rows = np.flatnonzero(node == at)
            if not len(rows):
                continue
            gs, hs = g[rows].sum(), h[rows].sum()
            value[at] = -self.rate * gs / (hs + self.ridge)
            if at >= 2**self.depth - 1 or hs < 2 * self.least_weight:
                continue
            best = 1e-6
            for j in range(b.shape[1]):
                gl = np.cumsum(np.bincount(b[rows, j], g[rows], BINS))[:-1]
                hl = np.cumsum(np.bincount(b[rows, j], h[rows], BINS))[:-1]
                gain = gl**2 / (hl + self.ridge) + (gs - gl) ** 2 / (hs - hl + self.ridge) - gs**2 / (hs + self.ridge)
                gain[(hl < self.least_weight) | (hs - hl < self.least_weight)] = 0
                if gain.max() > best:
                    best, feature[at], cut[at] = gain.max(), j, gain.argmax()
            if feature[at] >= 0:
                node[rows] = 2 * at + 1 + (b[rows, feature[at]] > cut[at])
        return (feature, cut, value), value[node]

    def raw(self, x: np.ndarray) -> np.ndarray:
        b, out, rows = self._binned(x), np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f = feature[node]
                node = np.where(f < 0, node, 2 * node + 1 + (b[rows, np.maximum(f, 0)] > cut[node]))
            out += value[node]
        return out

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        """Fit slope and shift of the raw score on held-out rows by Newton steps."""
        s, target = self.raw(x), (y * (y.sum() + 1) / (y.sum() + 2)) + (1 - y) / ((1 - y).sum() + 2)
        w = np.array([1.0, 0.0])
        f = np.stack([s, np.ones_like(s)])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(w @ f, -30, 30)))
            hess = (f * (p * (1 - p))) @ f.T + 1e-6 * np.eye(2)
            w = w - np.clip(np.linalg.solve(hess, f @ (p - target) + 1e-6 * w), -1, 1)
        self.slope, self.shift = (float(w[0]), float(w[1])) if w[0] > 0 else (1.0, 0.0)
        return self

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.raw(x) + self.shift, -30, 30)))
