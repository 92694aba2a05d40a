"""Small gradient-boosted trees and isotonic calibration over binned features."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Logistic boosting of depth-limited trees over quantile bins; deterministic."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, least: float = 2.0, ridge: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.least, self.ridge = rounds, depth, rate, bins, least, ridge

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(self.cuts)])

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        self.cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(x.shape[1])]
        b = self._binned(x)
        p = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
        self.base = np.log(p / (1 - p))
        self.trees = []
        f = np.full(len(y), self.base)
        if not len(y) or y.min() == y.max():
            return self
        for _ in range(self.rounds):
            q = 1 / (1 + np.exp(-f))
            g, h = y - q, q * (1 - q)
            node = np.zeros(len(y), np.int64)
            tree = []
            for level in range(self.depth):
                n = 1 << level
                best = [(0.0, 0, self.bins + 1)] * n
                for j in range(b.shape[1]):
                    width = len(self.cuts[j]) + 1
                    key = node * width + b[:, j]
                    gs = np.bincount(key, g, n * width).reshape(n, width).cumsum(axis=1)
                    hs = np.bincount(key, h, n * width).reshape(n, width).cumsum(axis=1)
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + self.ridge) + (gt - gs) ** 2 / (ht - hs + self.ridge) - gt**2 / (ht + self.ridge)
                    gain[(hs < self.least) | (ht - hs < self.least)] = 0
                    at = gain.argmax(axis=1)
                    for k in range(n):
                        if gain[k, at[k]] > best[k][0] + 1e-9:
                            best[k] = (float(gain[k, at[k]]), j, int(at[k]))
                feature = np.array([t[1] for t in best])
                cut = np.array([t[2] for t in best])
                tree.append((feature, cut))
                node = 2 * node + (b[np.arange(len(y)), feature[node]] > cut[node])
            n = 1 << self.depth
            leaf = self.rate * np.bincount(node, g, n) / (np.bincount(node, h, n) + self.ridge)
            self.trees.append((tree, leaf))
            f += leaf[node]
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        b, rows = self._binned(x), np.arange(len(x))
        f = np.full(len(x), self.base)
        for tree, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            for feature, cut in tree:
                node = 2 * node + (b[rows, feature[node]] > cut[node])
            f += leaf[node]
        return f


class Isotonic:
    """The nondecreasing least-squares fit of labels to scores (pool adjacent violators), interpolated between blocks."""

    def fit(self, x: np.ndarray, y: np.ndarray) -> Isotonic:
        order = np.argsort(x, kind="stable")
        values, counts = np.unique(x[order], return_counts=True)
        sums = np.add.reduceat(y[order].astype(float), np.concatenate([[0], np.cumsum(counts)[:-1]])) if len(x) else np.zeros(0)
        mean, weight, left = [], [], []
        for v, s, c in zip(values, sums, counts, strict=True):
            mean.append(s / c)
            weight.append(float(c))
            left.append([v, v])
            while len(mean) > 1 and mean[-2] >= mean[-1]:
                m, w, (_, hi) = mean.pop(), weight.pop(), left.pop()
                mean[-1] = (mean[-1] * weight[-1] + m * w) / (weight[-1] + w)
                weight[-1] += w
                left[-1][1] = hi
        self.x = np.array([v for pair in left for v in pair]) if left else np.zeros(1)
        self.y = np.repeat(mean, 2) if mean else np.zeros(1)
        return self

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.interp(x, self.x, self.y)
