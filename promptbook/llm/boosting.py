"""Gradient-boosted trees for two classes, small enough to be fitted on the driver from a bounded sample."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Logistic boosting of trees of fixed depth over binned features. Deterministic; scoring is vectorised."""

    def __init__(self, trees: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 32, least: float = 5.0):
        self.n, self.depth, self.rate, self.bins, self.least = trees, depth, rate, bins, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        x, y = np.asarray(x, float), np.asarray(y, float)
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        b = np.stack([np.searchsorted(e, c, "left") for e, c in zip(self.edges, x.T)], 1)
        p = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
        self.base = float(np.log(p / (1 - p)))
        score = np.full(len(y), self.base)
        self.trees = []
        for _ in range(self.n):
            prob = 1 / (1 + np.exp(-score))
            g, h = y - prob, prob * (1 - prob)
            node = np.zeros(len(y), np.int64)
            splits = []
            for level in range(self.depth):
                chosen = []
                for k in range(2**level):
                    inside = node == k
                    chosen.append(self._split(b[inside], g[inside], h[inside]))
                feature = np.array([c[0] for c in chosen])
                cut = np.array([c[1] for c in chosen])
                splits.append((feature, cut))
                node = node * 2 + (b[np.arange(len(y)), feature[node]] > cut[node])
            size = 2**self.depth
            leaf = np.bincount(node, g, size) / (np.bincount(node, h, size) + 1.0)
            score += self.rate * leaf[node]
            self.trees.append((splits, self.rate * leaf))
        return self

    def _split(self, b: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[int, int]:
        best, choice = 1e-9, (0, self.bins)
        if len(b) < 2:
            return choice
        total_g, total_h = g.sum(), h.sum()
        parent = total_g**2 / (total_h + 1)
        for f in range(b.shape[1]):
            lg, lh = np.cumsum(np.bincount(b[:, f], g, self.bins))[:-1], np.cumsum(np.bincount(b[:, f], h, self.bins))[:-1]
            n = np.cumsum(np.bincount(b[:, f], minlength=self.bins))[:-1]
            gain = lg**2 / (lh + 1) + (total_g - lg) ** 2 / (total_h - lh + 1) - parent
            gain[(n < self.least) | (len(b) - n < self.least)] = -1
            k = int(np.argmax(gain))
            if gain[k] > best:
                best, choice = gain[k], (f, k)
        return choice

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of the second class."""
        x = np.asarray(x, float)
        if not len(x):
            return np.zeros(0)
        b = np.stack([np.searchsorted(e, c, "left") for e, c in zip(self.edges, x.T)], 1)
        rows = np.arange(len(x))
        score = np.full(len(x), self.base)
        for splits, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            for feature, cut in splits:
                node = node * 2 + (b[rows, feature[node]] > cut[node])
            score += leaf[node]
        return 1 / (1 + np.exp(-score))
