"""Histogram gradient boosting of trees for two classes, in numpy: missing values go to the side where they gain more."""

from __future__ import annotations

import numpy as np


class Booster:
    """Trees of limited depth on up to 255 bins a feature, with a least number of rows a leaf and ridge on leaf values."""

    def __init__(self, max_iter: int = 200, learning_rate: float = 0.05, max_depth: int = 3, min_samples_leaf: int = 50, l2_regularization: float = 1.0, max_bins: int = 255, random_state: int = 42) -> None:
        self.max_iter, self.rate, self.depth, self.least, self.ridge, self.bins = max_iter, learning_rate, max_depth, min_samples_leaf, l2_regularization, max_bins
        self.random_state = random_state  # rows are never sampled, so that nothing depends on it

    def _binned(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(x.shape, np.int64)
        for j, e in enumerate(self.edges):
            out[:, j] = np.where(np.isnan(x[:, j]), self.bins, np.searchsorted(e, x[:, j], "left"))
        return out

    def fit(self, x: np.ndarray, y: np.ndarray) -> Booster:
        x, y = np.asarray(x, float), np.asarray(y, float)
        self.n_train, self.rate_of_one = len(y), float(y.mean()) if len(y) else 0.5
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        if len(y) == 0 or self.rate_of_one in (0.0, 1.0):
            self.base = None  # one class: its share is all there is to say
            return self
        self.base = float(np.log(self.rate_of_one / (1 - self.rate_of_one)))
        self.edges = []
        for c in x.T:
            v = np.unique(c[~np.isnan(c)])
            self.edges.append(v[:-1] if len(v) <= self.bins else np.unique(np.quantile(v, np.linspace(0, 1, self.bins + 1)[1:-1])))
        b = self._binned(x)
        width, n_feat = self.bins + 1, x.shape[1]
        flat = b + np.arange(n_feat) * width
        score = np.full(len(y), self.base)
        for _ in range(self.max_iter):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p)
            n_nodes = (1 << self.depth) - 1
            feature, cut, left = np.full(n_nodes, -1), np.zeros(n_nodes, np.int64), np.zeros(n_nodes, bool)
            node = np.zeros(len(y), np.int64)
            for d in range(self.depth):
                n, first = 1 << d, (1 << d) - 1
                slot = (node[:, None] * (n_feat * width) + flat).ravel()
                size = n * n_feat * width
                gs, hs, cs = (np.bincount(slot, np.repeat(v, n_feat), size).reshape(n, n_feat, width) for v in (g, h, np.ones(len(y))))
                best = self._best(gs, hs, cs)
                for i, (gain, f, k, miss_left) in enumerate(best):
                    if gain > 1e-9:
                        feature[first + i], cut[first + i], left[first + i] = f, k, miss_left
                at = first + node
                f = np.maximum(feature[at], 0)
                v = b[np.arange(len(y)), f]
                right = np.where(v == self.bins, ~left[at], v > cut[at]) & (feature[at] >= 0)
                node = 2 * node + right
            gs, hs = (np.bincount(node, v, 1 << self.depth) for v in (g, h))
            leaf = self.rate * gs / (hs + self.ridge)
            self.trees.append((feature, cut, left, leaf))
            score += leaf[node]
        return self

    def _best(self, gs: np.ndarray, hs: np.ndarray, cs: np.ndarray) -> list[tuple[float, int, int, bool]]:
        """Best split of each node: gain, feature, last bin on the left, whether missing values go left."""
        gt, ht = gs.sum(axis=2, keepdims=True), hs.sum(axis=2, keepdims=True)
        ct = cs.sum(axis=2, keepdims=True)
        out = None
        for miss_left in (False, True):
            gl, hl, cl = (np.cumsum(v[:, :, : self.bins], axis=2) + (v[:, :, self.bins :] if miss_left else 0) for v in (gs, hs, cs))
            gain = gl**2 / (hl + self.ridge) + (gt - gl) ** 2 / (ht - hl + self.ridge) - gt**2 / (ht + self.ridge)
            gain[(cl < self.least) | (ct - cl < self.least)] = 0
            k = gain.reshape(len(gain), -1).argmax(axis=1)
            found = [(float(gain[i].ravel()[j]), int(j) // self.bins, int(j) % self.bins, miss_left) for i, j in enumerate(k)]
            out = found if out is None else [max(a, b, key=lambda t: t[0]) for a, b in zip(out, found, strict=True)]
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probability of 1."""
        x = np.asarray(x, float)
        if self.base is None:
            return np.full(len(x), self.rate_of_one)
        b, rows = self._binned(x), np.arange(len(x))
        score = np.full(len(x), self.base)
        for feature, cut, left, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            for d in range(self.depth):
                at = (1 << d) - 1 + node
                v = b[rows, np.maximum(feature[at], 0)]
                node = 2 * node + (np.where(v == self.bins, ~left[at], v > cut[at]) & (feature[at] >= 0))
            score += leaf[node]
        return 1 / (1 + np.exp(-score))
