"""Gradient-boosted decision trees for a binary label, on feature histograms, in numpy. For bounded training samples."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Tree:
    """Node 0 is the root; feature -1 marks a leaf; a row goes left if its feature is at most the threshold."""

    feature: list[int]
    threshold: list[float]
    left: list[int]
    right: list[int]
    value: list[float]

    def predict(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        feature, threshold = np.array(self.feature), np.array(self.threshold)
        left, right, value = np.array(self.left), np.array(self.right), np.array(self.value)
        while True:
            live = np.flatnonzero(feature[node] >= 0)
            if not len(live):
                return value[node]
            at = node[live]
            node[live] = np.where(x[live, feature[at]] <= threshold[at], left[at], right[at])


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def cuts_of(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """Thresholds of each feature: midpoints between different neighbouring quantiles."""
    out = []
    for column in x.T:
        q = np.unique(np.quantile(column, np.linspace(0, 1, bins + 1), method="nearest")) if len(column) else np.zeros(0)
        out.append((q[1:] + q[:-1]) / 2)
    return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.3, bins: int = 64, least: int = 10, part: float = 0.7, seed: int = 1) -> tuple[float, list[Tree]]:
    """The base score and the trees; y is 0 or 1."""
    n, d = x.shape
    if n == 0 or y.min() == y.max():
        p = min(max(float(y.mean()) if n else 0.5, 1e-6), 1 - 1e-6)
        return float(np.log(p / (1 - p))), []
    cuts = cuts_of(x, bins)
    width = max(len(c) for c in cuts) + 1
    binned = np.stack([np.searchsorted(c, column, side="left") for c, column in zip(cuts, x.T)], 1)
    base = float(np.log(y.mean() / (1 - y.mean())))
    z = np.full(n, base)
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(trees):
        p = sigmoid(z)
        g, h = y - p, p * (1 - p) + 1e-9
        tree = Tree([], [], [], [], [])

        def grow(rows: np.ndarray, level: int) -> int:
            me = len(tree.feature)
            total_g, total_h = g[rows].sum(), h[rows].sum()
            for column, value in ((tree.feature, -1), (tree.threshold, 0.0), (tree.left, -1), (tree.right, -1), (tree.value, rate * total_g / (total_h + 1))):
                column.append(value)
            if level == depth or len(rows) < 2 * least:
                return me
            flat = (binned[rows] + np.arange(d) * width).ravel()
            sums = [np.cumsum(np.bincount(flat, w, d * width).reshape(d, width), 1)[:, :-1] for w in (np.repeat(g[rows], d), np.repeat(h[rows], d), None)]
            left_g, left_h, left_n = sums
            gain = left_g**2 / (left_h + 1) + (total_g - left_g) ** 2 / (total_h - left_h + 1) - total_g**2 / (total_h + 1)
            gain[(left_n < least) | (len(rows) - left_n < least)] = -1
            best = int(gain.argmax()) if gain.size else 0
            if not gain.size or gain.flat[best] <= 1e-6:
                return me
            f, b = divmod(best, width - 1)
            goes = binned[rows, f] <= b
            tree.feature[me], tree.threshold[me] = f, float(cuts[f][b])
            tree.left[me] = grow(rows[goes], level + 1)
            tree.right[me] = grow(rows[~goes], level + 1)
            return me

        picked = np.flatnonzero(rng.random(n) < part)
        grow(picked if len(picked) >= 2 * least else np.arange(n), 0)
        out.append(tree)
        z += tree.predict(x)
    return base, out


def score(x: np.ndarray, base: float, trees: list[Tree]) -> np.ndarray:
    z = np.full(len(x), base)
    for tree in trees:
        z += tree.predict(x)
    return sigmoid(z)
