"""Gradient-boosted trees for two classes, in numpy: histogram splits, second-order gains, fixed depth."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Boosted:
    """Trees of one depth in arrays: for tree t, node n splits at ``x[feature[t, n]] > cut[t, n]``; ``leaf`` holds log odds."""

    base: float
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def logit(self, x: np.ndarray) -> np.ndarray:
        rows, out = np.arange(len(x)), np.full(len(x), self.base)
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            while node.size and node[0] < len(feature):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += leaf[node - len(feature)]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, *, trees: int = 40, depth: int = 3, rate: float = 0.25, bins: int = 32, l2: float = 1.0) -> Boosted:
    """Boost the log loss. Cuts are quantiles of each feature; a split that gains nothing sends all rows one way."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    n, width = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(width)]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], 1)  # > cut k: bin > k
    size = bins + 1
    flat = binned + np.arange(width) * size
    mean = np.clip(y.mean() if n else 0.5, 1e-4, 1 - 1e-4)
    base = float(np.log(mean / (1 - mean)))
    score = np.full(n, base)
    inner = 2**depth - 1
    features, points, leaves = (np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1)))
    for t in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h, node = y - p, p * (1 - p), np.zeros(n, np.int64)
        for k in range(inner):
            here = np.flatnonzero(node == k)
            if len(here) > 1:
                cells = flat[here].ravel()
                sg = np.bincount(cells, np.repeat(g[here], width), width * size).reshape(width, size).cumsum(1)
                sh = np.bincount(cells, np.repeat(h[here], width), width * size).reshape(width, size).cumsum(1)
                tg, th = sg[0, -1], sh[0, -1]
                gain = sg**2 / (sh + l2) + (tg - sg) ** 2 / (th - sh + l2) - tg**2 / (th + l2)
                j, b = np.unravel_index(int(gain.argmax()), gain.shape)
                if gain[j, b] > 1e-9 and b < len(cuts[j]):
                    features[t, k], points[t, k] = j, cuts[j][b]
            node[here] = 2 * k + 1 + (x[here, features[t, k]] > points[t, k])
        leaf = node - inner
        sums = np.bincount(leaf, g, inner + 1), np.bincount(leaf, h, inner + 1)
        leaves[t] = rate * sums[0] / (sums[1] + l2)
        score += leaves[t][leaf]
    return Boosted(base, features, points, leaves)


def calibrated_threshold(p: np.ndarray, y: np.ndarray, precision: float = 0.95) -> float:
    """The lowest probability above which at least ``precision`` of the held-out rows are positive (2 if there is none)."""
    order = np.argsort(-p, kind="stable")
    share = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    last_of_tie = np.r_[p[order][1:] != p[order][:-1], True]
    good = np.flatnonzero((share >= precision) & last_of_tie)
    return float(p[order][good[-1]]) if len(good) else 2.0
