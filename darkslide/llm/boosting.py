"""Gradient-boosted trees for a yes or no, on histograms; small enough to send along with a task."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np


class Boosted(NamedTuple):
    """Complete binary trees: for each tree and inner node the feature and the threshold (go right above it), for each leaf its value."""

    bias: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def probability(self, x: np.ndarray) -> np.ndarray:
        z, rows = np.full(len(x), self.bias), np.arange(len(x))
        depth = (self.leaf.shape[1] - 1).bit_length()
        for f, t, leaf in zip(self.feature, self.threshold, self.leaf):
            at = np.zeros(len(x), np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            z += leaf[at - (len(leaf) - 1)]
        return 1 / (1 + np.exp(-z))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 48, shrink: float = 2.0) -> Boosted:
    """Fits to rows of features and 0/1 targets by second-order boosting of the logistic loss."""
    n, k = x.shape
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], axis=1)
    bias = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    z, inner, flat = np.full(n, bias), (1 << depth) - 1, binned + np.arange(k) * bins
    features, thresholds, leaves = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    for m in range(trees):
        p = 1 / (1 + np.exp(-z))
        g, h, at = y - p, p * (1 - p), np.zeros(n, np.int64)
        for level in range(depth):
            first, width = (1 << level) - 1, 1 << level
            local = at - first
            cell = (local[:, None] * (k * bins) + flat).reshape(-1)
            sums = [np.bincount(cell, weights=np.repeat(v, k), minlength=width * k * bins).reshape(width, k, bins) for v in (g, h)]
            gl, hl = (np.cumsum(s, axis=2) for s in sums)
            gt, ht = gl[:, :, -1:], hl[:, :, -1:]
            gain = gl**2 / (hl + shrink) + (gt - gl) ** 2 / (ht - hl + shrink) - gt**2 / (ht + shrink)
            best = gain.reshape(width, -1).argmax(axis=1)
            for node in range(width):
                f, b = divmod(int(best[node]), bins)
                if gain[node, f, b] > 1e-6 and b < len(edges[f]):
                    features[m, first + node], thresholds[m, first + node] = f, edges[f][b]
            at = 2 * at + 1 + (x[np.arange(n), features[m, at]] > thresholds[m, at])
        at -= inner
        leaves[m] = rate * np.bincount(at, weights=g, minlength=inner + 1) / (np.bincount(at, weights=h, minlength=inner + 1) + shrink)
        z += leaves[m, at]
    return Boosted(bias, features, thresholds, leaves)
