"""Histogram gradient-boosted trees for two classes, in numpy.

Features are cut into at most BINS bins at sample quantiles; trees of fixed depth grow level by level
from gradient and hessian sums per (node, feature, bin), found by one bincount a level. A model is
flat arrays (feature, threshold, leaf value); a batch walks all trees at once, level by level.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Forest:
    feature: np.ndarray  # tree, inner node in heap order
    threshold: np.ndarray  # go right if value > threshold
    leaf: np.ndarray  # tree, leaf
    start: float

    def margins(self, x: np.ndarray) -> np.ndarray:
        n_trees, inner = self.feature.shape
        rows = np.arange(len(x))[:, None]
        trees = np.arange(n_trees)[None, :]
        node = np.zeros((len(x), n_trees), np.int64)
        for _ in range((inner + 1).bit_length() - 1):
            right = x[rows, self.feature[trees, node]] > self.threshold[trees, node]
            node = 2 * node + 1 + right
        return self.start + self.leaf[trees, node - inner].sum(axis=1)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, *, n_trees: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.15, l2: float = 1.0, min_hessian: float = 1.0) -> Forest:
    """Logistic loss; deterministic. With one class or no rows, a constant model."""
    inner, n_features = 2**depth - 1, x.shape[1]
    positive = (y.sum() + 0.5) / (len(y) + 1)
    start = float(np.log(positive / (1 - positive)))
    empty = Forest(np.zeros((1, inner), np.int64), np.zeros((1, inner)), np.zeros((1, inner + 1)), start)
    if len(y) == 0 or y.min() == y.max():
        return empty
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(n_features)]
    codes = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    limit = np.array([len(e) for e in edges])
    allowed = np.arange(bins)[None, :] < limit[:, None]  # cut after bin b: value > edges[b]
    features, thresholds, leaves = [], [], []
    margin = np.full(len(y), start)
    for _ in range(n_trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            local = node - first
            cell = ((local[:, None] * n_features + np.arange(n_features)) * bins + codes).ravel()
            shape = (width, n_features, bins)
            sums = [np.bincount(cell, np.repeat(w, n_features), minlength=width * n_features * bins).reshape(shape).cumsum(axis=2) for w in (g, h)]
            total_g, total_h = sums[0][:, :1, -1:], sums[1][:, :1, -1:]
            left_g, left_h = sums
            right_g, right_h = total_g - left_g, total_h - left_h
            gain = left_g**2 / (left_h + l2) + right_g**2 / (right_h + l2) - total_g**2 / (total_h + l2)
            gain = np.where(allowed[None] & (left_h >= min_hessian) & (right_h >= min_hessian), gain, -np.inf).reshape(width, -1)
            best = gain.argmax(axis=1)
            for k in range(width):
                if gain[k, best[k]] > 1e-9:
                    feature[first + k], cut = divmod(int(best[k]), bins)
                    threshold[first + k] = edges[feature[first + k]][cut]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > threshold[node])
        at = node - inner
        value = -rate * np.bincount(at, g, minlength=inner + 1) / (np.bincount(at, h, minlength=inner + 1) + l2)
        margin += value[at]
        features.append(feature)
        thresholds.append(threshold)
        leaves.append(value)
    return Forest(np.array(features), np.array(thresholds), np.array(leaves), start)
