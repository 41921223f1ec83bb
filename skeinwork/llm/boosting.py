"""Gradient-boosted trees over binned features, small enough to send to every task.

Trained on the driver from a bounded sample of labelled rows; scoring is vectorised over Arrow batches.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """Oblique-free binary trees of one depth, as flat arrays; feature -1 marks a node that passes everything to the left."""

    edges: list[np.ndarray]
    feature: np.ndarray  # trees x inner nodes
    cut: np.ndarray
    leaf: np.ndarray  # trees x leaves
    base: float

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right").astype(np.uint8) for j, e in enumerate(self.edges)], axis=1) if len(x) else np.empty((0, len(self.edges)), np.uint8)

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row."""
        bins, rows = self.binned(x), np.arange(len(x))
        out = np.full(len(x), self.base)
        depth = int(np.log2(self.leaf.shape[1]))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                f = feature[node]
                node = 2 * node + 1 + ((f >= 0) & (bins[rows, f] > cut[node]))
            out += leaf[node - (len(leaf) - 1)]
        return out


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, ridge: float = 2.0) -> Forest:
    """Newton boosting on the logistic loss with histogram splits. Deterministic: no sampling, ties go to the first feature and bin."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    forest = Forest(edges, np.full((trees, 2**depth - 1), -1), np.zeros((trees, 2**depth - 1), np.int64), np.zeros((trees, 2**depth)), 0.0)
    b = forest.binned(x)
    width = bins + 1
    columns = [np.ascontiguousarray(b[:, j]).astype(np.int64) for j in range(x.shape[1])]
    mean = float((y * weight).sum() / weight.sum())
    forest.base = float(np.log(max(mean, 1e-6) / max(1 - mean, 1e-6)))
    margin = np.full(len(y), forest.base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = (y - p) * weight, np.maximum(p * (1 - p), 1e-9) * weight
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, many = 2**level - 1, 2**level
            local = (node - first) * width
            sum_g, sum_h = (np.stack([np.bincount(local + c, v, many * width).reshape(many, width) for c in columns], axis=1).cumsum(2) for v in (g, h))
            all_g, all_h = sum_g[:, :, -1:], sum_h[:, :, -1:]
            gain = sum_g**2 / (sum_h + ridge) + (all_g - sum_g) ** 2 / (all_h - sum_h + ridge) - all_g**2 / (all_h + ridge)
            gain[:, :, -1] = -1
            best = gain.reshape(many, -1).argmax(1)
            good = gain.reshape(many, -1)[np.arange(many), best] > 1e-6
            forest.feature[t, first : first + many] = np.where(good, best // width, -1)
            forest.cut[t, first : first + many] = best % width
            f = forest.feature[t][node]
            node = 2 * node + 1 + ((f >= 0) & (b[np.arange(len(y)), f] > forest.cut[t][node]))
        at = node - (2**depth - 1)
        value = rate * np.bincount(at, g, 2**depth) / (np.bincount(at, h, 2**depth) + ridge)
        forest.leaf[t] = value
        margin += value[at]
    return forest
