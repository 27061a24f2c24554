"""Gradient-boosted trees on histograms, for two classes, in numpy."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Trees:
    """Complete trees of one depth, stored level by level: the feature and the bin that each inner node splits at, and the leaves' scores."""

    edges: list[np.ndarray]
    depth: int
    prior: float = 0.0
    split: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(self.edges)]).astype(np.uint8)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Log odds of the positive class."""
        bins = self.binned(x)
        rows = np.arange(len(x))
        out = np.full(len(x), self.prior)
        for feature, cut, leaf in self.split:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (bins[rows, feature[at]] > cut[at])
            out += leaf[at - (1 << self.depth) + 1]
        return out


def fit(x: np.ndarray, y: np.ndarray, *, trees: int = 40, depth: int = 4, bins: int = 32, rate: float = 0.3, ridge: float = 1.0) -> Trees:
    """Fit by Newton steps on the logistic loss; a split is the one of largest gain over all features and bins."""
    edges = []
    for k in range(x.shape[1]):
        values = np.unique(x[:, k])
        if len(values) > bins:
            values = np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1]))
        edges.append((values[:-1] + values[1:]) / 2 if len(values) <= bins and len(values) > 1 and len(np.unique(x[:, k])) <= bins else values)
    share = float(np.clip(y.mean() if len(y) else 0.5, 1e-6, 1 - 1e-6))
    model = Trees(edges, depth, float(np.log(share / (1 - share))))
    if not len(y):
        return model
    b = model.binned(x).astype(np.int64)
    n_features = x.shape[1]
    width = bins + 1
    flat = b + np.arange(n_features) * width
    score = np.full(len(y), model.prior)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        grad, hess = y - p, p * (1 - p)
        feature, cut = np.zeros((1 << depth) - 1, np.int64), np.full((1 << depth) - 1, width, np.int64)
        at = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, count = (1 << level) - 1, 1 << level
            where = ((at - first)[:, None] * (n_features * width) + flat).ravel()
            shape = (count, n_features, width)
            g = np.bincount(where, np.repeat(grad, n_features), count * n_features * width).reshape(shape).cumsum(2)
            h = np.bincount(where, np.repeat(hess, n_features), count * n_features * width).reshape(shape).cumsum(2)
            gt, ht = g[:, :1, -1:], h[:, :1, -1:]
            gain = g**2 / (h + ridge) + (gt - g) ** 2 / (ht - h + ridge) - gt**2 / (ht + ridge)
            gain[(h < 1e-3) | (ht - h < 1e-3)] = -1
            best = gain.reshape(count, -1).argmax(1)
            good = gain.reshape(count, -1)[np.arange(count), best] > 1e-6
            feature[first : first + count] = np.where(good, best // width, 0)
            cut[first : first + count] = np.where(good, best % width, width)
            at = 2 * at + 1 + (b[np.arange(len(y)), feature[at]] > cut[at])
        leaf_of = at - (1 << depth) + 1
        g, h = np.bincount(leaf_of, grad, 1 << depth), np.bincount(leaf_of, hess, 1 << depth)
        leaf = rate * g / (h + ridge)
        model.split.append((feature, cut, leaf))
        score += leaf[leaf_of]
    return model
