"""Gradient-boosted regression trees for a two-class logistic loss, in numpy, and their form as a SQL expression."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def _leaf(g: np.ndarray, h: np.ndarray) -> float:
    return float(-g.sum() / (h.sum() + 1.0))


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int):
    best = (1e-6, None, None)
    if depth and len(g) > 8:
        base = g.sum() ** 2 / (h.sum() + 1.0)
        for j in range(x.shape[1]):
            for cut in np.unique(np.quantile(x[:, j], np.linspace(0.05, 0.95, 15), method="lower")):
                left = x[:, j] <= cut
                if 4 <= left.sum() <= len(g) - 4:
                    gain = g[left].sum() ** 2 / (h[left].sum() + 1.0) + g[~left].sum() ** 2 / (h[~left].sum() + 1.0) - base
                    if gain > best[0]:
                        best = (gain, j, float(cut))
    if best[1] is None:
        return _leaf(g, h)
    left = x[:, best[1]] <= best[2]
    return (best[1], best[2], _grow(x[left], g[left], h[left], depth - 1), _grow(x[~left], g[~left], h[~left], depth - 1))


def _value(tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    j, cut, low, high = tree
    return np.where(x[:, j] <= cut, _value(low, x), _value(high, x))


class Boosted:
    """`rounds` trees of `depth` levels, each fitted to the loss's gradient and curvature, shrunk by `rate`."""

    def __init__(self, rounds: int = 40, depth: int = 4, rate: float = 0.4):
        self.rounds, self.depth, self.rate, self.trees, self.start = rounds, depth, rate, [], 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        mean = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
        self.start = float(np.log(mean / (1 - mean)))
        score = np.full(len(y), self.start)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            tree = _grow(x, p - y, p * (1 - p), self.depth)
            self.trees.append(tree)
            score = score + self.rate * _value(tree, x)
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.start + self.rate * sum(_value(t, x) for t in self.trees)

    def column(self, features: list[Column]) -> Column:
        """The margin as nested CASE expressions over the features, in the order of fit()'s columns."""

        def case(tree) -> Column:
            if not isinstance(tree, tuple):
                return F.lit(self.rate * tree)
            j, cut, low, high = tree
            return F.when(features[j] <= F.lit(cut), case(low)).otherwise(case(high))

        total = F.lit(self.start)
        for tree in self.trees:
            total = total + case(tree)
        return total


def calibrated_threshold(margin: np.ndarray, y: np.ndarray, precision: float = 0.995) -> float:
    """The lowest margin from which the held-out rows at or above it reach the precision."""
    order = np.argsort(-margin, kind="stable")
    right = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    ok = np.flatnonzero(right >= precision)
    return float(margin[order][ok[-1]]) if len(ok) else float("inf")
