"""Gradient-boosted trees on small tables, fitted in numpy and written out as SQL expressions."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Tree:
    """A split (feature, threshold: at most goes left) or, without feature, a leaf value."""

    value: float = 0.0
    feature: int | None = None
    threshold: float = 0.0
    left: Tree | None = None
    right: Tree | None = None

    def of(self, x: np.ndarray) -> np.ndarray:
        if self.feature is None:
            return np.full(len(x), self.value)
        return np.where(x[:, self.feature] <= self.threshold, self.left.of(x), self.right.of(x))

    def column(self, features: list[Column]) -> Column:
        if self.feature is None:
            return F.lit(float(self.value))
        return F.when(features[self.feature] <= F.lit(float(self.threshold)), self.left.column(features)).otherwise(self.right.column(features))


def _grow(x: np.ndarray, slope: np.ndarray, curve: np.ndarray, depth: int, least: int) -> Tree:
    def gain(g: float, h: float) -> float:
        return g * g / (h + 1.0)

    best, total = (1e-6, None, 0.0), gain(slope.sum(), curve.sum())
    if depth:
        for f in range(x.shape[1]):
            order = np.argsort(x[:, f], kind="stable")
            v, g, h = x[order, f], np.cumsum(slope[order]), np.cumsum(curve[order])
            for i in np.flatnonzero(v[:-1] < v[1:]):
                if i + 1 < least or len(v) - i - 1 < least:
                    continue
                better = gain(g[i], h[i]) + gain(g[-1] - g[i], h[-1] - h[i]) - total
                if better > best[0]:
                    best = (better, f, (v[i] + v[i + 1]) / 2)
    if best[1] is None:
        return Tree(value=float(slope.sum() / (curve.sum() + 1.0)))
    side = x[:, best[1]] <= best[2]
    return Tree(
        feature=best[1],
        threshold=float(best[2]),
        left=_grow(x[side], slope[side], curve[side], depth - 1, least),
        right=_grow(x[~side], slope[~side], curve[~side], depth - 1, least),
    )


@dataclass(frozen=True)
class Boosted:
    base: float
    rate: float
    trees: tuple[Tree, ...]
    threshold: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.base + self.rate * sum((t.of(x) for t in self.trees), np.zeros(len(x)))

    def column(self, features: list[Column]) -> Column:
        """The margin (log-odds) as an expression."""
        total = F.lit(self.base)
        for t in self.trees:
            total = total + F.lit(self.rate) * t.column(features)
        return total


def boost(x: np.ndarray, y: np.ndarray, trees: int = 20, depth: int = 3, rate: float = 0.3, least: int = 5, precision: float = 0.99) -> Boosted:
    """Fit on logistic loss; every fourth row calibrates the least margin whose rows above are ``precision`` right."""
    held = np.arange(len(y)) % 4 == 3
    fx, fy = x[~held], y[~held].astype(float)
    odds = np.clip(fy.mean(), 0.01, 0.99)
    base, grown = float(np.log(odds / (1 - odds))), []
    margin = np.full(len(fy), base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grown.append(_grow(fx, fy - p, p * (1 - p), depth, least))
        margin = margin + rate * grown[-1].of(fx)
    model = Boosted(base, rate, tuple(grown), 0.0)
    said, truth = model.margin(x[held]), y[held].astype(bool)
    threshold = np.inf
    for t in sorted(set(np.round(said, 6)), reverse=True):
        chosen = said >= t - 1e-5
        if truth[chosen].mean() >= precision:
            threshold = t
    return Boosted(base, rate, tuple(grown), float(max(threshold - 1e-5, 0.0)))
