"""Gradient-boosted trees for a few classes, fitted in memory on a bounded sample."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Tree:
    feature: list[int] = field(default_factory=list)
    cut: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)

    def add(self, value: float) -> int:
        for col, x in ((self.feature, -1), (self.cut, 0.0), (self.left, -1), (self.right, -1), (self.value, value)):
            col.append(x)
        return len(self.value) - 1

    def predict(self, x: np.ndarray) -> np.ndarray:
        feature, cut, left, right = map(np.array, (self.feature, self.cut, self.left, self.right))
        at = np.zeros(len(x), dtype=int)
        while (inner := feature[at] >= 0).any():
            rows = np.flatnonzero(inner)
            node = at[rows]
            at[rows] = np.where(x[rows, feature[node]] < cut[node], left[node], right[node])
        return np.array(self.value)[at]


def _grow(x: np.ndarray, cuts: list[np.ndarray], bins: np.ndarray, grad: np.ndarray, hess: np.ndarray, depth: int, least: float, ridge: float) -> Tree:
    tree = Tree()

    def node(rows: np.ndarray, level: int) -> int:
        g, h = grad[rows].sum(), hess[rows].sum()
        me = tree.add(-g / (h + ridge))
        if level == depth:
            return me
        best = (1e-6, -1, -1)
        for j, c in enumerate(cuts):
            if not len(c):
                continue
            gs = np.bincount(bins[rows, j], weights=grad[rows], minlength=len(c) + 1).cumsum()[:-1]
            hs = np.bincount(bins[rows, j], weights=hess[rows], minlength=len(c) + 1).cumsum()[:-1]
            gain = gs**2 / (hs + ridge) + (g - gs) ** 2 / (h - hs + ridge) - g**2 / (h + ridge)
            gain[(hs < least) | (h - hs < least)] = 0
            top = gain.max()
            if top > best[0]:
                same = np.flatnonzero(gain > top * (1 - 1e-9))
                best = (top, j, int(same[len(same) // 2]))  # of equal cuts the middle one
        if best[1] < 0:
            return me
        _, j, b = best
        go = bins[rows, j] <= b
        tree.feature[me], tree.cut[me] = j, float(cuts[j][b])
        tree.left[me] = node(rows[go], level + 1)
        tree.right[me] = node(rows[~go], level + 1)
        return me

    node(np.arange(len(x)), 0)
    return tree


@dataclass
class Boosted:
    classes: list[str]
    trees: list[list[Tree]]
    base: np.ndarray
    rate: float
    temperature: float = 1.0

    def scores(self, x: np.ndarray) -> np.ndarray:
        f = np.tile(self.base, (len(x), 1))
        for layer in self.trees:
            for k, tree in enumerate(layer):
                f[:, k] += self.rate * tree.predict(x)
        return f

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return softmax(self.scores(x) / self.temperature)

    def calibrate(self, x: np.ndarray, y: list[str]) -> None:
        """Sets the temperature with the least log loss on held-out rows."""
        f = self.scores(x)
        true = np.array([self.classes.index(c) for c in y])
        loss = lambda t: -np.log(softmax(f / t)[np.arange(len(true)), true] + 1e-12).mean()
        self.temperature = float(min(np.geomspace(0.25, 8, 41), key=loss))


def softmax(f: np.ndarray) -> np.ndarray:
    e = np.exp(f - f.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fit(x: np.ndarray, y: list[str], rounds: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 64) -> Boosted:
    """Softmax boosting; cuts lie midway between neighbouring values (or quantiles of them)."""
    classes = sorted(set(y))
    true = np.array([classes.index(c) for c in y])
    hot = np.eye(len(classes))[true]
    cuts = []
    for j in range(x.shape[1]):
        u = np.unique(x[:, j])
        mid = (u[1:] + u[:-1]) / 2
        cuts.append(mid if len(mid) <= bins else mid[np.linspace(0, len(mid) - 1, bins).astype(int)])
    binned = np.stack([np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(cuts)], axis=1)
    weight = (len(y) / (len(classes) * hot.sum(0)))[true]
    base = np.zeros(len(classes))
    f = np.tile(base, (len(x), 1))
    trees = []
    for _ in range(rounds):
        p = softmax(f)
        layer = []
        for k in range(len(classes)):
            tree = _grow(x, cuts, binned, weight * (p[:, k] - hot[:, k]), weight * np.maximum(p[:, k] * (1 - p[:, k]), 1e-6), depth, 1.0, 1.0)
            f[:, k] += rate * tree.predict(x)
            layer.append(tree)
        trees.append(layer)
    return Boosted(classes, trees, base, rate)
