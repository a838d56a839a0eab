"""Gradient-boosted regression trees on the logistic loss, over binned features, in numpy."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

from .hashed import sigmoid


class Tree(NamedTuple):
    """A node's feature is -1 at a leaf; x[feature] <= cut goes left."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    value: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), int)
        while (inner := self.feature[node] >= 0).any():
            f = self.feature[node[inner]]
            right = x[np.flatnonzero(inner), f] > self.cut[node[inner]]
            node[inner] = self.left[node[inner]] + right
        return self.value[node]


class Booster(NamedTuple):
    base: float
    trees: list[Tree]
    slope: float = 1.0
    shift: float = 0.0

    def odds(self, x: np.ndarray) -> np.ndarray:
        return self.base + sum((t.predict(x) for t in self.trees), np.zeros(len(x)))

    def probability(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.slope * self.odds(x) + self.shift)


def _grow(x: np.ndarray, bins: np.ndarray, cuts: list[np.ndarray], g: np.ndarray, h: np.ndarray, depth: int, l2: float, rate: float, least: float) -> Tree:
    feature, cut, left, value = [-1], [0.0], [0], [0.0]
    todo = [(0, np.arange(len(x)), 0)]
    while todo:
        node, rows, level = todo.pop()
        total_g, total_h = g[rows].sum(), h[rows].sum()
        value[node] = -rate * total_g / (total_h + l2)
        best = (1e-6, -1, 0)
        if level < depth:
            for f, own in enumerate(cuts):
                if not len(own):
                    continue
                b = bins[rows, f]
                gl = np.cumsum(np.bincount(b, g[rows], len(own) + 1))[:-1]
                hl = np.cumsum(np.bincount(b, h[rows], len(own) + 1))[:-1]
                gain = gl**2 / (hl + l2) + (total_g - gl) ** 2 / (total_h - hl + l2) - total_g**2 / (total_h + l2)
                gain[(hl < least) | (total_h - hl < least)] = 0
                if gain.max() > best[0]:
                    best = (float(gain.max()), f, int(gain.argmax()))
        if best[1] >= 0:
            _, f, k = best
            feature[node], cut[node], left[node] = f, cuts[f][k], len(feature)
            for part in (rows[bins[rows, f] <= k], rows[bins[rows, f] > k]):
                todo.append((len(feature), part, level + 1))
                feature.append(-1)
                cut.append(0.0)
                left.append(0)
                value.append(0.0)
    return Tree(np.array(feature), np.array(cut), np.array(left), np.array(value))


def train(x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 3, rate: float = 0.3, l2: float = 1.0, least: float = 1.0, max_bins: int = 32) -> Booster:
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, max_bins + 1)[1:-1], method="lower")) for c in x.T]
    cuts = [c[c < column.max()] for c, column in zip(cuts, x.T, strict=True)]
    bins = np.stack([np.searchsorted(c, column, "left") for c, column in zip(cuts, x.T, strict=True)], 1)
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    odds, trees = np.full(len(y), base), []
    for _ in range(rounds):
        p = sigmoid(odds)
        trees.append(_grow(x, bins, cuts, p - y, p * (1 - p), depth, l2, rate, least))
        odds += trees[-1].predict(x)
    return Booster(base, trees)
