"""A random forest of binary classification trees, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Tree:
    feature: np.ndarray  # -1 at a leaf
    threshold: np.ndarray
    child: np.ndarray  # of values up to the threshold; the other follows it
    value: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        while True:
            inner = np.flatnonzero(self.feature[node] >= 0)
            if not len(inner):
                return self.value[node]
            at = node[inner]
            node[inner] = self.child[at] + (x[inner, self.feature[at]] > self.threshold[at])


def _best_split(x: np.ndarray, y: np.ndarray, features: np.ndarray, leaf: int):
    """Feature and threshold with the least Gini impurity that leaves ``leaf`` rows on both sides."""
    best = (np.inf, -1, 0.0)
    n, total = len(y), y.sum()
    for f in features:
        order = np.argsort(x[:, f], kind="stable")
        values, ones = x[order, f], np.cumsum(y[order])
        left = np.arange(1, n)
        usable = (values[1:] > values[:-1]) & (left >= leaf) & (n - left >= leaf)
        if usable.any():
            a, b = ones[:-1], total - ones[:-1]
            impurity = np.where(usable, a * (left - a) / left + b * (n - left - b) / (n - left), np.inf)
            k = int(impurity.argmin())
            if impurity[k] < best[0]:
                best = (impurity[k], int(f), float(values[k]))
    return best[1], best[2]


def _grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int, leaf: int) -> Tree:
    feature, threshold, child, value = [-1], [0.0], [0], [0.0]
    todo = [(0, np.arange(len(y)), 0)]
    some = max(1, round(x.shape[1] ** 0.5))
    while todo:
        node, rows, level = todo.pop()
        value[node] = float(y[rows].mean())
        if level == depth or value[node] in (0.0, 1.0):
            continue
        f, t = _best_split(x[rows], y[rows], rng.choice(x.shape[1], some, replace=False), leaf)
        if f < 0:
            continue
        feature[node], threshold[node], child[node] = f, t, len(feature)
        left = x[rows, f] <= t
        for part in (rows[left], rows[~left]):
            todo.append((len(feature), part, level + 1))
            for column, empty in ((feature, -1), (threshold, 0.0), (child, 0), (value, 0.0)):
                column.append(empty)
    return Tree(np.array(feature), np.array(threshold), np.array(child), np.array(value))


@dataclass
class Forest:
    trees: list[Tree]

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Mean share of ones in the leaves."""
        return np.mean([t.predict(x) for t in self.trees], axis=0) if len(x) else np.zeros(0)


def fit(x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 8, leaf: int = 4, seed: int = 5) -> Forest:
    """Every tree on its own bootstrap of the rows."""
    rng = np.random.default_rng(seed)
    y = y.astype(np.float64)
    draws = [rng.integers(0, len(y), len(y)) for _ in range(trees)]
    return Forest([_grow(x[d], y[d], rng, depth, leaf) for d in draws])
