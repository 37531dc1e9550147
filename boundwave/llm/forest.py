"""A small random forest in NumPy: bootstrap rows, random feature subsets, Gini splits."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    feature: np.ndarray  # [trees, nodes]; -1 in leaves
    cut: np.ndarray
    child: np.ndarray  # left child; the right one follows it
    value: np.ndarray

    def probability(self, x: np.ndarray) -> np.ndarray:
        """Mean over the trees of the positive share in each row's leaf."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for feature, cut, child, value in zip(self.feature, self.cut, self.child, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            while True:
                f = feature[node]
                inner = f >= 0
                if not inner.any():
                    break
                right = x[rows, np.maximum(f, 0)] > cut[node]
                node = np.where(inner, child[node] + right, node)
            total += value[node]
        return total / len(self.feature)


def _split(x: np.ndarray, y: np.ndarray, columns: np.ndarray) -> tuple[float, int, float] | None:
    best, n = None, len(y)
    for c in columns:
        order = np.argsort(x[:, c], kind="stable")
        v, ones = x[order, c], np.cumsum(y[order])
        at = np.flatnonzero(v[1:] > v[:-1])
        if not len(at):
            continue
        left = at + 1.0
        a, b = ones[at], ones[-1] - ones[at]
        impurity = 2 * (a * (left - a) / left + b * (n - left - b) / (n - left))
        k = int(np.argmin(impurity))
        if best is None or impurity[k] < best[0]:
            best = (float(impurity[k]), int(c), float((v[at[k]] + v[at[k] + 1]) / 2))
    return best


def grow_forest(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 9, least: int = 3, seed: int = 7) -> Forest:
    rng = np.random.default_rng(seed)
    subset = max(1, int(np.sqrt(x.shape[1])) + 1)
    grown = []
    for _ in range(trees):
        rows = rng.integers(0, len(x), len(x))
        feature, cut, child, value = [-1], [0.0], [0], [0.0]
        stack = [(0, rows, 0)]
        while stack:
            node, own, level = stack.pop()
            value[node] = float(y[own].mean())
            if level >= depth or len(own) < 2 * least or value[node] in (0.0, 1.0):
                continue
            found = _split(x[own], y[own], rng.choice(x.shape[1], subset, replace=False))
            if found is None:
                continue
            right = x[own, found[1]] > found[2]
            feature[node], cut[node], child[node] = found[1], found[2], len(feature)
            for _side in range(2):
                feature.append(-1), cut.append(0.0), child.append(0), value.append(0.0)
            stack += [(child[node], own[~right], level + 1), (child[node] + 1, own[right], level + 1)]
        grown.append((feature, cut, child, value))
    wide = max(len(g[0]) for g in grown)
    pad = lambda k, fill: np.array([g[k] + [fill] * (wide - len(g[k])) for g in grown])
    return Forest(pad(0, -1), pad(1, 0.0), pad(2, 0), pad(3, 0.0))
