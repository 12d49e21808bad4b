"""Gradient-boosted regression trees for the logistic loss, in numpy, over binned features."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Trees of fixed depth stored as heaps: ``feature``, ``cut`` (go right if x > cut) and leaf values."""

    def __init__(self, trees: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 32, leaf: int = 5, l2: float = 1.0):
        self.trees, self.depth, self.rate, self.bins, self.leaf, self.l2 = trees, depth, rate, bins, leaf, l2
        self.bias, self.model = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Boosted":
        p = min(max(float(y.mean()), 1e-4), 1 - 1e-4) if len(y) else 1e-4
        self.bias = float(np.log(p / (1 - p)))
        if not len(y) or y.min() == y.max():
            return self
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        code = np.column_stack([np.searchsorted(e, c) for e, c in zip(edges, x.T)])  # bin b holds x <= edges[b]
        score = np.full(len(y), self.bias)
        for _ in range(self.trees):
            q = 1 / (1 + np.exp(-score))
            grad, hess = y - q, np.maximum(q * (1 - q), 1e-6)
            n = 1 << self.depth
            feature, cut, node = np.zeros(n, int), np.full(n, np.inf), np.ones(len(y), int)
            for level in range(self.depth):
                for at in range(1 << level, 2 << level):
                    rows = np.flatnonzero(node == at)
                    best = (1e-6, 0, np.inf, None)
                    if len(rows) >= 2 * self.leaf:
                        g, h = grad[rows], hess[rows]
                        whole = g.sum() ** 2 / (h.sum() + self.l2)
                        for f, e in enumerate(edges):
                            if not len(e):
                                continue
                            c = code[rows, f]
                            gs, hs, ns = (np.bincount(c, w, len(e) + 1)[:-1].cumsum() for w in (g, h, np.ones(len(rows))))
                            gain = gs**2 / (hs + self.l2) + (g.sum() - gs) ** 2 / (h.sum() - hs + self.l2) - whole
                            gain[(ns < self.leaf) | (len(rows) - ns < self.leaf)] = 0
                            k = int(gain.argmax())
                            if gain[k] > best[0]:
                                best = (gain[k], f, e[k], None)
                    feature[at], cut[at] = best[1], best[2]
                    node[rows] = 2 * at + (x[rows, best[1]] > best[2])
            value = np.zeros(n)
            for k in range(n):
                rows = node == n + k
                value[k] = self.rate * grad[rows].sum() / (hess[rows].sum() + self.l2)
            score += value[node - n]
            self.model.append((feature, cut, value))
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for feature, cut, value in self.model:
            at = np.ones(len(x), int)
            for _ in range(self.depth):
                at = 2 * at + (x[rows, feature[at]] > cut[at])
            score += value[at - len(value)]
        return score


def platt(score: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(a, b) such that 1 / (1 + exp(-(a score + b))) is calibrated on the given rows."""
    a, b = 1.0, 0.0
    t = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * score + b, -40, 40)))
        g = np.array([((p - t) * score).sum(), (p - t).sum()])
        w = np.maximum(p * (1 - p), 1e-9)
        h = np.array([[(w * score**2).sum() + 1e-3, (w * score).sum()], [(w * score).sum(), w.sum() + 1e-3]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-7:
            break
    return float(a), float(b)
