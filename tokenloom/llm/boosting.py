"""Small gradient-boosted trees and isotonic calibration in numpy, for models fitted on bounded samples."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Trees:
    """Boosted regression trees of fixed depth on binned features, for log-odds."""

    rounds: int = 60
    depth: int = 3
    rate: float = 0.15
    bins: int = 32
    ridge: float = 2.0
    least: float = 5.0
    edges: list[np.ndarray] = field(default_factory=list)
    base: float = 0.0
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)], axis=1).astype(np.int32)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        for j in range(x.shape[1]):  # features that are mostly 0 keep a cut just above it
            positive = x[x[:, j] > 0, j]
            if len(positive):
                self.edges[j] = np.unique(np.concatenate((self.edges[j], [0.0], np.quantile(positive, np.linspace(0, 1, self.bins // 2)))))
        binned, width = self._binned(x), max(len(e) for e in self.edges) + 1
        flat = binned + np.arange(x.shape[1]) * width
        p = np.clip(y.mean(), 1e-4, 1 - 1e-4)
        self.base = float(np.log(p / (1 - p)))
        score = np.full(len(y), self.base)
        for _ in range(self.rounds):
            prob = 1 / (1 + np.exp(-score))
            grad, hess = prob - y, np.maximum(prob * (1 - prob), 1e-6)
            split_on = np.zeros(2**self.depth - 1, np.int32)
            split_at = np.full(2**self.depth - 1, width, np.int32)
            node = np.zeros(len(y), np.int64)
            for level in range(self.depth):
                first, count = 2**level - 1, 2**level
                g = np.zeros((count, x.shape[1] * width))
                h = np.zeros_like(g)
                for j in range(x.shape[1]):
                    key = (node - first) * g.shape[1] + flat[:, j]
                    g += np.bincount(key, grad, g.size).reshape(g.shape)
                    h += np.bincount(key, hess, h.size).reshape(h.shape)
                gl = g.reshape(count, x.shape[1], width).cumsum(2)
                hl = h.reshape(count, x.shape[1], width).cumsum(2)
                gt, ht = gl[:, :1, -1:], hl[:, :1, -1:]
                gain = gl**2 / (hl + self.ridge) + (gt - gl) ** 2 / (ht - hl + self.ridge) - gt**2 / (ht + self.ridge)
                gain[(hl < self.least / 10) | (ht - hl < self.least / 10)] = 0
                best = gain.reshape(count, -1).argmax(1)
                for k in range(count):
                    if gain.reshape(count, -1)[k, best[k]] > 1e-9:
                        split_on[first + k], split_at[first + k] = divmod(int(best[k]), width)
                node = 2 * node + 1 + (binned[np.arange(len(y)), split_on[node]] > split_at[node])
            leaf = node - (2**self.depth - 1)
            value = -self.rate * np.bincount(leaf, grad, 2**self.depth) / (np.bincount(leaf, hess, 2**self.depth) + self.ridge)
            score += value[leaf]
            self.trees.append((split_on, split_at, value))
        return self

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        binned = self._binned(x)
        rows = np.arange(len(x))
        score = np.full(len(x), self.base)
        for split_on, split_at, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (binned[rows, split_on[node]] > split_at[node])
            score += value[node - (2**self.depth - 1)]
        return score


@dataclass
class Isotonic:
    """A non-decreasing step function from scores to probabilities, by pooling adjacent violators."""

    at: np.ndarray = field(default_factory=lambda: np.zeros(1))
    value: np.ndarray = field(default_factory=lambda: np.full(1, 0.5))

    def fit(self, score: np.ndarray, y: np.ndarray) -> Isotonic:
        if not len(score):
            return self
        at, inverse = np.unique(score, return_inverse=True)
        weight = np.bincount(inverse).astype(float)
        mean = np.bincount(inverse, y) / weight
        pools: list[list[float]] = []
        for k in range(len(at)):
            pools.append([mean[k], weight[k], at[k]])
            while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
                m, w, _ = pools.pop()
                a, b, s = pools[-1]
                pools[-1] = [(a * b + m * w) / (b + w), b + w, s]
        # one pseudo-count of each class keeps probabilities inside (0, 1)
        self.value = np.array([(m * w + 0.5) / (w + 1) for m, w, _ in pools])
        self.value = np.maximum.accumulate(self.value)
        self.at = np.array([s for _, _, s in pools])
        return self

    def predict(self, score: np.ndarray) -> np.ndarray:
        """Linear between the pools' first scores, so that ranks within a pool survive."""
        return np.interp(score, self.at, self.value)
