"""Gradient-boosted trees of fixed depth for small feature tables: logistic loss, whole levels split by histogram."""

from __future__ import annotations

import numpy as np


class Boosted:
    """``trees`` complete trees of ``depth`` levels over integer features in 0..bins-1."""

    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, penalty: float = 1.0):
        self.trees, self.depth, self.rate, self.bins, self.penalty = trees, depth, rate, bins, penalty
        self.splits: list[list[tuple[np.ndarray, np.ndarray]]] = []
        self.leaves: list[np.ndarray] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        raw = np.zeros(len(y))
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-raw))
            g, h, node = y - p, p * (1 - p), np.zeros(len(y), np.int64)
            levels = []
            for level in range(self.depth):
                nodes, best = 1 << level, np.full(1 << level, -np.inf)
                feature, cut = np.zeros(nodes, np.int64), np.full(nodes, self.bins)
                for f in range(x.shape[1]):
                    at = node * self.bins + x[:, f]
                    gl = np.bincount(at, g, nodes * self.bins).reshape(nodes, -1).cumsum(axis=1)
                    hl = np.bincount(at, h, nodes * self.bins).reshape(nodes, -1).cumsum(axis=1)
                    gain = gl**2 / (hl + self.penalty) + (gl[:, -1:] - gl) ** 2 / (hl[:, -1:] - hl + self.penalty)
                    top = gain.argmax(axis=1)
                    value = gain[np.arange(nodes), top]
                    better = value > best + 1e-9
                    best, feature, cut = np.where(better, value, best), np.where(better, f, feature), np.where(better, top, cut)
                levels.append((feature, cut))
                node = node * 2 + (x[np.arange(len(x)), feature[node]] > cut[node])
            leaf = self.rate * np.bincount(node, g, 1 << self.depth) / (np.bincount(node, h, 1 << self.depth) + self.penalty)
            self.splits.append(levels)
            self.leaves.append(leaf)
            raw += leaf[node]
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.zeros(len(x)), np.arange(len(x))
        for levels, leaf in zip(self.splits, self.leaves):
            node = np.zeros(len(x), np.int64)
            for feature, cut in levels:
                node = node * 2 + (x[rows, feature[node]] > cut[node])
            out += leaf[node]
        return out
