"""A small decision tree for numeric features (Gini, depth-bounded), grown on a few hundred rows."""

from __future__ import annotations

import numpy as np


class Tree:
    """Arrays of a binary tree: feature -1 marks a leaf whose value is the share of class 1."""

    def __init__(self, depth: int = 9, least: int = 2):
        self.depth, self.least = depth, least
        self.feature: list[int] = []
        self.cut: list[float] = []
        self.left: list[int] = []
        self.right: list[int] = []
        self.value: list[float] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Tree:
        self._grow(x, y.astype(float), 0)
        self._pack()
        return self

    def _node(self, value: float) -> int:
        for a, v in ((self.feature, -1), (self.cut, 0.0), (self.left, 0), (self.right, 0), (self.value, value)):
            a.append(v)
        return len(self.value) - 1

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int) -> int:
        me = self._node(float(y.mean()))
        if depth == self.depth or len(y) < 2 * self.least or y.min() == y.max():
            return me
        best = (1e-9, -1, 0.0)
        now = y.mean() * (1 - y.mean()) * len(y)
        for f in range(x.shape[1]):
            order = np.argsort(x[:, f], kind="stable")
            v, t = x[order, f], np.cumsum(y[order])
            n = np.arange(1, len(y))
            ok = (v[1:] > v[:-1]) & (n >= self.least) & (len(y) - n >= self.least)
            if not ok.any():
                continue
            a, b = t[:-1], t[-1] - t[:-1]
            gain = now - (a * (1 - a / n) + b * (1 - b / (len(y) - n)))
            gain[~ok] = -1
            k = int(gain.argmax())
            if gain[k] > best[0] + 1e-12:
                best = (float(gain[k]), f, float((v[k] + v[k + 1]) / 2))
        if best[1] < 0:
            return me
        _, f, cut = best
        goes = x[:, f] <= cut
        self.feature[me], self.cut[me] = f, cut
        self.left[me] = self._grow(x[goes], y[goes], depth + 1)
        self.right[me] = self._grow(x[~goes], y[~goes], depth + 1)
        return me

    def _pack(self) -> None:
        self.a = tuple(np.array(v) for v in (self.feature, self.cut, self.left, self.right, self.value))

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Share of class 1 in each row's leaf; level by level over all rows at once."""
        feature, cut, left, right, value = self.a
        at = np.zeros(len(x), dtype=np.int64)
        rows = np.arange(len(x))
        for _ in range(self.depth):
            f = feature[at]
            inner = f >= 0
            if not inner.any():
                break
            goes = x[rows, np.maximum(f, 0)] <= cut[at]
            at = np.where(inner, np.where(goes, left[at], right[at]), at)
        return value[at]


class Forest:
    """The mean of trees grown on fixed resamples of whole groups; one tree if trees = 1."""

    def __init__(self, trees: int = 25, depth: int = 9, least: int = 2):
        self.trees = [Tree(depth, least) for _ in range(trees)]

    def fit(self, x: np.ndarray, y: np.ndarray) -> Forest:
        rng = np.random.default_rng(7)
        for k, t in enumerate(self.trees):
            rows = np.arange(len(y)) if k == 0 else rng.integers(0, len(y), len(y))
            t.fit(x[rows], y[rows])
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        return np.mean([t.predict(x) for t in self.trees], axis=0)
