"""Gradient-boosted regression trees over histograms, for samples that one task can hold.

Features are cut into at most BINS bins by their quantiles, or by their values
where they are categories.  A tree grows level by level: one pass over the rows
sums residuals by node, feature and bin, and each node takes the cut that lowers
the squared error most; the bins of a category are put in the order of their
mean residual first.  A node's cut is a table of the bins that go left, so
numbers and categories are predicted alike.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

BINS = 255
#: Rows that a sample may have: it is fitted in one task.
MOST_ROWS = 500_000


def binned(column: np.ndarray, edges: np.ndarray, category: bool) -> np.ndarray:
    """Bin of each value: right-open between edges; of a category, its place among the known ones, else the last bin."""
    if not category:
        return np.searchsorted(edges, column, side="right")
    at = np.minimum(np.searchsorted(edges, column), max(len(edges) - 1, 0))
    return np.where(edges[at] == column, at, BINS) if len(edges) else np.full(len(column), BINS)


@dataclass
class Trees:
    rate: float = 0.06
    depth: int = 6
    least: int = 20  # rows of a leaf
    start: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    categories: tuple[int, ...] = ()
    #: For each tree, its levels: (feature of each node, bins that go left); and its leaves' values.
    trees: list[tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]] = field(default_factory=list)

    def _bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([binned(x[:, f], e, f in self.categories) for f, e in enumerate(self.edges)], 1) if len(x) else np.zeros((0, len(self.edges)), int)

    def fit(self, x: np.ndarray, y: np.ndarray, trees: int, categories: tuple[int, ...] = ()) -> Trees:
        if len(y) > MOST_ROWS:
            raise ValueError(f"{len(y)} rows are over {MOST_ROWS}: draw a sample first")
        self.categories = categories
        cuts = np.arange(1, BINS) / BINS
        self.edges = [np.unique(x[:, f])[:BINS] if f in categories else np.unique(np.quantile(x[:, f], cuts)) if len(x) else np.zeros(0) for f in range(x.shape[1])]
        self.start = float(y.mean()) if len(y) else 0.0
        bins = self._bins(x)
        guess = np.full(len(y), self.start)
        for _ in range(trees if len(y) else 0):
            levels, values, leaf = self._grow(bins, y - guess)
            self.trees.append((levels, values))
            guess += values[leaf]
        return self

    def _grow(self, bins: np.ndarray, residual: np.ndarray) -> tuple[list, np.ndarray, np.ndarray]:
        node = np.zeros(len(residual), np.int64)
        levels = []
        width = BINS + 1
        for level in range(self.depth):
            nodes = 1 << level
            best = np.full(nodes, 1e-12)
            feature = np.zeros(nodes, np.int64)
            left = np.ones((nodes, width), bool)  # a node without a cut sends all rows left
            for f in range(bins.shape[1]):
                key = node * width + bins[:, f]
                count = np.bincount(key, minlength=nodes * width).reshape(nodes, width)
                total = np.bincount(key, residual, nodes * width).reshape(nodes, width)
                order = np.broadcast_to(np.arange(width), count.shape)
                if f in self.categories:
                    order = np.argsort(np.where(count > 0, total / np.maximum(count, 1), np.inf), 1, kind="stable")
                    count, total = np.take_along_axis(count, order, 1), np.take_along_axis(total, order, 1)
                n, s = count.cumsum(1), total.cumsum(1)
                rest, other = n[:, -1:] - n, s[:, -1:] - s
                gain = np.where(
                    (n >= self.least) & (rest >= self.least),
                    s**2 / np.maximum(n, 1) + other**2 / np.maximum(rest, 1) - s[:, -1:] ** 2 / np.maximum(n[:, -1:], 1),
                    -np.inf,
                )
                at = gain.argmax(1)
                better = np.flatnonzero(gain[np.arange(nodes), at] > best)
                for k in better.tolist():
                    best[k], feature[k] = gain[k, at[k]], f
                    left[k] = False
                    left[k, order[k, : at[k] + 1]] = True
            levels.append((feature, left))
            node = 2 * node + ~left[node, bins[np.arange(len(node)), feature[node]]]
        size = 1 << self.depth
        count = np.bincount(node, minlength=size)
        values = self.rate * np.bincount(node, residual, size) / np.maximum(count, 1)
        return levels, values, node

    def predict(self, x: np.ndarray) -> np.ndarray:
        bins = self._bins(x)
        rows = np.arange(len(x))
        out = np.full(len(x), self.start)
        for levels, values in self.trees:
            node = np.zeros(len(x), np.int64)
            for feature, left in levels:
                node = 2 * node + ~left[node, bins[rows, feature[node]]]
            out += values[node]
        return out


def r2(y: np.ndarray, guess: np.ndarray) -> float:
    """Share of the variance that is explained; 0 where there is none."""
    spread = float(((y - y.mean()) ** 2).sum()) if len(y) else 0.0
    return 1 - float(((y - guess) ** 2).sum()) / spread if spread else 0.0
