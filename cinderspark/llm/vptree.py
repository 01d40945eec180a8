"""Vantage-point trees over 64-bit fingerprints under Hamming distance.

A node splits its points by their distance to a vantage point: within the median
distance, or beyond.  By the triangle inequality a point within ``r`` of a
query lies on a side that the query's own distance, give or take ``r``, reaches,
so a branch beyond that is pruned.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


@dataclass
class Routing:
    """The upper levels of a tree, in heap order: node k has children 2k+1 (inside) and 2k+2 (outside)."""

    vantage: np.ndarray  # uint64
    radius: np.ndarray  # int: inside when distance <= radius
    depth: int

    @property
    def leaves(self) -> int:
        return 1 << self.depth

    def home(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (distance(points, self.vantage[node]) > self.radius[node])
        return node - (self.leaves - 1)

    def visits(self, points: np.ndarray, r: int) -> tuple[np.ndarray, np.ndarray]:
        """(index of a point, leaf) for every leaf that may hold something within r of it."""
        who, node = np.arange(len(points)), np.zeros(len(points), np.int64)
        for _ in range(self.depth):
            d = distance(points[who], self.vantage[node]).astype(np.int64)
            m = self.radius[node]
            inside, outside = d - r <= m, d + r > m
            who, node = np.concatenate([who[inside], who[outside]]), np.concatenate([2 * node[inside] + 1, 2 * node[outside] + 2])
        return who, node - (self.leaves - 1)


def fit_routing(sample: np.ndarray, depth: int, seed: int = 7) -> Routing:
    """Median splits of a sample; where a node has no sample left, a random vantage point and 32 bits."""
    rng = np.random.default_rng(seed)
    size = (1 << depth) - 1
    vantage = rng.integers(0, 2**64, size, np.uint64)
    radius = np.full(size, 32, np.int64)
    held = {0: np.unique(sample)}
    for node in range(size):
        points = held.pop(node, np.zeros(0, np.uint64))
        if len(points) >= 2:
            vantage[node], radius[node] = _split(points, rng)
        if 2 * node + 1 < size:
            inside = distance(points, vantage[node]) <= radius[node]
            held[2 * node + 1], held[2 * node + 2] = points[inside], points[~inside]
    return Routing(vantage, radius, depth)


def _split(points: np.ndarray, rng: np.random.Generator, tries: int = 5) -> tuple[np.uint64, int]:
    """Of a few vantage points, the one whose distances spread most; its median distance."""
    best = None
    for v in rng.choice(points, tries):
        d = distance(points, v)
        m = int(np.median(d))
        if (d > m).sum() == 0:
            m -= 1
        score = (float(d.std()), -abs(float((d <= m).mean()) - 0.5))
        if best is None or score > best[0]:
            best = (score, v, m)
    return best[1], best[2]


class Forest:
    """Disjoint sets over 0..n-1, joined by arrays of pairs."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self, x: np.ndarray) -> np.ndarray:
        p = self.parent
        x = p[x]
        while True:
            up = p[x]
            if np.array_equal(up, x):
                return x
            x = up

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.roots(a), self.roots(b)
            differ = a != b
            if not differ.any():
                return
            a, b = a[differ], b[differ]
            low, high = np.minimum(a, b), np.maximum(a, b)
            np.minimum.at(self.parent, high, low)
            a, b = low, high


#: A leaf of the local tree is compared with its queries in full.
LEAF = 192
#: Comparisons made at once.
BLOCK = 4_000_000


def link(residents: np.ndarray, visitors: np.ndarray, r: int, seed: int = 11, own: bool = True) -> np.ndarray:
    """Component root (an index into residents then visitors) of each point.

    Joined are visitors within r of a resident and, if ``own``, residents within
    r of each other.  Pairs are joined as they are found, never listed.
    """
    points = np.concatenate([residents, visitors])
    forest = Forest(len(points))
    rng = np.random.default_rng(seed)
    stack = [(np.arange(len(residents)), np.arange(0 if own else len(residents), len(points)))]
    while stack:
        held, queries = stack.pop()
        if not len(held) or not len(queries):
            continue
        if len(held) <= LEAF:
            _compare(points, held, queries, r, forest)
            continue
        v, m = _split(points[held] if len(held) <= 4096 else points[rng.choice(held, 4096)], rng)
        inside = distance(points[held], v) <= m
        if inside.all() or not inside.any():
            _compare(points, held, queries, r, forest)
            continue
        d = distance(points[queries], v).astype(np.int64)
        stack.append((held[inside], queries[d - r <= m]))
        stack.append((held[~inside], queries[d + r > m]))
    return forest.roots(np.arange(len(points)))


def _compare(points: np.ndarray, own: np.ndarray, queries: np.ndarray, r: int, forest: Forest) -> None:
    step = max(1, BLOCK // len(own))
    mine = points[own]
    for s in range(0, len(queries), step):
        q = queries[s : s + step]
        i, j = np.nonzero(np.bitwise_count(points[q][:, None] ^ mine[None, :]) <= r)
        a, b = q[i], own[j]
        other = a != b
        if other.any():
            a, b = forest.roots(a[other]), forest.roots(b[other])
            differ = a != b
            if differ.any():
                pairs = np.unique((a[differ] << 32) | b[differ])
                forest.join(pairs >> 32, pairs & 0xFFFFFFFF)
