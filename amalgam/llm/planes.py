"""What both searches share: vectors that take part, matrices of them, and hyperplanes that deal them out."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F


def usable(vector) -> F.Column:
    """True for vectors without null or non-finite components."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return vector.isNotNull() & F.coalesce(F.forall(vector.cast("array<double>"), fine), F.lit(False))


class Tree:
    """Hyperplanes that halve the sample, level by level."""

    def __init__(self, x: np.ndarray, depth: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.planes: dict[int, tuple[np.ndarray, float]] = {}
        parts = {1: np.arange(len(x))}
        for _ in range(depth):
            after = {}
            for node, rows in parts.items():
                a, b = x[rng.choice(rows, 2, replace=len(rows) < 2)] if len(rows) else (np.ones(x.shape[1]), np.zeros(x.shape[1]))
                d = a - b if (a != b).any() else rng.normal(size=x.shape[1])
                p = x[rows] @ d
                cut = float(np.median(p)) if len(rows) else 0.0
                self.planes[node] = (d, cut)
                after |= {2 * node: rows[p <= cut], 2 * node + 1: rows[p > cut]}
            parts = after

    def leaves(self, x: np.ndarray) -> np.ndarray:
        at = np.ones(len(x), dtype=np.int64)
        while True:
            moved = False
            for node in np.unique(at):
                if int(node) in self.planes:
                    d, cut = self.planes[int(node)]
                    on = at == node
                    at[on] = 2 * node + (x[on] @ d > cut)
                    moved = True
            if not moved:
                return at


def matrix(vectors, dim: int) -> np.ndarray:
    x = np.zeros((len(vectors), dim))
    for i, v in enumerate(vectors):
        x[i, : len(v)] = v
    return x
