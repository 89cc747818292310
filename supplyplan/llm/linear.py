"""Small helpers to fit linear models on a bounded sample of sparse rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


class Rows:
    """Sparse rows: the features of row i are columns[bounds[i]:bounds[i + 1]]."""

    def __init__(self, bounds: np.ndarray, columns: np.ndarray, values: np.ndarray, width: int):
        self.bounds, self.columns, self.values, self.width = bounds, columns, values, width
        self.row = np.repeat(np.arange(len(bounds) - 1, dtype=np.int32), np.diff(bounds))

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.values * w[self.columns], len(self))

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.columns, self.values * g[self.row], self.width)

    def some(self, keep: np.ndarray) -> "Rows":
        on = keep[self.row]
        counts = np.diff(self.bounds)[keep]
        return Rows(np.concatenate([[0], np.cumsum(counts)]), self.columns[on], self.values[on], self.width)


def minimized(gradient: Callable[[np.ndarray], np.ndarray], start: np.ndarray, steps: int, rate: float) -> np.ndarray:
    """Adam over the whole sample, with a rate that falls to zero."""
    x = start.astype(float).copy()
    m, v = np.zeros_like(x), np.zeros_like(x)
    for k in range(1, steps + 1):
        g = gradient(x)
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        x -= rate * (1 - (k - 1) / steps) * (m / (1 - 0.9 ** k)) / (np.sqrt(v / (1 - 0.99 ** k)) + 1e-8)
    return x


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))
