"""Small dense linear algebra without threaded libraries (some hundred rows at most)."""

from __future__ import annotations

import numpy as np


def inverse(matrix: np.ndarray) -> np.ndarray:
    """Gauss-Jordan elimination with row swaps."""
    n = len(matrix)
    both = np.hstack([matrix.astype(float), np.eye(n)])
    for i in range(n):
        pivot = i + int(np.abs(both[i:, i]).argmax())
        both[[i, pivot]] = both[[pivot, i]]
        both[i] /= both[i, i]
        factor = both[:, i].copy()
        factor[i] = 0
        rows = np.flatnonzero(factor)
        both[rows] -= factor[rows, None] * both[i]
    return both[:, n:]


def isotonic(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The non-descending sequence nearest to ``values`` (pool adjacent violators)."""
    means: list[float] = []
    sums: list[float] = []
    sizes: list[int] = []
    for v, w in zip(values.tolist(), weights.tolist(), strict=True):
        means.append(v)
        sums.append(w)
        sizes.append(1)
        while len(means) > 1 and means[-2] > means[-1]:
            total = sums[-2] + sums[-1]
            means[-2:] = [(means[-2] * sums[-2] + means[-1] * sums[-1]) / total]
            sums[-2:] = [total]
            sizes[-2:] = [sizes[-2] + sizes[-1]]
    return np.repeat(means, sizes)
