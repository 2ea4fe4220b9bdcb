"""Small numpy fits on the driver; what they see is bounded by documented parameters."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Buckets of the hash that picks bounded samples.
_DRAWS = 1 << 20


def drawn(key: Column | str, rows: int, bound: int, seed: int) -> Column:
    """Whether a row is in a sample of about `bound` of `rows` rows: a hash decides, so a retry draws the same."""
    share = min(1.0, bound / max(rows, 1))
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(_DRAWS)) < int(share * _DRAWS)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50, weight: np.ndarray | None = None) -> np.ndarray:
    """Weights (the last one the constant) of a ridge logistic regression by Newton's method; y may be probabilities."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    c = np.ones(len(x)) if weight is None else weight
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = sigmoid(x @ w)
        grad = x.T @ (c * (p - y)) + penalty * w
        hess = (x * (c * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def sparse_logistic(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, y: np.ndarray, size: int, ridge: float = 1e-3, steps: int = 300, rate: float = 0.5) -> tuple[np.ndarray, float]:
    """(weights, constant) by full-batch Adam on entries (rows, cols, values); y (n,) or (n, classes) may be probabilities."""
    used, cols = np.unique(cols, return_inverse=True)  # only these get weights
    full, size = size, len(used)
    many = y.ndim == 2
    k = y.shape[1] if many else 1
    target = y if many else y[:, None]
    w, b = np.zeros((size, k)), np.zeros(k)
    m, v = np.zeros((size + 1, k)), np.zeros((size + 1, k))
    n = len(y)
    by_row, by_col = np.argsort(rows, kind="stable"), np.argsort(cols, kind="stable")
    lines, at_row = np.unique(rows[by_row], return_index=True)
    _, at_col = np.unique(cols[by_col], return_index=True)
    col_r, value_r, row_c, value_c = cols[by_row], values[by_row], rows[by_col], values[by_col]
    for t in range(1, steps + 1):
        z = np.tile(b, (n, 1))
        if len(lines):
            for j in range(k):
                z[lines, j] += np.add.reduceat(value_r * w[:, j][col_r], at_row)
        if many:
            e = np.exp(z - z.max(1, keepdims=True))
            p = e / e.sum(1, keepdims=True)
        else:
            p = sigmoid(z)
        d = (p - target) / n
        of_col = np.column_stack([np.add.reduceat(value_c * d[:, j][row_c], at_col) for j in range(k)]) if size else w
        grad = np.vstack([of_col + ridge * w / n, d.sum(0)])
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad * grad
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8) * (1 - (t - 1) / steps)
        w -= step[:-1]
        b -= step[-1]
    out = np.zeros((full, k))
    out[used] = w
    return (out, b) if many else (out[:, 0], float(b[0]))
