"""Small logistic models trained on the driver from a bounded number of rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 12) -> tuple[np.ndarray, float]:
    """Coefficients and intercept by Newton steps; y in 0..1 may be soft.

    With no rows, or labels all alike, the coefficients are 0 and the intercept is the smoothed log odds.
    """
    x = np.concatenate([x.astype(np.float32), np.ones((len(x), 1), np.float32)], 1)
    return fit_blocks(lambda a, b: x[a:b], x.shape[1] - 1, y, ridge, rounds, max(len(x), 1))


def fit_blocks(block: Callable[[int, int], np.ndarray], d: int, y: np.ndarray, ridge: float = 1.0, rounds: int = 12, size: int = 2048) -> tuple[np.ndarray, float]:
    """fit_logistic where block(a, b) gives rows a to b of d features and a one, as 32-bit floats: only a block of rows is held at once."""
    n = len(y)
    rate = (y.sum() + 0.5) / (n + 1)
    w = np.zeros(d + 1)
    w[d] = np.log(rate / (1 - rate))
    if not n or y.min() == y.max():
        return w[:d], float(w[d])
    penalty = np.full(d + 1, ridge)
    penalty[d] = 1e-6
    for _ in range(rounds):
        slope, bend = np.zeros(d + 1), np.zeros((d + 1, d + 1))
        for at in range(0, n, size):
            x, truth = block(at, min(at + size, n)), y[at : at + size]
            p = sigmoid((x @ w.astype(np.float32)).astype(float))
            slope += x.T @ (truth - p).astype(np.float32)
            bend += x.T @ (x * np.maximum(p * (1 - p), 1e-4).astype(np.float32)[:, None])
        step = np.linalg.solve(bend + np.diag(penalty), slope - penalty * w)
        w += step * min(1.0, 4 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-4:
            break
    return w[:d], float(w[d])
