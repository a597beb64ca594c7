"""Small numpy trainers shared by the text classifiers."""

from __future__ import annotations

import numpy as np


def dual_coordinate_descent(indptr: np.ndarray, indices: np.ndarray, data: np.ndarray, y: np.ndarray, n_features: int, cost: np.ndarray, epochs: int = 20, seed: int = 7) -> np.ndarray:
    """Weights of an L2-regularised hinge-loss model over CSR rows; ``y`` is -1 or 1, ``cost`` bounds each dual variable.

    Each step solves one dual variable exactly and updates the weights of that row; an epoch
    visits the rows in random order, and training ends early once no step moves a variable.
    """
    rng = np.random.default_rng(seed)
    w, alpha = np.zeros(n_features), np.zeros(len(y))
    norm = np.array([np.dot(data[a:b], data[a:b]) for a, b in zip(indptr[:-1], indptr[1:], strict=True)])
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(y)):
            if norm[i] <= 0:
                continue
            at = slice(indptr[i], indptr[i + 1])
            ix, x = indices[at], data[at]
            slope = y[i] * np.dot(w[ix], x) - 1
            new = min(max(alpha[i] - slope / norm[i], 0.0), cost[i])
            step = new - alpha[i]
            if step:
                w[ix] += step * y[i] * x
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-4:
            break
    return w


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """Coefficients of a logistic curve fitted by Newton steps, with smoothed targets; the last column of ``x`` is constant."""
    pos, neg = int((y > 0).sum()), int((y <= 0).sum())
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    scale = np.abs(x).max(axis=0) + 1e-9
    z, c = x / scale, np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ c, -30, 30)))
        v = p * (1 - p) + 1e-9
        step = np.linalg.solve((z * v[:, None]).T @ z + ridge * np.eye(len(c)), z.T @ (p - t) + ridge * c)
        c = c - step
        if np.abs(step).max() < 1e-8:
            break
    return c / scale


def platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve from margins to scores."""
    slope, offset = logistic(np.column_stack([margin, np.ones(len(margin))]), y)
    return float(slope), float(offset)
