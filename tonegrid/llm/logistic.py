"""Small logistic models, fitted on bounded samples."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, l2: float = 1e-2, steps: int = 30, weights: np.ndarray | None = None) -> np.ndarray:
    """Newton's method for weighted logistic loss with an L2 penalty; the columns of x are the model."""
    w = np.zeros(x.shape[1])
    c = np.ones(len(y)) if weights is None else weights
    for _ in range(steps):
        p = sigmoid(x @ w)
        grad = x.T @ (c * (p - y)) / len(y) + l2 * w
        hess = (x * (c * p * (1 - p))[:, None]).T @ x / len(y) + l2 * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w
