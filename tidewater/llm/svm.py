"""Linear support vector machine for a bounded sample: dual coordinate descent on the hinge loss."""

from __future__ import annotations

import numpy as np


def fit_svm(x: np.ndarray, positive: np.ndarray, rows: np.ndarray | None = None, c: float = 1.0, epochs: int = 20, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and bias from the rows of ``x`` (those numbered in ``rows``, without copying them). The
    classes are weighted to equal totals; features are scaled by the mean norm, and the bias is a constant
    feature. The same rows in the same order give the same result. With one class only, the weights are 0
    and the bias is that class's sign."""
    rows = np.arange(len(x)) if rows is None else rows
    y = np.where(positive[rows], 1.0, -1.0)
    n, n_pos = len(rows), int((y > 0).sum())
    if n_pos in (0, n):
        return np.zeros(x.shape[1]), 1.0 if n_pos else -1.0
    norms = np.array([float(x[r] @ x[r]) for r in rows])
    scale = float(np.sqrt(norms).mean()) or 1.0
    norms = norms / scale**2 + 1
    most = c * np.where(y > 0, n / (2 * n_pos), n / (2 * (n - n_pos)))
    w, bias, alpha = np.zeros(x.shape[1]), 0.0, np.zeros(n)
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in order.permutation(n):
            row = x[rows[i]]
            new = min(most[i], max(0.0, alpha[i] + (1 - y[i] * ((row @ w) / scale + bias)) / norms[i]))
            step = new - alpha[i]
            if step:
                moved = max(moved, abs(step) * norms[i])
                w += (step * y[i] / scale) * row
                bias += step * y[i]
                alpha[i] = new
        if moved < 1e-3:
            break
    return w / scale, float(bias)
