"""Follow-the-regularised-leader with elastic net for sparse multinomial logistic regression."""

from __future__ import annotations

import numpy as np


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]], dim: int, classes: int, alpha: float = 0.5, beta: float = 1.0,
        l1: float = 0.05, l2: float = 0.01, epochs: int = 2) -> np.ndarray:
    """Weights (dim, classes) from rows of (indices, values, target distribution), one pass per epoch in a fixed shuffled order."""
    z, n = np.zeros((dim, classes)), np.zeros((dim, classes))
    rng = np.random.default_rng(7)

    def weights(z, n):
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))

    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            i, v, t = rows[k]
            w = weights(z[i], n[i])
            g = v[:, None] * (softmax(v @ w) - t)[None, :]
            grown = n[i] + g * g
            z[i] += g - (np.sqrt(grown) - np.sqrt(n[i])) / alpha * w
            n[i] = grown
    return weights(z, n)


def fit_two(rows: list[tuple[np.ndarray, np.ndarray, float]], dim: int, alpha: float = 0.5, beta: float = 1.0,
            l1: float = 0.05, l2: float = 0.01, epochs: int = 2) -> np.ndarray:
    """``fit`` for two classes, from rows of (distinct indices, values, share of the second class): the weights of the
    second class less those of the first. The two are each other's negative throughout, so one column is enough."""
    z, n = np.zeros(dim), np.zeros(dim)
    rng = np.random.default_rng(7)

    def weights(z, root):
        return (np.clip(z, -l1, l1) - z) / ((beta + root) / alpha + l2)

    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            i, v, t = rows[k]
            zi, ni = z[i], n[i]
            root = np.sqrt(ni)
            w = weights(zi, root)
            g = v * (1 / (1 + np.exp(-np.clip(2 * (v @ w), -60, 60))) - t)
            ni += g * g
            z[i] = zi + g - (np.sqrt(ni) - root) / alpha * w
            n[i] = ni
    return 2 * weights(z, np.sqrt(n))


def temperature(logits: np.ndarray, targets: np.ndarray) -> float:
    """The temperature with least log loss, by golden-section search over its logarithm."""
    if not len(logits):
        return 1.0

    def loss(log_t):
        p = softmax(logits / np.exp(log_t))
        return -np.log(np.maximum((p * targets).sum(axis=1), 1e-12)).mean()

    lo, hi, ratio = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
        lo, hi = (lo, b) if loss(a) <= loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))
