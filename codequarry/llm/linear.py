"""Linear models trained with follow-the-regularised-leader, and their calibration."""

from __future__ import annotations

import numpy as np


class Ftrl:
    """Softmax regression by FTRL-proximal with L1 and L2 penalties; weights stay sparse.

    One row of weights by hashed feature, one column by class; the last row is the bias, which
    is not penalised.
    """

    def __init__(
        self, features: int, classes: int, alpha: float = 0.3, l1: float = 0.2, l2: float = 0.2
    ):
        self.z = np.zeros((features + 1, classes))
        self.n = np.zeros((features + 1, classes))
        self.alpha, self.l1, self.l2 = alpha, l1, l2

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        step = (1.0 + np.sqrt(n)) / self.alpha + self.l2
        return -np.sign(z) * np.maximum(np.abs(z) - self.l1, 0) / step

    def _bias(self) -> np.ndarray:
        return -self.z[-1] * self.alpha / (1.0 + np.sqrt(self.n[-1]))

    def fit(
        self,
        rows: list[tuple[np.ndarray, np.ndarray]],
        labels: list[int],
        epochs: int = 3,
        seed: int = 7,
        importance: np.ndarray | None = None,
    ) -> Ftrl:
        order = np.random.default_rng(seed)
        for _ in range(epochs):
            for k in order.permutation(len(rows)).tolist():
                at, values = rows[k]
                w, bias = self.weights(at), self._bias()
                p = softmax(values @ w + bias)
                p[labels[k]] -= 1.0
                if importance is not None:
                    p = p * importance[k]
                g = values[:, None] * p[None, :]
                sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
                self.z[at] += g - sigma * w
                self.n[at] += g * g
                drift = (np.sqrt(self.n[-1] + p * p) - np.sqrt(self.n[-1])) / self.alpha
                self.z[-1] += p - drift * bias
                self.n[-1] += p * p
        return self

    def scores(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        w, bias = self.weights(), self._bias()
        return np.array([v @ w[at] + bias for at, v in rows]).reshape(len(rows), self.z.shape[1])

    def parameters(self) -> tuple[np.ndarray, np.ndarray]:
        return self.weights()[:-1].astype(np.float32), self._bias()


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def temperature(scores: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of scores that makes held-back labels most likely (golden section)."""
    if not len(labels):
        return 1.0

    def loss(log_t: float) -> float:
        p = softmax(scores / np.exp(log_t))[np.arange(len(labels)), labels]
        return float(-np.log(np.maximum(p, 1e-12)).mean())

    low, high, ratio = np.log(0.05), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        if loss(a) <= loss(b):
            high = b
        else:
            low = a
    return float(np.exp((low + high) / 2))
