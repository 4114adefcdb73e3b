"""Logistic calibration of classifier margins."""

from __future__ import annotations

import numpy as np


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35.0, 35.0)))


def fit_platt(margin: np.ndarray, y: np.ndarray, steps: int = 100) -> tuple[float, float]:
    """(a, b) of P(y = 1) = sigmoid(a * margin + b), by Newton steps on smoothed targets; a is kept positive."""
    pos, neg = float((y == 1).sum()), float((y != 1).sum())
    target = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = sigmoid(a * margin + b)
        g, h = p - target, np.maximum(p * (1 - p), 1e-9)
        grad = np.array([(g * margin).sum() + 1e-3 * (a - 1), g.sum() + 1e-3 * b])
        hess = np.array([[(h * margin * margin).sum() + 1e-3, (h * margin).sum()], [(h * margin).sum(), h.sum() + 1e-3]])
        step = np.linalg.solve(hess, grad)
        step *= min(1.0, 2.0 / max(1e-12, float(np.abs(step).max())))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return max(a, 1e-3), b
