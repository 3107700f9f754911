"""Isotonic calibration: the nearest rising step function, by pooling adjacent violators."""

from __future__ import annotations

import numpy as np


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, prior: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Points ``(x, p)`` between which a score is interpolated. ``prior`` rows of the mean are added to each pool."""
    weight = np.ones(len(x)) if weight is None else weight
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []  # weight, sum of y, sum of x
    for i in order:
        pools.append([weight[i], weight[i] * y[i], weight[i] * x[i]])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    if not pools:
        return np.array([0.0]), np.array([0.5])
    w, sy, sx = np.array(pools).T
    mean = sy.sum() / w.sum()
    return sx / w, np.maximum.accumulate((sy + prior * mean) / (w + prior))


def calibrated(points: tuple[np.ndarray, np.ndarray], score: np.ndarray) -> np.ndarray:
    return np.clip(np.interp(score, *points), 0.0, 1.0)
