"""Isotonic regression by pooling adjacent violators, on bounded samples of scored labels."""

from __future__ import annotations

import numpy as np


def isotonic(x: np.ndarray, y: np.ndarray, prior: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Knots (x, value) of the non-decreasing least-squares fit; equal x are one point.

    Values are shrunk towards the mean by ``prior`` observations, so they stay inside (0, 1) for labels 0 and 1.
    Empty input: one knot of value 0.5.
    """
    if len(x) == 0:
        return np.array([0.0]), np.array([0.5])
    order = np.argsort(x, kind="stable")
    x, y = np.asarray(x, float)[order], np.asarray(y, float)[order]
    edges = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
    sums, counts = np.add.reduceat(y, edges), np.diff(np.r_[edges, len(x)]).astype(float)
    blocks: list[list[float]] = []  # first x, last x, sum, count
    for a, s, c in zip(x[edges], sums, counts, strict=True):
        blocks.append([a, a, s, c])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][3] >= blocks[-1][2] * blocks[-2][3]:
            _, b, s2, c2 = blocks.pop()
            blocks[-1][1:] = [b, blocks[-1][2] + s2, blocks[-1][3] + c2]
    mean = y.mean()
    at, value = [], []
    for a, b, s, c in blocks:
        v = (s + prior * mean) / (c + prior)
        at += [a, b] if b > a else [a]
        value += [v, v] if b > a else [v]
    return np.array(at), np.maximum.accumulate(np.array(value))


def apply(x: np.ndarray, knots: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Linear between knots, constant outside."""
    return np.interp(x, *knots)
