"""Gradient-boosted trees for binary labels, small enough to fit on the driver and to send to every worker."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

DEPTH, TREES, RATE, BINS, LEAST, PENALTY = 4, 70, 0.2, 48, 8.0, 1.0


@dataclass
class Trees:
    """Complete trees of DEPTH: ``feature`` and ``cut`` of the inner nodes, ``value`` of the leaves, by tree."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    start: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.start), np.arange(len(x))
        inner = 2**DEPTH - 1
        for f, c, v in zip(self.feature, self.cut, self.value):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[rows, f[at]] > c[at])
            out += v[at - inner]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(x)))


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    """Level by level on binned features, second order, deterministic."""
    n, width = x.shape
    if not n:
        return Trees(np.zeros((0, 2**DEPTH - 1), np.int64), np.zeros((0, 2**DEPTH - 1)), np.zeros((0, 2**DEPTH)), 0.0)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(width)]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], 1)
    p = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    start = float(np.log(p / (1 - p)))
    score = np.full(n, start)
    inner, leaves = 2**DEPTH - 1, 2**DEPTH
    features, thresholds, values = [], [], []
    for _ in range(TREES):
        q = 1 / (1 + np.exp(-score))
        g, h = q - y, np.maximum(q * (1 - q), 1e-6)
        feature, cut, at = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(n, np.int64)
        for level in range(DEPTH):
            first, nodes = 2**level - 1, 2**level
            best = np.full(nodes, 1e-6)
            local = at - first
            for j in range(width):
                bins = len(cuts[j]) + 1
                if bins < 2:
                    continue
                slot = local * bins + binned[:, j]
                gs = np.bincount(slot, g, nodes * bins).reshape(nodes, bins).cumsum(1)
                hs = np.bincount(slot, h, nodes * bins).reshape(nodes, bins).cumsum(1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gl, hl = gs[:, :-1], hs[:, :-1]
                gain = gl**2 / (hl + PENALTY) + (gt - gl) ** 2 / (ht - hl + PENALTY) - gt**2 / (ht + PENALTY)
                gain[(hl < LEAST / 4) | (ht - hl < LEAST / 4)] = -1
                k = gain.argmax(1)
                top = gain[np.arange(nodes), k]
                for node in np.flatnonzero(top > best):
                    best[node], feature[first + node], cut[first + node] = top[node], j, cuts[j][k[node]]
            at = 2 * at + 1 + (x[np.arange(n), feature[at]] > cut[at])
        leaf = at - inner
        value = -RATE * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + PENALTY)
        score = score + value[leaf]
        features.append(feature), thresholds.append(cut), values.append(value)
    shape = (len(features), inner)
    return Trees(np.array(features, np.int64).reshape(shape), np.array(thresholds, float).reshape(shape), np.array(values, float).reshape(len(values), leaves), start)


@dataclass
class Calibration:
    """Monotone map from scores to shares of labelled cases, by pooling adjacent violators."""

    edges: np.ndarray
    shares: np.ndarray

    def __call__(self, p: np.ndarray) -> np.ndarray:
        return np.interp(p, self.edges, self.shares) if len(self.edges) else p


def calibrate(p: np.ndarray, y: np.ndarray, bins: int = 25) -> Calibration:
    if len(p) < 2 * bins:
        return Calibration(np.array([]), np.array([]))
    order = np.argsort(p, kind="stable")
    blocks: list[list[float]] = []
    for part in np.array_split(order, bins):
        blocks.append([float(p[part].mean()), float(y[part].mean()), float(len(part))])
        while len(blocks) > 1 and blocks[-2][1] >= blocks[-1][1]:
            b, a = blocks.pop(), blocks.pop()
            w = a[2] + b[2]
            blocks.append([(a[0] * a[2] + b[0] * b[2]) / w, (a[1] * a[2] + b[1] * b[2]) / w, w])
    return Calibration(np.array([b[0] for b in blocks]), np.array([b[1] for b in blocks]))
