"""Gradient-boosted trees on binned features, and isotonic calibration, in numpy."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Boosted:
    """Logistic boosting with trees of a fixed depth, stored as complete binary heaps."""

    edges: list[np.ndarray]
    depth: int
    base: float
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)  # feature, bin, leaf value

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1).astype(np.uint8)

    def margin(self, x: np.ndarray) -> np.ndarray:
        bins = self.binned(x)
        out, row = np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (bins[row, feature[node]] > cut[node])
            out += value[node - (2**self.depth - 1)]
        return out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 120, depth: int = 3, rate: float = 0.12, bins: int = 48, ridge: float = 2.0, least: float = 8.0) -> Boosted:
    """Second-order boosting of the log loss; deterministic. ``least``: rows on each side of a split."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    share = np.clip(y.mean(), 1e-4, 1 - 1e-4)
    model = Boosted(edges, depth, float(np.log(share / (1 - share))))
    b = model.binned(x)
    margin = np.full(len(x), model.base)
    width = bins + 1
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        feature, cut = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, width, np.int64)
        node = np.zeros(len(x), np.int64)
        for level in range(depth):
            low, n = 2**level - 1, 2**level
            local = node - low
            best = np.full(n, 1e-9)
            for j in range(x.shape[1]):
                at = local * width + b[:, j]
                gs, hs, cs = (np.bincount(at, w, n * width).reshape(n, width).cumsum(1) for w in (g, h, np.ones(len(x))))
                gt, ht, ct = gs[:, -1:], hs[:, -1:], cs[:, -1:]
                gain = gs**2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt**2 / (ht + ridge)
                gain[(cs < least) | (ct - cs < least)] = 0
                k = gain.argmax(1)
                top = gain[np.arange(n), k]
                better = top > best
                best[better], feature[low + np.flatnonzero(better)], cut[low + np.flatnonzero(better)] = top[better], j, k[better]
            node = 2 * node + 1 + (b[np.arange(len(x)), feature[node]] > cut[node])
        leaf = node - (2**depth - 1)
        value = -rate * np.bincount(leaf, g, 2**depth) / (np.bincount(leaf, h, 2**depth) + ridge)
        model.trees.append((feature, cut, value))
        margin += value[leaf]
    return model


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots (score, probability) of the non-decreasing least-squares fit, by pooling adjacent violators.

    Pools are smoothed by one row of the mean, so that a small pool isn't certain.
    """
    order = np.argsort(score, kind="stable")
    pools: list[list[float]] = []  # sum, count, sum of scores
    for s, v in zip(score[order], y[order], strict=True):
        pools.append([float(v), 1.0, float(s)])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            a = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], a, strict=True)]
    mean = float(y.mean()) if len(y) else 0.5
    at = np.array([p[2] / p[1] for p in pools] or [0.0])
    value = np.array([(p[0] + mean) / (p[1] + 1) for p in pools] or [mean])
    return at, np.maximum.accumulate(value)
