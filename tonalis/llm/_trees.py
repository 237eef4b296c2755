"""Histogram gradient-boosted trees in numpy: logistic loss, quantile bins, trees flattened into arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Forest:
    """Node i tests x[feature[i]] <= cut[i]: on to left[i] or right[i]. A leaf has feature -1 and leads to itself."""

    base: float
    roots: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        rows, total = np.arange(len(x)), np.full(len(x), self.base)
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                f = self.feature[at]
                at = np.where((f < 0) | (x[rows, f] <= self.cut[at]), self.left[at], self.right[at])
            total += self.value[at]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.15, ridge: float = 1.0, least: int = 20) -> Forest:
    """x: rows by features; y: 0/1. Without rows of both classes the forest is the (smoothed) base rate alone."""
    rate_1 = (y.sum() + 0.5) / (len(y) + 1)
    base, nodes, roots = float(np.log(rate_1 / (1 - rate_1))), [], []
    if 0 < y.sum() < len(y):
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
        b = np.stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T, strict=True)])
        raw = np.full(len(y), base)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-raw))
            roots.append(_grow(nodes, b, cuts, p - y, p * (1 - p), np.arange(len(y)), depth, rate, ridge, least, raw))
    z = nodes or [(-1, 0.0, 0, 0, 0.0)]
    f, c, left, right, v = zip(*z, strict=True)
    return Forest(base, np.array(roots, int), np.array(f), np.array(c), np.array(left), np.array(right), np.array(v), depth)


def _grow(nodes: list, b: np.ndarray, cuts: list, g: np.ndarray, h: np.ndarray, at: np.ndarray, depth: int, rate: float, ridge: float, least: int, raw: np.ndarray) -> int:
    me = len(nodes)
    gs, hs = g[at].sum(), h[at].sum()
    nodes.append((-1, 0.0, me, me, -rate * gs / (hs + ridge)))
    best = (1e-3, -1, -1)
    if depth and len(at) >= 2 * least:
        for f, c in enumerate(cuts):
            if not len(c):
                continue
            own, n = b[f, at], len(c) + 1
            gl, hl, nl = (np.cumsum(np.bincount(own, w, n))[:-1] for w in (g[at], h[at], None))
            gain = gl**2 / (hl + ridge) + (gs - gl) ** 2 / (hs - hl + ridge) - gs**2 / (hs + ridge)
            gain[(nl < least) | (len(at) - nl < least)] = 0
            if (k := int(gain.argmax())) >= 0 and gain[k] > best[0]:
                best = (gain[k], f, k)
    if best[1] < 0:
        raw[at] += nodes[me][4]
        return me
    _, f, k = best
    goes = b[f, at] <= k
    left = _grow(nodes, b, cuts, g, h, at[goes], depth - 1, rate, ridge, least, raw)
    right = _grow(nodes, b, cuts, g, h, at[~goes], depth - 1, rate, ridge, least, raw)
    nodes[me] = (f, float(cuts[f][k]), left, right, 0.0)
    return me
