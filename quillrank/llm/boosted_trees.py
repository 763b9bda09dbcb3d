"""Gradient-boosted trees with monotonic constraints, trained on histograms and scored from flat node arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Trees:
    """All nodes of all trees in flat arrays. A leaf has feature -1 and points to itself, so a fixed number of steps ends in it."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    bias: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row; all trees are walked at once, a level a step."""
        at = np.repeat(self.roots[None, :], len(x), 0)
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            feature = self.feature[at]
            goes_left = x[rows, np.maximum(feature, 0)] <= self.threshold[at]
            at = np.where(feature < 0, at, np.where(goes_left, self.left[at], self.right[at]))
        return self.bias + self.value[at].sum(axis=1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def train(x: np.ndarray, y: np.ndarray, monotone: np.ndarray, n_trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, least: int = 8, ridge: float = 1.0) -> Trees:
    """Logistic loss, Newton steps. monotone: for each feature 1 (may only raise the score), -1 (only lower) or 0.

    A split on a constrained feature is taken only if its two values are in order, and their mean bounds the values of
    everything below, so the whole function is monotonic in that feature.
    """
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1) if len(x) else np.zeros(x.shape, int)
    share = np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99)
    margin, bias = np.full(len(y), np.log(share / (1 - share))), float(np.log(share / (1 - share)))
    nodes: list[list] = []
    roots = []

    def grow(rows: np.ndarray, grad: np.ndarray, hess: np.ndarray, level: int, low: float, high: float) -> int:
        me, g, h = len(nodes), grad[rows].sum(), hess[rows].sum()
        nodes.append([-1, 0.0, me, me, float(np.clip(-g / (h + ridge), low, high)) * rate])
        best = (1e-6, None)
        for j in range(x.shape[1]) if level < depth and len(rows) >= 2 * least else ():
            size = len(edges[j]) + 1
            gl, hl, nl = (np.bincount(binned[rows, j], w, size).cumsum()[:-1] for w in (grad[rows], hess[rows], None))
            if not len(gl):
                continue
            vl, vr = np.clip(-gl / (hl + ridge), low, high), np.clip(-(g - gl) / (h - hl + ridge), low, high)
            gain = -(gl * vl + (hl + ridge) * vl**2 / 2) - ((g - gl) * vr + (h - hl + ridge) * vr**2 / 2) - g * g / (h + ridge) / 2
            bad = (nl < least) | (len(rows) - nl < least) | (monotone[j] * (vr - vl) < 0)
            gain[bad] = -1
            if gain[k := int(gain.argmax())] > best[0]:
                best = (gain[k], (j, k, vl[k], vr[k]))
        if best[1]:
            j, k, vl, vr = best[1]
            goes_left, mid = binned[rows, j] <= k, (vl + vr) / 2
            ends = {0: ((low, high), (low, high)), 1: ((low, mid), (mid, high)), -1: ((mid, high), (low, mid))}[int(monotone[j])]
            a = grow(rows[goes_left], grad, hess, level + 1, *ends[0])
            b = grow(rows[~goes_left], grad, hess, level + 1, *ends[1])
            nodes[me][:4] = [j, float(edges[j][k]), a, b]
        return me

    def flat() -> Trees:
        cols = list(zip(*nodes, strict=True)) or [(), (), (), (), ()]
        kinds = (np.int32, np.float64, np.int32, np.int32, np.float64)
        return Trees(*(np.array(c, k) for c, k in zip(cols, kinds, strict=True)), np.array(roots, np.int32), depth, bias)

    for _ in range(n_trees if 0 < y.sum() < len(y) else 0):
        p = 1 / (1 + np.exp(-margin))
        first = len(nodes)
        roots.append(grow(np.arange(len(y)), p - y, p * (1 - p), 0, -np.inf, np.inf))
        tree = flat()
        margin += Trees(tree.feature, tree.threshold, tree.left, tree.right, tree.value, np.array([first]), depth, 0.0).margin(x)
    return flat()
