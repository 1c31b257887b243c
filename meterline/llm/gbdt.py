"""Gradient-boosted trees for binary labels: histogram splits, monotonic constraints, flat node arrays for scoring."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class FlatTrees:
    """All trees in five parallel arrays. A row goes left where its feature is at most the threshold; a leaf points
    at itself, so scoring walks ``depth`` steps for all rows and trees at once."""

    base: float
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int

    def logit(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of label 1 for each row of ``x``; rows are taken a few thousand at a time."""
        out = np.full(len(x), self.base)
        for at in range(0, len(x), 4096):
            part = x[at : at + 4096]
            rows = np.arange(len(part))[:, None]
            node = np.broadcast_to(self.roots, (len(part), len(self.roots)))
            for _ in range(self.depth):
                go_left = part[rows, self.feature[node]] <= self.threshold[node]
                node = np.where(go_left, self.left[node], self.right[node])
            out[at : at + 4096] += self.value[node].sum(axis=1)
        return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(
    x: np.ndarray,
    y: np.ndarray,
    monotone: list[int] | None = None,
    trees: int = 60,
    depth: int = 3,
    rate: float = 0.15,
    bins: int = 48,
    least: float = 1.0,
    l2: float = 1.0,
) -> FlatTrees:
    """Newton boosting. ``monotone`` holds +1, -1 or 0 for each feature: with +1 the score never falls as it rises.

    A split that would break its feature's order is not taken, and the mean of the two children's values bounds
    everything below them, so the order holds for the whole model. Labels of one class only, or no rows, give a
    constant model. The result is the same for any order of the rows up to rounding of sums.
    """
    n, width = x.shape
    monotone = monotone or [0] * width
    rate_of_one = (y.sum() + 0.5) / (n + 1.0)
    base = float(np.log(rate_of_one / (1 - rate_of_one)))
    nodes: list[list[float]] = []  # feature, threshold, left, right, value
    roots = []
    if n and 0 < y.sum() < n:
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
        code = np.stack([np.searchsorted(edges[f], x[:, f], side="left") for f in range(width)])
        z = np.full(n, base)
        for _ in range(trees):
            p = sigmoid(z)
            grad, hess = p - y, p * (1 - p)
            roots.append(_grow(np.arange(n), grad, hess, code, edges, monotone, depth, least, l2, rate, nodes, z, -np.inf, np.inf))
    if not nodes:
        nodes.append([0, np.inf, 0, 0, 0.0])
        roots.append(0)
    a = np.array(nodes)
    return FlatTrees(base, np.array(roots), a[:, 0].astype(int), a[:, 1], a[:, 2].astype(int), a[:, 3].astype(int), a[:, 4], depth)


def _score(g: np.ndarray, h: np.ndarray, w: np.ndarray, l2: float) -> np.ndarray:
    return -(g * w + 0.5 * (h + l2) * w * w)


def _grow(rows, grad, hess, code, edges, monotone, depth, least, l2, rate, nodes, z, low, high) -> int:
    """Adds the subtree of ``rows`` to ``nodes``, its leaf values to ``z``, and returns its root's number."""
    g, h = grad[rows].sum(), hess[rows].sum()
    here = float(np.clip(-g / (h + l2), low, high))
    best = (1e-6, None)
    if depth:
        for f, cut in enumerate(edges):
            if not len(cut):
                continue
            c = code[f][rows]
            gl = np.cumsum(np.bincount(c, grad[rows], len(cut) + 1))[:-1]
            hl = np.cumsum(np.bincount(c, hess[rows], len(cut) + 1))[:-1]
            gr, hr = g - gl, h - hl
            wl, wr = np.clip(-gl / (hl + l2), low, high), np.clip(-gr / (hr + l2), low, high)
            gain = _score(gl, hl, wl, l2) + _score(gr, hr, wr, l2) - _score(g, h, here, l2)
            gain[(hl < least) | (hr < least) | (monotone[f] * (wr - wl) < 0)] = -np.inf
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (float(gain[k]), (f, k, float(wl[k]), float(wr[k])))
    me = len(nodes)
    nodes.append([0, np.inf, me, me, rate * here])
    if best[1] is None:
        z[rows] += rate * here
        return me
    f, k, wl, wr = best[1]
    middle = (wl + wr) / 2
    on_left = code[f][rows] <= k
    bounds = {1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle)), 0: ((low, high), (low, high))}[monotone[f]]
    args = (grad, hess, code, edges, monotone, depth - 1, least, l2, rate, nodes, z)
    left = _grow(rows[on_left], *args, *bounds[0])
    right = _grow(rows[~on_left], *args, *bounds[1])
    nodes[me] = [f, float(edges[f][k]), left, right, 0.0]
    return me
