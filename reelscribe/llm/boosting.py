"""Histogram gradient-boosted trees in numpy: fit on a bounded sample, flatten to arrays, score whole batches at once."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """Complete binary trees of one depth as arrays (tree, node): children of node i are 2 i + 1 and 2 i + 2."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    base: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Sum of leaves for every row: all trees go down one level at a time."""
        trees = np.arange(len(self.feature))[None, :]
        depth = int(np.log2(self.leaf.shape[1]))
        out = np.full(len(x), self.base)
        for at in range(0, len(x), 4096):
            part = x[at : at + 4096]
            node = np.zeros((len(part), len(self.feature)), np.int64)
            for _ in range(depth):
                value = np.take_along_axis(part, self.feature[trees, node], axis=1)
                node = 2 * node + 1 + (value > self.threshold[trees, node])
            out[at : at + 4096] += self.leaf[trees, node - (self.leaf.shape[1] - 1)].sum(1)
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def fit_trees(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, ridge: float = 1.0, least: float = 2.0) -> Trees:
    """Logistic loss, second order. Features are cut at quantiles into at most ``bins`` bins; a level is split from histograms."""
    n, m = x.shape
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.zeros(0) for f in range(m)]
    # A feature that is zero nearly everywhere has no inner quantile: cut its other values by themselves.
    for f in range(m):
        rare = x[:, f] > (cuts[f].max() if len(cuts[f]) else -np.inf)
        if n and len(cuts[f]) < bins // 2 and rare.any():
            cuts[f] = np.unique(np.append(cuts[f], np.quantile(x[rare, f], np.linspace(0, 0.9, bins // 4))))
    code = np.stack([np.searchsorted(cuts[f], x[:, f], "left") for f in range(m)], axis=1) if n else np.zeros((0, m), np.int64)
    width = max([len(c) for c in cuts], default=0) + 1
    share = min(max(float(y.mean()) if n else 0.5, 1e-3), 1 - 1e-3)
    score = np.full(n, np.log(share / (1 - share)))
    base, inner = float(np.log(share / (1 - share))), (1 << depth) - 1
    trees = Trees(np.zeros((rounds, inner), np.int64), np.full((rounds, inner), np.inf), np.zeros((rounds, 1 << depth)), base)
    flat = code + np.arange(m)[None, :] * width
    for t in range(rounds if n else 0):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, count = (1 << level) - 1, 1 << level
            size = count * m * width
            at = (flat + ((node - first) * (m * width))[:, None]).ravel()
            hist_g = np.bincount(at, np.repeat(g, m), size).reshape(count, m, width).cumsum(2)
            hist_h = np.bincount(at, np.repeat(h, m), size).reshape(count, m, width).cumsum(2)
            all_g, all_h = hist_g[:, :, -1:], hist_h[:, :, -1:]
            gain = hist_g**2 / (hist_h + ridge) + (all_g - hist_g) ** 2 / (all_h - hist_h + ridge) - all_g**2 / (all_h + ridge)
            gain[(hist_h < least) | (all_h - hist_h < least)] = 0
            best = gain.reshape(count, -1).argmax(1)
            for i in range(count):
                f, b = divmod(int(best[i]), width)
                if gain[i, f, b] > 1e-9 and b < len(cuts[f]):
                    trees.feature[t, first + i], trees.threshold[t, first + i] = f, cuts[f][b]
            node = 2 * node + 1 + (x[np.arange(n), trees.feature[t, node]] > trees.threshold[t, node])
        leaf = node - inner
        sum_g, sum_h = np.bincount(leaf, g, 1 << depth), np.bincount(leaf, h, 1 << depth)
        trees.leaf[t] = -rate * sum_g / (sum_h + ridge)
        score += trees.leaf[t][leaf]
    return trees


@dataclass
class Steps:
    """A non-decreasing step function."""

    at: np.ndarray
    value: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.interp(x, self.at, self.value)


def fit_isotonic(x: np.ndarray, y: np.ndarray) -> Steps:
    """Isotonic calibration by pooling neighbours that go down; between the pools' centres it is linear."""
    if not len(x):
        return Steps(np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    values, back = np.unique(x, return_inverse=True)
    pools: list[list[float]] = []  # mean, weight, first, last
    for v, s, w in zip(values, np.bincount(back, y), np.bincount(back)):
        pools.append([s / w, float(w), v, v])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            mean, weight, _, last = pools.pop()
            one = pools[-1]
            one[0] = (one[0] * one[1] + mean * weight) / (one[1] + weight)
            one[1] += weight
            one[3] = last
    at = np.array([e for p in pools for e in (p[2], p[3])])
    value = np.array([p[0] for p in pools for _ in range(2)])
    keep = np.append(True, np.diff(at) > 0)
    return Steps(at[keep], value[keep])
