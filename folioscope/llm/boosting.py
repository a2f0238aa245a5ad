"""Gradient-boosted trees in numpy: histogram splits, monotonic constraints, flattened node arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """Complete binary trees of one depth as arrays [tree, node]; leaves follow the inner nodes.

    A row goes right where its feature is greater than the node's threshold.  Unused inner nodes have
    the threshold +inf, so rows go left.  ``score`` is vectorised over rows and walks one level at a time.
    """

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    bias: float
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        inner = (1 << self.depth) - 1
        for f, t, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            out += leaf[node - inner]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.margin(x), -40, 40)))


def constant(p: float) -> Forest:
    p = min(max(p, 1e-3), 1 - 1e-3)
    return Forest(np.zeros((0, 1), int), np.zeros((0, 1)), np.zeros((0, 2)), float(np.log(p / (1 - p))), 1)


def fit(x: np.ndarray, y: np.ndarray, *, monotone=None, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 32, l2: float = 1.0, least: float = 2.0) -> Forest:
    """Logistic loss.  monotone[f]: 1, -1 or 0.  A single class or no rows give a constant model."""
    y = np.asarray(y, dtype=float)
    if len(y) == 0 or y.min() == y.max():
        return constant(float(y.mean()) if len(y) else 0.5)
    n, m = x.shape
    monotone = np.zeros(m, int) if monotone is None else np.asarray(monotone)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(m)]
    coded = np.stack([np.searchsorted(cuts[f], x[:, f], side="left") for f in range(m)], axis=1)
    width = bins
    inner = (1 << depth) - 1
    bias = float(np.log(y.mean() / (1 - y.mean())))
    margin = np.full(n, bias)
    features, thresholds, leaves = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        feature, threshold = np.zeros(inner, int), np.full(inner, np.inf)
        low, high = np.full(2 * inner + 1, -np.inf), np.full(2 * inner + 1, np.inf)
        node = np.zeros(n, dtype=np.int64)
        for level in range(depth):
            start, count = (1 << level) - 1, 1 << level
            local = node - start
            gain = np.full((count,), 1e-6)
            pick = np.zeros((count, 2), dtype=int) - 1
            value = np.zeros((count, 2))
            for f in range(m):
                if not len(cuts[f]):
                    continue
                key = local * width + coded[:, f]
                hg = np.bincount(key, g, count * width).reshape(count, width)
                hh = np.bincount(key, h, count * width).reshape(count, width)
                gl, hl = hg.cumsum(1)[:, : len(cuts[f])], hh.cumsum(1)[:, : len(cuts[f])]
                gt, ht = hg.sum(1, keepdims=True), hh.sum(1, keepdims=True)
                gr, hr = gt - gl, ht - hl
                lo, hi = low[start : start + count, None], high[start : start + count, None]
                vl, vr = np.clip(-gl / (hl + l2), lo, hi), np.clip(-gr / (hr + l2), lo, hi)
                own = np.clip(-gt / (ht + l2), lo, hi)
                loss = lambda gg, hh_, v: gg * v + 0.5 * (hh_ + l2) * v * v
                s = loss(gt, ht, own) - loss(gl, hl, vl) - loss(gr, hr, vr)
                s = np.where((hl < least * 0.1) | (hr < least * 0.1), -np.inf, s)
                if monotone[f]:
                    s = np.where(monotone[f] * (vr - vl) < 0, -np.inf, s)
                best = s.argmax(1)
                top = s[np.arange(count), best]
                better = top > gain
                gain[better], pick[better, 0], pick[better, 1] = top[better], f, best[better]
                value[better, 0], value[better, 1] = vl[np.arange(count), best][better], vr[np.arange(count), best][better]
            for i in range(count):
                j = start + i
                left, right = 2 * j + 1, 2 * j + 2
                low[left] = low[right] = low[j]
                high[left] = high[right] = high[j]
                if pick[i, 0] >= 0:
                    feature[j], threshold[j] = pick[i, 0], cuts[pick[i, 0]][pick[i, 1]]
                    if way := monotone[pick[i, 0]]:
                        middle = value[i].mean()
                        if way > 0:
                            high[left], low[right] = middle, middle
                        else:
                            low[left], high[right] = middle, middle
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > threshold[node])
        at = node - inner
        gl, hl = np.bincount(at, g, inner + 1), np.bincount(at, h, inner + 1)
        leaf = rate * np.clip(-gl / (hl + l2), low[inner:], high[inner:])
        margin += leaf[at]
        features.append(feature)
        thresholds.append(threshold)
        leaves.append(leaf)
    return Forest(np.array(features), np.array(thresholds), np.array(leaves), bias, depth)
