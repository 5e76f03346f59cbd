"""Gradient-boosted trees in numpy: logistic loss, histogram splits, monotonic constraints; the fitted
forest is flattened into node arrays that score a whole matrix at once."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """Node arrays over all trees. A leaf points at itself, so every tree can be walked `depth` steps."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log odds of every row of x (rows, features)."""
        out = np.full(len(x), self.base)
        at = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                low = x[at, self.feature[node]] <= self.threshold[node]
                node = np.where(low, self.left[node], self.right[node])
            out += self.value[node]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, monotone: list[int], trees: int = 60, depth: int = 3, rate: float = 0.2,
        bins: int = 32, reg: float = 1.0, least: float = 3.0) -> Forest:
    """monotone: for each feature +1 (the margin never falls as it rises), -1 or 0.

    A split on a constrained feature is allowed only if its two values are in order; the middle of the two
    then bounds everything below either side, so the order holds for the whole tree, and a sum of such trees
    keeps it.
    """
    n, m = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(m)]
    code = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], 1)
    rate_of = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(rate_of / (1 - rate_of)))
    nodes: list[list[float]] = []
    roots: list[int] = []
    margin = np.full(n, base)

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, low: float, high: float) -> int:
        me = len(nodes)
        sg, sh = g[rows].sum(), h[rows].sum()
        value = float(np.clip(-sg / (sh + reg), low, high))
        nodes.append([0, np.inf, me, me, value * rate])
        if level == depth or len(rows) < 2 * least:
            margin[rows] += value * rate
            return me
        best = (1e-6, -1, -1, 0.0, 0.0)
        for j in range(m):
            k = len(cuts[j])
            if not k:
                continue
            c = code[rows, j]
            hg = np.bincount(c, g[rows], k + 1).cumsum()[:-1]
            hh = np.bincount(c, h[rows], k + 1).cumsum()[:-1]
            num = np.bincount(c, minlength=k + 1).cumsum()[:-1]
            a, b = np.clip(-hg / (hh + reg), low, high), np.clip(-(sg - hg) / (sh - hh + reg), low, high)
            score = lambda w, gg, hh: -(gg * w + 0.5 * (hh + reg) * w * w)
            gain = score(a, hg, hh) + score(b, sg - hg, sh - hh) - score(value, sg, sh)
            ok = (num >= least) & (len(rows) - num >= least) & (monotone[j] * (b - a) >= 0)
            gain = np.where(ok, gain, -1)
            i = int(gain.argmax())
            if gain[i] > best[0]:
                best = (float(gain[i]), j, i, float(a[i]), float(b[i]))
        _, j, i, a, b = best
        if j < 0:
            margin[rows] += value * rate
            return me
        mid = (a + b) / 2
        bounds = {1: ((low, mid), (mid, high)), -1: ((mid, high), (low, mid)), 0: ((low, high), (low, high))}[monotone[j]]
        under = code[rows, j] <= i
        left = grow(rows[under], g, h, level + 1, *bounds[0])
        right = grow(rows[~under], g, h, level + 1, *bounds[1])
        nodes[me] = [j, float(cuts[j][i]), left, right, 0.0]
        return me

    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        roots.append(grow(np.arange(n), p - y, np.maximum(p * (1 - p), 1e-6), 0, -np.inf, np.inf))
    a = np.array(nodes)
    return Forest(a[:, 0].astype(int), a[:, 1], a[:, 2].astype(int), a[:, 3].astype(int), a[:, 4], np.array(roots), depth, base)
