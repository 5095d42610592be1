"""Gradient-boosted trees for two classes: histogram splits, monotonic constraints, flat node arrays.

Trained on the driver from a bounded sample; the fitted model is a handful of numpy arrays, a few
kilobytes, that travel with the scoring function.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """Node i of all trees: rows with x[feature] <= threshold go left, others (and NaN) right; a leaf is its own child."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row, all trees at once."""
        out = np.full(len(x), self.base)
        for a in range(0, len(x), 4096):
            part = x[a : a + 4096]
            node = np.broadcast_to(self.roots, (len(part), len(self.roots)))
            rows = np.arange(len(part))[:, None]
            for _ in range(self.depth):
                node = np.where(part[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            out[a : a + 4096] += self.value[node].sum(1)
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(x)))


def fit(x: np.ndarray, y: np.ndarray, monotone: dict[int, int] | None = None, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, min_leaf: int = 10, l2: float = 1.0) -> Trees:
    """monotone: +1 or -1 for features that the score may only rise or fall with. One class, or no row, gives a constant."""
    n, width = x.shape
    share = (y.sum() + 0.5) / (n + 1)
    base = float(np.log(share / (1 - share)))
    nodes: list[list[float]] = []  # feature, threshold, left, right, value

    def node() -> int:
        i = len(nodes)
        nodes.append([0, np.inf, i, i, 0.0])
        return i

    roots = []
    if n and 0 < y.sum() < n:
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(width)]
        binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1)
        direction = np.array([(monotone or {}).get(j, 0) for j in range(width)])
        score = np.full(n, base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p)
            root = node()
            roots.append(root)
            work = [(root, np.arange(n), 0, -np.inf, np.inf)]
            while work:
                at, rows, level, low, high = work.pop()
                gs, hs = g[rows].sum(), h[rows].sum()
                value = float(np.clip(gs / (hs + l2), low, high))
                nodes[at][4] = rate * value
                best = (1e-6, -1, -1, 0.0, 0.0)
                if level < depth and len(rows) >= 2 * min_leaf:
                    for j in range(width):
                        size = len(cuts[j]) + 1
                        if size < 2:
                            continue
                        b = binned[rows, j]
                        gl = np.cumsum(np.bincount(b, g[rows], size))[:-1]
                        hl = np.cumsum(np.bincount(b, h[rows], size))[:-1]
                        nl = np.cumsum(np.bincount(b, minlength=size))[:-1]
                        wl, wr = np.clip(gl / (hl + l2), low, high), np.clip((gs - gl) / (hs - hl + l2), low, high)
                        gain = (gl * wl - 0.5 * (hl + l2) * wl**2) + ((gs - gl) * wr - 0.5 * (hs - hl + l2) * wr**2) - (gs * value - 0.5 * (hs + l2) * value**2)
                        gain[(nl < min_leaf) | (len(rows) - nl < min_leaf) | (direction[j] * (wr - wl) < 0)] = -1
                        k = int(np.argmax(gain))
                        if gain[k] > best[0]:
                            best = (gain[k], j, k, wl[k], wr[k])
                if best[1] < 0:
                    score[rows] += rate * value
                    continue
                _, j, k, wl, wr = best
                goes = binned[rows, j] <= k
                left, right = node(), node()
                nodes[at][:4] = [j, cuts[j][k], left, right]
                nodes[at][4] = 0.0
                middle = (wl + wr) / 2
                bounds = {0: ((low, high), (low, high)), 1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}[int(direction[j])]
                work += [(left, rows[goes], level + 1, *bounds[0]), (right, rows[~goes], level + 1, *bounds[1])]
    f = np.array(nodes, float).reshape(-1, 5)
    return Trees(f[:, 0].astype(np.int32), f[:, 1], f[:, 2].astype(np.int32), f[:, 3].astype(np.int32), f[:, 4], np.array(roots, np.int32), depth, base)
