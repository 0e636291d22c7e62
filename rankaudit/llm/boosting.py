"""Gradient boosted trees for two classes: perfect trees of a fixed depth on binned features."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Log-odds as a sum of trees.  ``fit`` takes features (rows x columns), labels 0/1 and
    weights; the same input always gives the same trees."""

    def __init__(self, trees: int = 120, depth: int = 5, rate: float = 0.2, bins: int = 32, l2: float = 4.0, share: float = 0.5):
        self.trees, self.depth, self.rate, self.bins, self.l2, self.share = trees, depth, rate, bins, l2, share
        self.start, self.fitted = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Boosted:
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1], method="lower")) for c in x.T]
        binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T)], axis=1)  # bin b: value <= cuts[b]
        rate = min(max(float((weight * y).sum() / weight.sum()), 1e-6), 1 - 1e-6)
        self.start = np.log(rate / (1 - rate))
        odds = np.full(len(y), self.start)
        rnd = np.random.default_rng(0)
        for _ in range(self.trees):
            some = np.nonzero(rnd.random(len(y)) < self.share)[0]  # each tree sees a share of the rows
            p = 1 / (1 + np.exp(-odds[some]))
            self.fitted.append(self._tree(binned[some], cuts, weight[some] * (p - y[some]), weight[some] * p * (1 - p)))
            odds += self._value(self.fitted[-1], x)
        return self

    def _tree(self, binned, cuts, g, h):
        n, columns = binned.shape
        inner = 2**self.depth - 1
        feature, cut = np.zeros(inner, int), np.full(inner, np.inf)
        node = np.zeros(n, int)
        for level in range(self.depth):
            first, nodes = 2**level - 1, 2**level
            best = np.zeros(nodes)
            for c in range(columns):
                if not len(cuts[c]):
                    continue
                size = len(cuts[c]) + 1
                key = (node - first) * size + binned[:, c]
                gs = np.bincount(key, g, nodes * size).reshape(nodes, size).cumsum(1)
                hs = np.bincount(key, h, nodes * size).reshape(nodes, size).cumsum(1)
                gl, hl, gt, ht = gs[:, :-1], hs[:, :-1], gs[:, -1:], hs[:, -1:]
                gain = gl**2 / (hl + self.l2) + (gt - gl) ** 2 / (ht - hl + self.l2) - gt**2 / (ht + self.l2)
                at = gain.argmax(1)
                top = gain[np.arange(nodes), at]
                better = top > best + 1e-9
                best[better] = top[better]
                feature[first : first + nodes][better] = c
                cut[first : first + nodes][better] = cuts[c][at[better]]
            bound = np.array([np.searchsorted(cuts[f], v, side="left") if np.isfinite(v) else self.bins + 1 for f, v in zip(feature, cut)])
            node = 2 * node + 1 + (binned[np.arange(n), feature[node]] > bound[node])
        leaf = node - inner
        gs, hs = np.bincount(leaf, g, inner + 1), np.bincount(leaf, h, inner + 1)
        return feature, cut, -self.rate * gs / (hs + self.l2)

    def _value(self, tree, x: np.ndarray) -> np.ndarray:
        feature, cut, value = tree
        node, rows = np.zeros(len(x), int), np.arange(len(x))
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
        return value[node - len(feature)]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 for each row."""
        odds = np.full(len(x), self.start)
        for tree in self.fitted:
            odds += self._value(tree, x)
        return 1 / (1 + np.exp(-odds))


def threshold_for(scores: np.ndarray, labels: np.ndarray, precision: float, none: float = 0.99) -> float:
    """The lowest score from which on, counted down from the top, at least ``precision`` of
    the rows are of class 1; ``none`` where there is no such score."""
    order = np.argsort(-scores, kind="stable")
    hits = np.cumsum(labels[order]) / np.arange(1, len(order) + 1)
    last = np.append(np.diff(scores[order]) != 0, True)  # ties stand together
    good = np.nonzero((hits >= precision) & last)[0]
    return float(scores[order][good[-1]]) if len(good) else none
