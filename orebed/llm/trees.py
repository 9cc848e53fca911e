"""Small decision trees on bounded samples, and their form as Spark columns."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: (feature, above, threshold): feature > threshold if above, else feature <= threshold.
Condition = tuple[int, bool, float]


@dataclass
class Node:
    value: float
    feature: int = -1
    threshold: float = 0.0
    low: "Node | None" = None
    high: "Node | None" = None


def cuts(x: np.ndarray, most: int = 32) -> np.ndarray:
    """Thresholds between a feature's values: midpoints, or of quantiles if there are many."""
    v = np.unique(x)
    if len(v) > most:
        v = np.unique(np.quantile(x, np.linspace(0, 1, most + 1), method="nearest"))
    return (v[1:] + v[:-1]) / 2


class Grower:
    """Regression trees by weighted squared error on features cut into bins once."""

    def __init__(self, x: np.ndarray, most_cuts: int = 32):
        self.x, self.cuts = x, [cuts(x[:, j], most_cuts) for j in range(x.shape[1])]
        self.bins = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(self.cuts)], axis=1) if x.size else np.zeros(x.shape, int)

    def grow(self, y: np.ndarray, w: np.ndarray, depth: int, least: float, features: int | None = None, rng: np.random.Generator | None = None) -> Node:
        """features: how many, drawn anew at each split, may split; None: all."""

        def at(rows: np.ndarray, level: int) -> Node:
            wr, yr = w[rows], y[rows]
            total, s = wr.sum(), (wr * yr).sum()
            node = Node(float(s / total) if total else 0.0)
            if level == 0 or total < 2 * least or np.ptp(yr) == 0:
                return node
            best, base = 1e-9, s * s / total
            some = range(self.x.shape[1]) if features is None else rng.choice(self.x.shape[1], min(features, self.x.shape[1]), replace=False)
            for j in some:
                k = len(self.cuts[j])
                if not k:
                    continue
                b = self.bins[rows, j]
                wl = np.cumsum(np.bincount(b, wr, k + 1))[:-1]
                sl = np.cumsum(np.bincount(b, wr * yr, k + 1))[:-1]
                wh, sh = total - wl, s - sl
                ok = (wl >= least) & (wh >= least)
                if not ok.any():
                    continue
                gain = np.where(ok, sl * sl / np.maximum(wl, 1e-12) + sh * sh / np.maximum(wh, 1e-12) - base, -1)
                i = int(gain.argmax())
                if gain[i] > best:
                    best, node.feature, node.threshold = float(gain[i]), int(j), float(self.cuts[j][i])
            if node.feature >= 0:
                high = self.x[rows, node.feature] > node.threshold
                node.low, node.high = at(rows[~high], level - 1), at(rows[high], level - 1)
            return node

        return at(np.flatnonzero(w > 0), depth)


def predict(node: Node, x: np.ndarray) -> np.ndarray:
    if node.feature < 0:
        return np.full(len(x), node.value)
    return np.where(x[:, node.feature] > node.threshold, predict(node.high, x), predict(node.low, x))


def rules(node: Node, path: tuple[Condition, ...] = ()) -> list[tuple[Condition, ...]]:
    """The path to each node but the root, as a conjunction with one condition for each feature and side."""
    out = []
    for child, above in ((node.low, False), (node.high, True)):
        if child is None:
            continue
        own = (node.feature, above, node.threshold)
        kept = {(f, a): t for f, a, t in path}
        old = kept.get((node.feature, above), node.threshold)
        kept[node.feature, above] = max(old, own[2]) if above else min(old, own[2])
        conj = tuple(sorted((f, a, t) for (f, a), t in kept.items()))
        out += [conj, *rules(child, conj)]
    return out


def holds(rule: tuple[Condition, ...], x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, above, t in rule:
        out &= (x[:, f] > t) if above else (x[:, f] <= t)
    return out


def rule_column(rule: tuple[Condition, ...], features: list[Column]) -> Column:
    out = None
    for f, above, t in rule:
        one = features[f] > t if above else features[f] <= t
        out = one if out is None else out & one
    return out


def tree_sql(node: Node, features: str) -> str:
    """The tree as SQL over an array of numbers by that name: one text to parse, however many nodes."""
    if node.feature < 0:
        return f"{float(node.value)!r}D"
    return f"CASE WHEN {features}[{node.feature}] > {float(node.threshold)!r}D THEN {tree_sql(node.high, features)} ELSE {tree_sql(node.low, features)} END"


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def lasso_logistic(x: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400) -> tuple[float, np.ndarray]:
    """Intercept and weights of logistic regression with an L1 penalty, by accelerated proximal steps."""
    n, k = x.shape
    mean = np.clip(y.mean(), 1e-4, 1 - 1e-4)
    b, w = float(np.log(mean / (1 - mean))), np.zeros(k)
    zb, zw, t = b, w.copy(), 1.0
    step = 4 / (np.linalg.norm(np.hstack([x, np.ones((n, 1))]), 2) ** 2 / n + 1e-9)
    for _ in range(rounds):
        r = sigmoid(x @ zw + zb) - y
        nw = zw - step * (x.T @ r) / n
        nw = np.sign(nw) * np.maximum(np.abs(nw) - step * penalty, 0)
        nb = zb - step * r.mean()
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        zw, zb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return b, w
