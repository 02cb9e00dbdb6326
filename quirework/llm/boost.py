"""Gradient-boosted trees on dense features, with isotonic calibration; fitted on bounded samples."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

BINS = 32
RATE = 0.15
LEAST_HESSIAN = 2.0
RIDGE = 1.0


@dataclass
class Tree:
    """Nodes in arrays; feature -1 marks a leaf."""

    feature: list[int] = field(default_factory=list)
    cut: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)

    def add(self) -> int:
        for column, start in ((self.feature, -1), (self.cut, 0.0), (self.left, -1), (self.right, -1), (self.value, 0.0)):
            column.append(start)
        return len(self.feature) - 1

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        stack = [(0, np.arange(len(x)))]
        while stack:
            node, rows = stack.pop()
            if self.feature[node] < 0:
                out[rows] = self.value[node]
            elif len(rows):
                low = x[rows, self.feature[node]] <= self.cut[node]
                stack += [(self.left[node], rows[low]), (self.right[node], rows[~low])]
        return out


@dataclass
class Model:
    """base: log odds of the sample. steps: where the calibrated probability changes, between them it is linear."""

    base: float
    trees: list[Tree]
    steps: tuple[np.ndarray, np.ndarray] | None = None

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.base + RATE * sum((t.predict(x) for t in self.trees), np.zeros(len(x)))

    def probability(self, x: np.ndarray) -> np.ndarray:
        m = self.margin(x)
        return np.interp(m, *self.steps) if self.steps else 1 / (1 + np.exp(-m))


def _grow(x: np.ndarray, codes: np.ndarray, cuts: list[np.ndarray], gradient: np.ndarray, hessian: np.ndarray, depth: int) -> Tree:
    tree = Tree()
    stack = [(tree.add(), np.arange(len(x)), 0)]
    while stack:
        node, rows, level = stack.pop()
        g, h = gradient[rows], hessian[rows]
        total_g, total_h = g.sum(), h.sum()
        tree.value[node] = -total_g / (total_h + RIDGE)
        if level == depth or total_h < 2 * LEAST_HESSIAN:
            continue
        best, least = None, total_g**2 / (total_h + RIDGE) + 1e-3
        for f, edges in enumerate(cuts):
            if not len(edges):
                continue
            sums_g = np.bincount(codes[rows, f], g, len(edges) + 1).cumsum()[:-1]
            sums_h = np.bincount(codes[rows, f], h, len(edges) + 1).cumsum()[:-1]
            gain = sums_g**2 / (sums_h + RIDGE) + (total_g - sums_g) ** 2 / (total_h - sums_h + RIDGE)
            gain[(sums_h < LEAST_HESSIAN) | (total_h - sums_h < LEAST_HESSIAN)] = -1
            if gain[k := int(gain.argmax())] > least:
                best, least = (f, k), gain[k]
        if best is None:
            continue
        f, k = best
        tree.feature[node], tree.cut[node] = f, float(cuts[f][k])
        low = codes[rows, f] <= k
        tree.left[node], tree.right[node] = tree.add(), tree.add()
        stack += [(tree.left[node], rows[low], level + 1), (tree.right[node], rows[~low], level + 1)]
    return tree


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean margin and rate of each block of the pool-adjacent-violators fit; each block gets half a row of either class."""
    order = np.argsort(margin, kind="stable")
    blocks: list[list[float]] = []  # rows, sum of y, sum of margins
    for m, t in zip(margin[order].tolist(), y[order].tolist(), strict=True):
        blocks.append([1.0, t, m])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    # Half rows weigh more in small blocks, so the rates are made to rise once more.
    return np.array([b[2] / b[0] for b in blocks]), np.maximum.accumulate([(b[1] + 0.5) / (b[0] + 1) for b in blocks])


def fit(x: np.ndarray, y: np.ndarray, calibrate: np.ndarray, trees: int = 60, depth: int = 3) -> Model:
    """A model of P(y = 1). calibrate marks rows that only the calibration uses."""
    fx, fy = x[~calibrate], y[~calibrate].astype(float)
    rate = (fy.sum() + 0.5) / (len(fy) + 1)
    model = Model(float(np.log(rate / (1 - rate))), [])
    if len(fy) == 0 or fy.min() == fy.max():
        return model
    cuts = []
    for f in range(x.shape[1]):
        values = np.unique(fx[:, f])
        middle = (values[1:] + values[:-1]) / 2
        cuts.append(middle if len(middle) < BINS else np.unique(np.quantile(middle, np.linspace(0, 1, BINS))))
    codes = np.stack([np.searchsorted(c, fx[:, f], "left") for f, c in enumerate(cuts)], axis=1)
    margin = np.full(len(fy), model.base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        tree = _grow(fx, codes, cuts, p - fy, np.maximum(p * (1 - p), 1e-6), depth)
        model.trees.append(tree)
        margin += RATE * tree.predict(fx)
    cy = y[calibrate]
    if len(cy) and cy.min() != cy.max():
        at, p = isotonic(model.margin(x[calibrate]), cy.astype(float))
        if len(at) > 1:
            model.steps = (at, p)
    return model
