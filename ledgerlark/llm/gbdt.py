"""Gradient-boosted trees for small feature tables: fitted on the driver, scored by NumPy or SQL."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

#: (feature, threshold, tree if value <= threshold, tree if not), or the value of a leaf.
Tree = float | tuple[int, float, "Tree", "Tree"]


@dataclass(frozen=True)
class Boosted:
    """Sum of trees plus ``bias``, as log-odds."""

    bias: float
    trees: tuple[Tree, ...]

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        for tree in self.trees:
            out += _apply(tree, x)
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -40, 40)))

    def raw_one(self, row: list[float]) -> float:
        out = self.bias
        for tree in self.trees:
            while isinstance(tree, tuple):
                tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
            out += tree
        return out

    def sql(self, features: list[str]) -> str:
        """The log-odds as SQL over columns named ``features``; terms stand in the order of the trees."""
        return " + ".join([_literal(self.bias), *(_tree_sql(t, features) for t in self.trees)])


def _literal(x: float) -> str:
    return f"CAST({float(x):.9e} AS DOUBLE)"


def _tree_sql(tree: Tree, features: list[str]) -> str:
    if not isinstance(tree, tuple):
        return _literal(tree)
    at, threshold, low, high = tree
    return f"(CASE WHEN {features[at]} <= {_literal(threshold)} THEN {_tree_sql(low, features)} ELSE {_tree_sql(high, features)} END)"


def _apply(tree: Tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    at, threshold, low, high = tree
    return np.where(x[:, at] <= threshold, _apply(low, x), _apply(high, x))


def _cuts(column: np.ndarray, most: int) -> np.ndarray:
    """Thresholds halfway between neighbouring values, at most ``most``, evenly over the rows."""
    values = np.unique(column)
    if len(values) > most:
        values = np.unique(np.quantile(column, np.linspace(0, 1, most), method="nearest"))
    return (values[1:] + values[:-1]) / 2


def _grow(bins: np.ndarray, cuts: list[np.ndarray], g: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int, l2: float, least: float) -> Tree:
    total_g, total_h = g[rows].sum(), h[rows].sum()
    leaf = float(-total_g / (total_h + l2))
    if depth == 0 or total_h < 2 * least:
        return leaf
    best, pick = 1e-6, None
    for at, cut in enumerate(cuts):
        if not len(cut):
            continue
        b = bins[rows, at]
        left_g = np.cumsum(np.bincount(b, g[rows], len(cut) + 1))[:-1]
        left_h = np.cumsum(np.bincount(b, h[rows], len(cut) + 1))[:-1]
        right_g, right_h = total_g - left_g, total_h - left_h
        gain = left_g**2 / (left_h + l2) + right_g**2 / (right_h + l2) - total_g**2 / (total_h + l2)
        gain[(left_h < least) | (right_h < least)] = 0
        k = int(gain.argmax())
        if gain[k] > best:
            best, pick = gain[k], (at, k)
    if pick is None:
        return leaf
    at, k = pick
    low = bins[rows, at] <= k
    more = (depth - 1, l2, least)
    return at, float(cuts[at][k]), _grow(bins, cuts, g, h, rows[low], *more), _grow(bins, cuts, g, h, rows[~low], *more)


def _scaled(tree: Tree, by: float) -> Tree:
    return (tree[0], tree[1], _scaled(tree[2], by), _scaled(tree[3], by)) if isinstance(tree, tuple) else float(f"{tree * by:.9e}")


def fit(x: np.ndarray, y: np.ndarray, *, trees: int = 40, depth: int = 3, rate: float = 0.3, l2: float = 1.0, least: float = 2.0, bins: int = 64) -> Boosted:
    """Boosted trees for labels 0 and 1, by second-order gains of the logistic loss over histograms.

    With no rows, or rows of one label only, the model is its smoothed prior."""
    prior = (y.sum() + 1) / (len(y) + 2)
    bias = float(f"{math.log(prior / (1 - prior)):.9e}")
    if not len(y) or y.min() == y.max():
        return Boosted(bias, ())
    cuts = [_cuts(x[:, i], bins) for i in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, i], side="left") for i, c in enumerate(cuts)], axis=1)
    score, rows, grown = np.full(len(y), bias), np.arange(len(y)), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        tree = _scaled(_grow(binned, cuts, p - y, p * (1 - p), rows, depth, l2, least), rate)
        grown.append(tree)
        score += _apply(tree, x)
    return Boosted(bias, tuple(grown))


def threshold_for(scores: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The least threshold over which at least ``precision`` of the rows have label 1, halfway to the
    next lower score (ties stay together); above all scores if there is none."""
    order = np.argsort(-scores, kind="stable")
    s, hits = scores[order], np.cumsum(y[order])
    last = np.r_[s[1:] != s[:-1], True] if len(s) else np.zeros(0, bool)
    # Rows under the last row of label 1 would only add mistakes.
    useful = np.flatnonzero(last & (hits / np.arange(1, len(s) + 1) >= precision))
    if not len(useful):
        return float("inf")
    least = useful[-1]
    least = useful[np.searchsorted(hits[useful], hits[least])]
    return float((s[least] + s[least + 1]) / 2) if least + 1 < len(s) else float(s[least])
