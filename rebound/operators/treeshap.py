"""Path-dependent Shapley values of boosted trees (X1 for trees).

A tree answers a question about a subset of known features by its leaves: a
leaf counts with the product, over the features on its path, of 1 or 0 for a
known feature (the row takes the path there or not) and of the share of
training rows that take the path for an unknown one.  The Shapley value of a
feature averages over all orders in which features become known; for one leaf
with features 1..D, shares z and marks o it is

    value * (o_i - z_i) * sum_k c_k k! (D - 1 - k)! / D!,

where c_k are the coefficients of the product over j != i of (z_j + o_j y).
Features off the path add nothing, so D is at most the depth of the tree and no
subset is ever listed.

A row enters a leaf's formula through its D marks alone.  A task therefore
walks a batch one condition at a time, turns the marks into a number, and
solves the formula once for each number that occurs.
"""

from __future__ import annotations

import math

import numpy as np


def leaves(nodes: list[dict]) -> list[tuple[float, dict[int, float], dict[int, list[tuple[int, bool]]]]]:
    """(value, share by feature, conditions by feature as (node, goes left)) of every leaf with a path."""
    out, work = [], [(0, {}, {})]
    while work:
        i, share, conditions = work.pop()
        n = nodes[i]
        if n["leaf"]:
            out.append((n["pred"], share, conditions))
            continue
        f = n["feat"]
        for child, left in ((n["l"], True), (n["r"], False)):
            part = nodes[child]["cover"] / n["cover"] if n["cover"] else 0.0
            work.append((child, {**share, f: share.get(f, 1.0) * part}, {**conditions, f: [*conditions.get(f, []), (i, left)]}))
    return out


def expected_value(nodes: list[dict]) -> float:
    """What the tree answers with no feature known."""
    return sum(value * math.prod(share.values()) for value, share, _ in leaves(nodes))


def _products(o: np.ndarray, z: np.ndarray, skip: int) -> np.ndarray:
    """Coefficients of the product over j != skip of (z_j + o_j y), by row of ``o``."""
    c = np.zeros((len(o), o.shape[1]))
    c[:, 0] = 1.0
    for j in range(o.shape[1]):
        if j != skip:
            c[:, 1:] = c[:, 1:] * z[j] + c[:, :-1] * o[:, j:j + 1]
            c[:, 0] *= z[j]
    return c


def leaf_values(value: float, z: np.ndarray, o: np.ndarray) -> np.ndarray:
    """Shapley values of a leaf's features (columns) for rows of marks ``o``."""
    d = len(z)
    weight = np.array([math.factorial(k) * math.factorial(d - 1 - k) / math.factorial(d) for k in range(d)])
    return np.stack([value * (o[:, i] - z[i]) * (_products(o, z, i) @ weight) for i in range(d)], axis=1)


class TreeShap:
    """Values of a weighted sum of trees for matrices of feature rows; shipped with tasks."""

    def __init__(self, trees: list[list[dict]], weights: list[float]):
        self.trees, self.weights = trees, weights
        self.bias = sum(expected_value(t) * w for t, w in zip(trees, weights))

    def _left(self, node: dict, x: np.ndarray) -> np.ndarray:
        kind, arg = node["rule"]
        v = x[:, node["feat"]]
        return v <= arg if kind == "le" else np.isin(v, arg)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(x.shape)
        for nodes, w in zip(self.trees, self.weights):
            left = {i: self._left(n, x) for i, n in enumerate(nodes) if not n["leaf"]}
            for value, share, conditions in leaves(nodes):
                features = list(share)
                if not features:
                    continue
                code = np.zeros(len(x), np.int64)
                for bit, f in enumerate(features):
                    there = np.ones(len(x), bool)
                    for i, goes_left in conditions[f]:
                        there &= left[i] == goes_left
                    code |= there.astype(np.int64) << bit
                seen, row = np.unique(code, return_inverse=True)
                marks = (seen[:, None] >> np.arange(len(features)) & 1).astype(float)
                out[:, features] += w * leaf_values(value, np.array([share[f] for f in features]), marks)[row]
        return out
