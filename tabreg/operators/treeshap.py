"""Exact Shapley values of tree models against a fixed background, from boxes of leaves.

A leaf is a box: an interval per feature on its path. For a row x and a background row z, a leaf's value counts for the
features that only x satisfies (A) and against those that only z does (B), if together they satisfy all: the Shapley
weights are (|A|-1)! |B|! / (|A|+|B|)! and |A|! (|B|-1)! / (|A|+|B|)!. What a row needs from a leaf is thus which
of the path's features it satisfies, a bit mask; background rows are reduced to counts per mask once, and the rows of an Arrow
batch share the few masks that occur. Rows are not multiplied by background rows or orders. The values of a
row sum to f(x) minus the mean of f over the background.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

from tabreg.operators import treegrow as G


@dataclass
class Leaf:
    features: np.ndarray  # on the path, each once
    low: np.ndarray       # satisfied if low < x <= high
    high: np.ndarray
    value: float

    def masks(self, x: np.ndarray) -> np.ndarray:
        """Per column of ``x`` (features x rows) the bits of the satisfied features."""
        out = np.zeros(x.shape[1], np.int64)
        for i, f in enumerate(self.features):
            out |= ((x[f] > self.low[i]) & (x[f] <= self.high[i])).astype(np.int64) << i
        return out


def leaves(t: G.Tree, weight: float = 1.0) -> list[Leaf]:
    out, todo = [], [(0, {})]
    while todo:
        node, box = todo.pop()
        f = int(t.feature[node])
        if f < 0:
            names = sorted(box)
            out.append(Leaf(np.array(names, int), np.array([box[k][0] for k in names]), np.array([box[k][1] for k in names]),
                            weight * float(t.value[node])))
            continue
        low, high = box.get(f, (-np.inf, np.inf))
        cut = float(t.threshold[node])
        todo.append((int(t.left[node]), box | {f: (low, min(high, cut))}))
        todo.append((int(t.left[node]) + 1, box | {f: (max(low, cut), high)}))
    return out


class Explainer:
    """Shapley values of the sum of some trees (and a constant) for rows given as features x rows."""

    def __init__(self, trees: list[tuple[float, G.Tree]], background: np.ndarray):
        self.leaves = [x for w, t in trees for x in leaves(t, w) if len(x.features)]
        self.width = len(background)
        self.seen = []  # per leaf: background masks and their shares
        for x in self.leaves:
            masks, n = np.unique(x.masks(background), return_counts=True)
            self.seen.append((masks, n / background.shape[1]))
        most = max([len(x.features) for x in self.leaves], default=0)
        fact = [float(math.factorial(i)) for i in range(most + 2)]
        # weight of a feature in A (row a, column b): (a-1)! b! / (a+b)!; in B by the transpose
        self.in_a = np.array([[fact[a - 1] * fact[b] / fact[a + b] if 0 < a and a + b <= most else 0.0 for b in range(most + 1)]
                              for a in range(most + 1)])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((self.width, x.shape[1]))
        for leaf, (zs, share) in zip(self.leaves, self.seen):
            k = len(leaf.features)
            full = (1 << k) - 1
            xs, row = np.unique(leaf.masks(x), return_inverse=True)
            a, b = xs[:, None] & ~zs[None, :], zs[None, :] & ~xs[:, None]
            alive = (xs[:, None] | zs[None, :]) == full
            na, nb = np.bitwise_count(a), np.bitwise_count(b)
            plus = np.where(alive, self.in_a[na, nb], 0.0) * share * leaf.value
            minus = np.where(alive, self.in_a[nb, na], 0.0) * share * leaf.value
            for i, f in enumerate(leaf.features):
                part = ((a >> i & 1) * plus - (b >> i & 1) * minus).sum(1)
                if part.any():
                    out[f] += part[row]
        return out


def model_trees(model) -> list[tuple[float, G.Tree]]:
    """(weight, tree) of a fitted tree model: this library's boosted trees and small forests, or Spark's own."""
    if hasattr(model, "trees") and callable(model.trees):  # boosted trees kept as arrays
        return [(1.0, t) for t in model.trees()]
    if hasattr(model, "treeWeights"):
        total = 1.0 if "GBT" in type(model).__name__ else float(len(model.trees))
        return [(w / total, _spark_tree(t)) for w, t in zip(model.treeWeights, model.trees)]
    if hasattr(model, "toDebugString"):
        return [(1.0, _spark_tree(model))]
    raise ValueError("no trees to explain in " + type(model).__name__)


def _spark_tree(model) -> G.Tree:
    """Spark's node objects as arrays; thresholds of the form ``feature <= threshold`` only."""
    out = G.Builder(model.numFeatures)
    todo = [(0, model._call_java("rootNode"))]
    while todo:
        at, node = todo.pop()
        out.set_value(np.array([at]), np.array([node.prediction()]))
        if node.subtreeDepth() > 0:
            split = node.split()
            if "Continuous" not in split.getClass().getSimpleName():
                raise ValueError("categorical splits are not known here")
            first = int(out.split(np.array([at]), np.array([split.featureIndex()]), np.array([split.threshold()]), np.array([0.0]))[0])
            todo += [(first, node.leftChild()), (first + 1, node.rightChild())]
    return out.tree()
