"""Growing and walking one regression tree over arrays (the part of forests that runs inside a task).

Trees are kept level by level as flat arrays: split feature (-1: leaf), threshold (left if x <= threshold), left
child (the right one follows it) and value. All nodes of a level are split at once with vectorised sums over
rows sorted by node; rows leave the arrays with the leaf they end in.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Tree:
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    value: np.ndarray
    gain: np.ndarray  # sum of squared-error reductions per feature
    grown_here: bool = False  # node numbers are those that rows were routed to while it grew

    @property
    def size(self) -> int:
        return len(self.feature)


class Builder:
    """Node arrays that grow by pairs of children."""

    def __init__(self, features: int):
        self.size, self.gain = 1, np.zeros(features)
        self.feature, self.threshold, self.left, self.value = (np.full(16, v, t) for v, t in ((-1, np.int16), (0, float), (0, np.int32), (0, float)))

    def split(self, nodes, feature, threshold, gain) -> np.ndarray:
        """Give each node (that splits) two children; returns the left ones."""
        first = self.size + 2 * np.arange(len(nodes))
        self.size += 2 * len(nodes)
        if self.size > len(self.feature):
            for name, blank in (("feature", -1), ("threshold", 0.0), ("left", 0), ("value", 0.0)):
                old = getattr(self, name)
                setattr(self, name, np.concatenate([old, np.full(2 * self.size - len(old), blank, old.dtype)]))
        self.feature[nodes], self.threshold[nodes], self.left[nodes] = feature, threshold, first
        np.add.at(self.gain, feature, gain)
        return first

    def set_value(self, nodes, values) -> None:
        self.value[nodes] = values

    def tree(self, grown_here: bool = False) -> Tree:
        return Tree(*(c[:self.size].copy() for c in (self.feature, self.threshold, self.left, self.value)), self.gain, grown_here)


SMALL = 256  # nodes of a tree whose numbers fit a byte


def walk(t: Tree, x: np.ndarray, start: np.ndarray | None = None) -> np.ndarray:
    """Leaf of each column of ``x`` (features x rows); ``start``: nodes reached before."""
    if start is None and t.size <= SMALL:
        return _walk_small(t, x)
    n = x.shape[1]
    at = np.zeros(n, np.int64) if start is None else start.copy()
    flat, rows, node = x.reshape(-1), np.arange(n), at
    while len(rows):
        f = t.feature.take(node).astype(np.int64)
        inner = f >= 0
        if not inner.all():
            rows, node, f = rows[inner], node[inner], f[inner]
        f *= n
        f += rows
        node = t.left.take(node) + (flat.take(f) > t.threshold.take(node))
        if len(rows) == n:
            at = node.astype(np.int64)
        else:
            at[rows] = node
    return at


def _walk_small(t: Tree, x: np.ndarray) -> np.ndarray:
    """Node by node over whole rows of ``x`` (no look-ups by row): children come after their parents. As long as all nodes
    of a level ask the same, the level is one step."""
    at, first, many = np.zeros(x.shape[1], np.uint8), 0, 1
    while t.feature[first] >= 0:
        level = slice(first, first + many)
        if ((t.feature[level] != t.feature[first]).any() or (t.threshold[level] != t.threshold[first]).any()
                or (t.left[level] != t.left[first] + 2 * np.arange(many)).any()):
            break
        at <<= 1
        at |= x[t.feature[first]] > t.threshold[first]
        first, many = int(t.left[first]), 2 * many
    at += np.uint8(first)
    for node in first + np.flatnonzero(t.feature[first:] >= 0):
        step = (x[t.feature[node]] > t.threshold[node]).view(np.uint8)
        step += np.uint8(t.left[node] - node)
        step *= (at == node).view(np.uint8)
        at += step
    return at


def predict(t: Tree, x: np.ndarray, start: np.ndarray | None = None) -> np.ndarray:
    return t.value.take(walk(t, x, start))


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes) - sizes


def _dealing(lefts: np.ndarray, sizes: np.ndarray):
    """How to put the left rows of each segment before its right ones, both in their order: a function of which rows go left that
    gives each row's new place. What depends on the segments alone is made once."""
    start, before = _starts(sizes), _starts(lefts)  # rows and left rows in earlier segments
    left = np.repeat(start - before - 1, sizes)
    right = np.repeat(lefts + before, sizes) + np.arange(len(left))

    def places(goes: np.ndarray) -> np.ndarray:
        seen = np.cumsum(goes)
        return np.where(goes, left + seen, right - seen)
    return places


def _sums(v: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of whole numbers (last axis) over segments that end before ``ends``."""
    upto = np.cumsum(v, axis=-1, dtype=np.int64).take(ends - 1, axis=-1)
    upto[..., 1:] -= upto[..., :-1].copy()
    return upto


def grow_random(x: np.ndarray, y: np.ndarray, w: np.ndarray, seed, min_leaf: int = 1, max_depth: int | None = None) -> Tree:
    """Extremely randomised tree: per node and feature one uniform threshold in the node's range; the best of
    these by squared error splits the node, until it is pure, constant or too small. ``x``: features x rows."""
    rng = np.random.default_rng(seed)
    out = Builder(len(x))
    keep = w > 0
    x, y, w = x[:, keep], y[keep], w[keep]
    if not len(y):
        return out.tree()
    even = bool((w == 1).all())
    nodes, sizes, depth = np.array([0]), np.array([len(y)]), 0
    while True:
        s, ends, k = _starts(sizes), np.cumsum(sizes), np.arange(len(nodes))
        of = np.repeat(k, sizes)
        wy = y if even else w * y
        n, total = sizes.astype(float) if even else np.add.reduceat(w, s), np.add.reduceat(wy, s)
        out.set_value(nodes, total / n)
        low, high = np.minimum.reduceat(x, s, axis=1), np.maximum.reduceat(x, s, axis=1)
        cut = low + rng.random(low.shape) * (high - low)
        cut = np.where(cut >= high, low, cut)
        go = x <= cut.take(of, axis=1)
        nl = _sums(go, ends).astype(float) if even else np.add.reduceat(go * w, s, axis=1)
        sl = np.add.reduceat(np.where(go, wy, 0.0), s, axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            score = sl ** 2 / nl + (total - sl) ** 2 / (n - nl)
        score[(low >= high) | (nl < min_leaf) | (n - nl < min_leaf) | ~np.isfinite(score)] = -np.inf
        best = score.argmax(0)
        gain = score[best, k] - total ** 2 / n
        pure = np.minimum.reduceat(y, s) >= np.maximum.reduceat(y, s)
        ok = np.isfinite(gain) & ~pure & (n >= 2 * min_leaf)
        if max_depth is not None and depth >= max_depth:
            ok[:] = False
        if not ok.any():
            return out.tree()
        left = out.split(nodes[ok], best[ok], cut[best, k][ok], gain[ok])
        rows = np.flatnonzero(ok.take(of))
        mine = go.reshape(-1).take(best.take(of.take(rows)) * len(y) + rows)
        sizes = sizes[ok]
        lefts = _sums(mine, np.cumsum(sizes))
        order = np.empty(len(rows), np.int64)
        order[_dealing(lefts, sizes)(mine)] = rows
        x, y, w = x.take(order, axis=1), y.take(order), w.take(order)
        sizes = np.stack([lefts, sizes - lefts], 1).ravel()
        nodes, depth = np.stack([left, left + 1], 1).ravel(), depth + 1


def grow_best(x: np.ndarray, y: np.ndarray, w: np.ndarray, seed=None, min_leaf: int = 1, max_depth: int | None = None) -> Tree:
    """Tree of best squared-error splits over all features and all thresholds between neighbouring values."""
    out = Builder(len(x))
    keep = w > 0
    x, y, w = x[:, keep], y[keep], w[keep]
    if not len(y):
        return out.tree()
    order = np.argsort(x, axis=1, kind="stable")  # rows by (node, value), per feature
    wy = w * y
    nodes, sizes, depth = np.array([0]), np.array([len(y)]), 0
    while True:
        s, m, k = _starts(sizes), len(order[0]), len(nodes)
        of = np.repeat(np.arange(k), sizes)
        o = order[0]
        n, total = np.add.reduceat(w.take(o), s), np.add.reduceat(wy.take(o), s)
        out.set_value(nodes, total / n)
        label = y.take(o)
        pure = np.minimum.reduceat(label, s) >= np.maximum.reduceat(label, s)
        last = np.zeros(m, bool)
        last[np.cumsum(sizes) - 1] = True
        n_row, t_row = n.take(of), total.take(of)
        top, feature, place = np.full(k, -np.inf), np.zeros(k, np.int64), np.zeros(k, np.int64)
        for f in range(len(x)):
            o = order[f]
            v, w_o, wy_o = x[f].take(o), w.take(o), wy.take(o)
            can = ~last
            can[:-1] &= v[1:] > v[:-1]
            at = np.flatnonzero(can)
            if not len(at):
                continue
            cw, cs = np.cumsum(w_o), np.cumsum(wy_o)
            own = of.take(at)
            nl = cw.take(at) - (cw.take(s) - w_o.take(s)).take(own)
            sl = cs.take(at) - (cs.take(s) - wy_o.take(s)).take(own)
            n_at, t_at = n_row.take(at), t_row.take(at)
            if min_leaf > 1 or (w_o < 1).any():
                fits = (nl >= min_leaf) & (n_at - nl >= min_leaf)
                at, own, nl, sl, n_at, t_at = (c[fits] for c in (at, own, nl, sl, n_at, t_at))
                if not len(at):
                    continue
            score = sl ** 2 / nl + (t_at - sl) ** 2 / (n_at - nl)
            first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            some = own.take(first)
            high = np.maximum.reduceat(score, first)
            better = high > top.take(some)
            aim = np.full(k, np.nan)
            aim[some[better]] = high[better]
            hits = np.flatnonzero(score == aim.take(own))
            if len(hits):
                mine, one = np.unique(own.take(hits), return_index=True)
                top[mine], feature[mine], place[mine] = aim[mine], f, at[hits[one]]
        gain = top - total ** 2 / n
        ok = np.isfinite(gain) & (gain > 1e-12 * np.maximum(np.abs(total ** 2 / n), 1e-300)) & ~pure
        if max_depth is not None and depth >= max_depth:
            ok[:] = False
        if not ok.any():
            return out.tree()
        f, p = feature[ok], place[ok]
        a, b = x[f, order[f, p]], x[f, order[f, p + 1]]
        cut = a + (b - a) / 2
        cut = np.where(cut >= b, a, cut)
        left = out.split(nodes[ok], f, cut, gain[ok])
        kept, sizes = np.flatnonzero(ok.take(of)), sizes[ok]
        of = np.repeat(np.arange(len(sizes)), sizes)
        o = order[0].take(kept)
        goes = np.zeros(len(y), bool)
        goes[o] = x.reshape(-1).take(f.take(of) * len(y) + o) <= cut.take(of)
        lefts = _sums(goes.take(o), np.cumsum(sizes))
        places = _dealing(lefts, sizes)
        new = np.empty((len(x), len(o)), np.int64)
        for i in range(len(x)):
            r = order[i].take(kept)
            new[i][places(goes.take(r))] = r
        sizes = np.stack([lefts, sizes - lefts], 1).ravel()
        order, nodes, depth = new, np.stack([left, left + 1], 1).ravel(), depth + 1


# ---- trees over many rows ------------------------------------------------------------------------

DEEP_ROWS = 1 << 17  # of more rows, a tree's upper nodes are split one at a time
PIECE_ROWS = 1 << 13  # rows that a core's cache holds; such nodes are grown level by level


@dataclass
class Coded:
    """Features as places among their distinct values."""
    codes: list[np.ndarray]
    values: list[np.ndarray]

    @classmethod
    def of(cls, features) -> "Coded":
        codes, values = [], []
        for v in features:
            distinct, place = np.unique(v, return_inverse=True)
            codes.append(place.astype(np.min_scalar_type(len(distinct))))
            values.append(distinct)
        return cls(codes, values)

    def rows(self, rows: np.ndarray | None = None) -> np.ndarray:
        return np.stack([v.take(c if rows is None else c.take(rows)) for c, v in zip(self.codes, self.values)])


def grow(random: bool, x: np.ndarray, y: np.ndarray, w: np.ndarray, seed: list, min_leaf: int = 1, max_depth: int | None = None) -> Tree:
    """A tree over any number of rows."""
    if len(y) <= DEEP_ROWS:
        return (grow_random if random else grow_best)(x, y, w, seed, min_leaf, max_depth)
    return join_trees(*grow_pieces(random, Coded.of(x), y, w, seed, min_leaf, max_depth))


def grow_pieces(random: bool, x: Coded, y: np.ndarray, w: np.ndarray, seed: list, min_leaf: int = 1,
                max_depth: int | None = None) -> tuple[Tree, dict[int, Tree]]:
    """The upper nodes of a tree, split one at a time by the same rules over codes, and the trees that hang under its leaves."""
    top, pieces, wy = Builder(len(x.codes)), {}, w * y
    todo = [(0, np.flatnonzero(w > 0), 0)]
    while todo:
        node, rows, level = todo.pop()
        found = None
        if len(rows) > PIECE_ROWS and (max_depth is None or level < max_depth):
            label, weight = wy.take(rows), w.take(rows)
            n, total = weight.sum(), label.sum()
            draw = np.random.default_rng([*seed, node]).random(len(x.codes)) if random else None
            for f, (codes, values) in enumerate(zip(x.codes, x.values)):
                split = _one_split(codes.take(rows), values, label, weight, n, total, min_leaf, None if draw is None else draw[f])
                if split is not None and (found is None or split[0] > found[0]):
                    found = *split, f
        gain = found[0] - total ** 2 / n if found else 0.0
        if not found or (not random and gain <= 1e-12 * max(abs(total ** 2 / n), 1e-300)) or np.ptp(y.take(rows)) <= 0:
            grower = grow_random if random else grow_best
            pieces[node] = grower(x.rows(rows), y.take(rows), w.take(rows), [*seed, node, 1], min_leaf, None if max_depth is None else max_depth - level)
            continue
        _, cut, code, f = found
        at = np.array([node])
        top.set_value(at, total / n)
        first = int(top.split(at, np.array([f]), np.array([cut]), np.array([gain]))[0])
        goes = x.codes[f].take(rows) <= code
        todo += [(first, rows[goes], level + 1), (first + 1, rows[~goes], level + 1)]
    return top.tree(), pieces


def _one_split(codes: np.ndarray, values: np.ndarray, label, weight, n: float, total: float, min_leaf: int, draw: float | None):
    """(score, threshold, last code on the left) of one feature in one node: at the drawn threshold, or the best of all."""
    low, high = int(codes.min()), int(codes.max())
    if low == high:
        return None
    if draw is not None:
        cut = values[low] + draw * (values[high] - values[low])
        cut = cut if cut < values[high] else values[low]
        code = int(np.searchsorted(values, cut, "right")) - 1
        goes = codes <= code
        nl, sl, at = np.array([weight.dot(goes)]), np.array([label.dot(goes)]), np.array([code])
    else:
        if high - low < 8 * len(codes):
            place = codes.astype(np.int64) - low
            rows = np.bincount(place)
            at = np.flatnonzero(rows)
            cw, cs = np.bincount(place, weight).take(at), np.bincount(place, label).take(at)
            at += low
        else:
            order = np.argsort(codes, kind="stable")
            ranked = codes.take(order)
            first = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
            at, cw, cs = ranked.take(first).astype(np.int64), np.add.reduceat(weight.take(order), first), np.add.reduceat(label.take(order), first)
        nl, sl = np.cumsum(cw)[:-1], np.cumsum(cs)[:-1]
    can = (nl >= min_leaf) & (n - nl >= min_leaf) & (nl > 0) & (n > nl)
    if not can.any():
        return None
    score = np.full(len(nl), -np.inf)
    score[can] = sl[can] ** 2 / nl[can] + (total - sl[can]) ** 2 / (n - nl[can])
    best = int(score.argmax())
    if draw is None:
        a, b = values[at[best]], values[at[best + 1]]
        cut = a + (b - a) / 2
        cut = cut if cut < b else a
    return score[best], cut, int(at[best])


def join_trees(top: Tree, parts: dict[int, Tree]) -> Tree:
    """``top`` with some of its leaves replaced by whole trees."""
    feature, threshold, left, value = [top.feature.copy()], [top.threshold.copy()], [top.left.copy()], [top.value.copy()]
    size, gain = top.size, top.gain.copy()
    for node, t in parts.items():
        shifted = np.where(t.feature >= 0, t.left + size, 0).astype(np.int32)
        for head, tail in ((feature, t.feature), (threshold, t.threshold), (left, shifted), (value, t.value)):
            head[0][node] = tail[0]  # the part's root stands in the leaf; its own place stays unused
            head.append(tail)
        size += t.size
        gain += t.gain
    return Tree(*(np.concatenate(c) for c in (feature, threshold, left, value)), gain)
