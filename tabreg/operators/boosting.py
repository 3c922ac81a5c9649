"""Boosted regression trees over binned features: three ways to grow a tree, and AdaBoost.R2, as Spark ML stages.

Features are binned once: cut points come from a weighted quantile sketch (mergeable summaries per task, merged and
pruned as they stream in), and rows are kept as blocks of one byte per feature and row. All growers ask for the same
thing, gradient histograms: (sum of gradients, sum of Hessians) per (node, feature, bin).

- ``depth``: level by level, second-order gain ``GL^2/(HL+l2) + GR^2/(HR+l2) - G^2/(H+l2)``, leaf weight ``-G/(H+l2)``;
- ``leaf``: best leaf first up to ``maxLeaves``; of two children only the smaller one's histogram is summed, the other's
  is the difference to their parent. Leaves that may be split next are evaluated together: splits are played
  in order of gain, and those whose children are unknown are asked for in one go, until the order stands;
- ``oblivious``: one split for all nodes of a level, chosen by the gain summed over them; leaf number as bits.

Large tables: a histogram is one job. Each task sums its blocks into one array per feature, arrays of a feature are
added up where they meet, the search runs there, and one small result per feature returns (arrays of ``DRIVER_BYTES`` at
most over all tasks are added up on the driver, which then gets the larger of two children as the difference to their
parent). Features of few bins are counted together as digits of one number. Scores (or weights) of the rows
are an array of each chunk of blocks that a round replaces: persisted, and checkpointed every ``WRITE_EVERY`` rounds.
Tables of ``localRows`` rows at most run the same growers inside one task over the same blocks, with the same result.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabreg.cluster import BLOCK_TABLE, arrow, ship, written
from tabreg.operators import treegrow as G
from tabreg.operators.quantile import prune
from tabreg.session import ensure_checkpoint_dir

LOCAL_ROWS = 200_000
WRITE_EVERY = 25
SKETCH = 4096
BLOCK_ROWS = 1 << 16
CHUNK_ROWS = 1 << 16  # rows that large tables sum at once
PART_ROWS = 1 << 21
CELLS = 1 << 10  # joint bins of features that are counted together
DRIVER_BYTES = 32 << 20  # histograms of all tasks that the driver adds up itself


# ---- cut points ----------------------------------------------------------------------------------

def cut_points(values: np.ndarray, weights: np.ndarray, bins: int) -> np.ndarray:
    """Thresholds between bins: between all neighbours if there are few values, else at equal steps of weight."""
    if len(values) <= bins:
        return (values[1:] + values[:-1]) / 2
    upto = np.cumsum(weights)
    pick = np.unique(np.searchsorted(upto, upto[-1] * np.arange(1, bins) / bins))
    pick = pick[pick < len(values) - 1]
    return (values[pick] + values[pick + 1]) / 2


def sketch_cuts(df: DataFrame, bins: int, size: int = SKETCH) -> list[np.ndarray]:
    """Cut points of each feature of (x array, w): task summaries, merged per feature as they stream in."""
    def local(batches):
        held: dict[int, list] = {}
        for batch in batches:
            if not len(batch):
                continue
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(batch), -1)
            w = batch.column(1).to_numpy(zero_copy_only=False).astype(float)
            for f in range(x.shape[1]):
                old = held.get(f)
                v, u = (x[:, f], w) if old is None else (np.append(old[0], x[:, f]), np.append(old[1], w))
                held[f] = prune(v, u, size)
        yield from rows(held)

    def merge(batches):
        held: dict[int, tuple] = {}
        for batch in batches:
            for f, v, w in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                v, w = (np.frombuffer(c.as_buffer(), float) for c in (v, w))
                held[f] = prune(v, w, size) if f not in held else prune(np.append(held[f][0], v), np.append(held[f][1], w), size)
        yield from rows(held)

    def rows(held):
        if held:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(held), pa.int32()), *(pa.array([held[f][i].tobytes() for f in held], pa.binary()) for i in (0, 1))],
                ["feature", "v", "w"])
    kind = "feature int, v binary, w binary"
    merged = df.transform(arrow, local, kind).repartition("feature").transform(arrow, merge, kind).collect()  # a row per feature
    return [cut_points(np.frombuffer(r["v"], float), np.frombuffer(r["w"], float), bins) for r in sorted(merged, key=lambda r: r["feature"])]


# ---- blocks --------------------------------------------------------------------------------------

STATE = "block long, n int, codes binary, y binary, s binary"


def _to_blocks(cuts: Sequence[np.ndarray], first: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part, seq = TaskContext.get().partitionId(), 0
        for batch in batches:
            for a in range(0, len(batch), BLOCK_ROWS):
                b = batch.slice(a, BLOCK_ROWS)
                x = b.column(0).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(b), -1)
                codes = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)]).astype(np.uint8)
                y = b.column(1).to_numpy(zero_copy_only=False).astype(float)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part << 32 | seq], pa.int64()), pa.array([len(b)], pa.int32()),
                     *(pa.array([v.tobytes()], pa.binary()) for v in (codes, y, np.full(len(b), first)))], ["block", "n", "codes", "y", "s"])
                seq += 1
    return run


def _open(batch: pa.RecordBatch, i: int):
    n = batch.column("n")[i].as_py()
    codes = np.frombuffer(batch.column("codes")[i].as_buffer(), np.uint8).reshape(-1, n)
    y, s = (np.frombuffer(batch.column(c)[i].as_buffer(), float) for c in ("y", "s"))
    return batch.column("block")[i].as_py(), codes, y, s


def _histogram(codes, local, g, h, nodes: int, bins: int, feature: int) -> np.ndarray:
    """[node, bin, (g, h)] of one feature for rows with a place in ``local``."""
    key = local * bins + codes[feature]
    out = np.empty((nodes * bins, 2))
    out[:, 0] = np.bincount(key, g, nodes * bins)
    out[:, 1] = np.bincount(key, h, nodes * bins)
    return out.reshape(nodes, bins, 2)


def _placed(node: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows that lie in a wanted node, and which one."""
    place = np.full(int(max(node.max(initial=0), wanted.max(initial=0))) + 1, -1)
    place[wanted] = np.arange(len(wanted))
    local = place[node]
    rows = np.flatnonzero(local >= 0)
    return rows, local[rows]


class Local:
    """Blocks of a small table, inside a task."""

    def __init__(self, blocks: list, bins: int):
        self.blocks, self.bins = blocks, bins  # (block, codes, y, s)
        self.at: dict[int, np.ndarray] = {}
        self.grads: dict[int, tuple] = {}

    def width(self) -> int:
        return len(self.blocks[0][1])

    def hist(self, tree: G.Tree, nodes: np.ndarray, features: Sequence[int], grad: Callable, search: Callable, family=None) -> list:
        total = {f: 0.0 for f in features}
        for i, (block, codes, y, s) in enumerate(self.blocks):
            if tree.size == 1:  # a new tree
                self.at[i], self.grads[i] = np.zeros(len(y), np.int64), grad(block, y, s)
            self.at[i] = G.walk(tree, codes, self.at[i])
            rows, local = _placed(self.at[i], nodes)
            g, h = (v[rows] for v in self.grads[i])
            part = codes[:, rows] if len(rows) < len(y) else codes
            for f in features:
                total[f] = total[f] + _histogram(part, local, g, h, len(nodes), self.bins, f)
        return [(f, search(total[f])) for f in features]

    def update(self, change: Callable) -> None:
        self.blocks = [(b, c, y, change(b, c, y, s, self.reached(i, change))) for i, (b, c, y, s) in enumerate(self.blocks)]

    def gather(self, small: Callable) -> list:
        return [small(b, c, y, s, self.reached(i, small)) for i, (b, c, y, s) in enumerate(self.blocks)]

    def reached(self, i: int, what) -> np.ndarray | None:
        """Nodes of ``what``'s tree that the rows have reached while it grew."""
        tree = getattr(what, "tree", None)
        return self.at.get(i) if tree is not None and tree.grown_here else None


class Bundles:
    """Features that are counted together: their bins are digits of one number below ``CELLS`` (a feature with more bins stands alone)."""

    def __init__(self, bins: Sequence[int], features: Sequence[int]):
        self.bins, self.features, self.groups = bins, list(features), []
        for f in sorted(features, key=lambda f: (-bins[f], f)):
            for group in self.groups:
                if self.cells(group) * bins[f] <= CELLS:
                    group.append(f)
                    break
            else:
                self.groups.append([f])

    def cells(self, group: Sequence[int]) -> int:
        return math.prod(self.bins[f] for f in group)

    def empty(self, nodes: int) -> list[np.ndarray]:
        return [np.zeros((2, nodes * self.cells(g))) for g in self.groups]

    def add(self, totals: list[np.ndarray], codes: np.ndarray, local: np.ndarray | None, g: np.ndarray, h: np.ndarray | None) -> None:
        """Sums of ``g`` and ``h`` (None: 1 a row) by place in ``local`` (None: one node) and joint bin."""
        for group, total in zip(self.groups, totals):
            key = codes[group[0]]
            for f in group[1:]:
                key = key.astype(np.uint16, copy=key.dtype == np.uint8)
                key *= np.uint16(self.bins[f])
                key += codes[f]
            if local is None:
                key = key.astype(np.intp)
            else:
                key = local * self.cells(group) + key
            total[0] += np.bincount(key, g, total.shape[1])
            total[1] += np.bincount(key, h, total.shape[1])

    def by_feature(self, totals: list[np.ndarray], nodes: int) -> dict[int, np.ndarray]:
        """[node, bin, (g, h)] of each feature."""
        out = {}
        for group, total in zip(self.groups, totals):
            joint = total.reshape(2, nodes, *(self.bins[f] for f in group))
            for i, f in enumerate(group):
                out[f] = np.moveaxis(joint.sum(axis=tuple(2 + j for j in range(len(group)) if j != i)), 0, 2)
        return out


class Distributed:
    """Blocks of a large table, as a persisted RDD of chunks (several blocks, as arrays): rounds are many short jobs, and planning a
    DataFrame took longer than most of them. Every call but ``update`` is a job; an update is computed by the next job."""

    def __init__(self, blocks: DataFrame, bins: int, widths: Sequence[int], rows: int, residuals: bool):
        """``widths``: bins that each feature has; ``residuals``: labels are needed no further than in scores less labels."""
        sc = blocks.sparkSession.sparkContext
        ship(blocks.sparkSession)
        ensure_checkpoint_dir(blocks.sparkSession)
        self.bins, self.widths, self.rounds, self.old, self.adders = bins, list(widths), 0, [], sc.defaultParallelism
        self.graded, self.known = None, None
        parts = sc.defaultParallelism * max(1, math.ceil(rows / PART_ROWS / sc.defaultParallelism))
        self.rows = blocks.repartition(parts).rdd.mapPartitions(_Chunks(residuals)).persist(StorageLevel.MEMORY_AND_DISK)

    def width(self) -> int:
        return len(self.widths)

    def hist(self, tree, nodes, features, grad, search, family=None) -> list:
        """``family``: for nodes that are pairs of children, their parents' places among the nodes asked for last, and whether the
        left child is the smaller one."""
        if tree.size == 1:
            self.known = None
            if grad.costly:  # worth being held for the levels to come
                self.graded = self.rows.map(_Graded(grad)).persist(StorageLevel.MEMORY_AND_DISK)
        cells = sum(self.widths[f] for f in features)
        parts = self.rows.getNumPartitions()
        ask, pairs = nodes, None
        if family is not None and self.known is not None:
            pairs = nodes.reshape(-1, 2)
            ask = np.where(family[1], pairs[:, 0], pairs[:, 1])
        source = self.rows if self.graded is None else self.graded
        sent = source.mapPartitions(_Partial(tree, ask, Bundles(self.widths, features), grad if self.graded is None else None))
        if parts * cells * len(ask) * 16 > DRIVER_BYTES:
            if pairs is not None:
                self.known = None
                return self.hist(tree, nodes, features, grad, search)
            self.known = None
            found = sent.flatMap(dict.items).reduceByKey(np.add, min(len(features), self.adders)).mapValues(_Searched(self.bins, search))
            return self.done(sorted(found.collect(), key=lambda r: r[0]))
        total: dict[int, np.ndarray] = {}  # a shuffle would take longer
        for part in sent.collect():
            for f, h in part.items():
                total[f] = total[f] + h if f in total else h
        if pairs is not None:
            for f, small in total.items():
                large = self.known[f][family[0]] - small
                large[..., 0][large[..., 1] == 0] = 0.0
                left = family[1][:, None, None]
                total[f] = np.stack([np.where(left, small, large), np.where(left, large, small)], 1).reshape(len(nodes), -1, 2)
        self.known = total
        return self.done([(f, _Searched(self.bins, search)(total[f])) for f in sorted(total)])

    def update(self, change) -> None:
        self.done(None)
        self.rounds += 1
        self.old = [self.rows] + ([self.graded] if self.graded is not None else [])
        self.graded = None
        self.rows = self.rows.map(_Changed(change)).persist(StorageLevel.MEMORY_AND_DISK)
        if self.rounds % WRITE_EVERY == 0:
            self.rows.checkpoint()

    def gather(self, small: Callable) -> list:
        got = self.rows.flatMap(_Small(small)).collect()  # a few numbers per block of rows
        return self.done([v for _, v in sorted(got, key=lambda r: r[0])])

    def done(self, result):
        """After a job: the rows are held, and those from before the last update can go."""
        for rdd in self.old:
            rdd.unpersist()
        self.old = []
        return result

    def close(self) -> None:
        self.done(None)
        if self.graded is not None:
            self.graded.unpersist()
        self.rows.unpersist()


class _Chunks:
    """Rows of the written table -> chunks: ((block, rows) of each block, codes, labels, scores or weights)."""

    def __init__(self, residuals: bool):
        self.residuals = residuals

    def __call__(self, rows):
        held, n = [], 0
        for row in rows:
            held.append(row)
            n += row["n"]
            if n >= CHUNK_ROWS:
                yield self.joined(held)
                held, n = [], 0
        if held:
            yield self.joined(held)

    def joined(self, rows):
        codes = np.concatenate([np.frombuffer(bytes(r["codes"]), np.uint8).reshape(-1, r["n"]) for r in rows], 1)
        y, s = (np.concatenate([np.frombuffer(bytes(r[c]), float) for r in rows]) for c in ("y", "s"))
        ids = tuple((r["block"], r["n"]) for r in rows)
        return (ids, codes, None, s - y) if self.residuals else (ids, codes, y, s)


def _each(ids):
    """(block, its rows in the chunk)."""
    a = 0
    for block, n in ids:
        yield block, slice(a, a + n)
        a += n


def _gradients(grad, ids, y, s):
    """(g, h) of a chunk; h is None if it is 1 for all rows."""
    if grad.plain:
        return grad(None, y, s)[0], None
    g, h = zip(*(grad(b, None if y is None else y[r], s[r]) for b, r in _each(ids)))
    return np.concatenate(g), np.concatenate(h)


class _Graded:
    """Chunks of the rows that have weight, with gradients in place of labels and scores."""

    def __init__(self, grad):
        self.grad = grad

    def __call__(self, chunk):
        ids, codes, y, s = chunk
        g, h = _gradients(self.grad, ids, y, s)
        rows = np.flatnonzero(h)
        return ids, codes[:, rows], g[rows], h[rows]


class _Partial:
    """A task's histograms by feature; ``grad`` None: chunks hold gradients."""

    def __init__(self, tree, nodes, bundles: Bundles, grad):
        self.tree, self.nodes, self.bundles, self.grad = tree, nodes, bundles, grad

    def __call__(self, chunks):
        totals = self.bundles.empty(len(self.nodes))
        place = np.full(self.tree.size, -1, np.int16 if len(self.nodes) < 1 << 15 else np.int64)
        place[self.nodes] = np.arange(len(self.nodes))
        for ids, codes, y, s in chunks:
            g, h = (y, s) if self.grad is None else _gradients(self.grad, ids, y, s)
            local = None if self.tree.size == 1 else place.take(G.walk(self.tree, codes))
            some = None if local is None else local >= 0
            if self.grad is not None and h is not None:  # h is 0 or 1
                some = h > 0 if some is None else some & (h > 0)
                h = None
            if some is not None:
                rows = np.flatnonzero(some)
                codes, g, h = codes.take(rows, axis=1), g.take(rows), None if h is None else h.take(rows)
                local = None if local is None else local.take(rows).astype(np.int64)
            self.bundles.add(totals, codes, local if len(self.nodes) > 1 else None, g, h)
        yield self.bundles.by_feature(totals, len(self.nodes))


class _Searched:
    """A search over a feature's histogram, filled up to the bins of all features."""

    def __init__(self, bins: int, search: Callable):
        self.bins, self.search = bins, search

    def __call__(self, h: np.ndarray):
        whole = np.zeros((len(h), self.bins, 2))
        whole[:, :h.shape[1]] = h
        return self.search(whole)


class _Small:
    def __init__(self, small: Callable):
        self.small = small

    def __call__(self, chunk):
        ids, codes, y, s = chunk
        return [(b, self.small(b, codes[:, r], y[r], s[r])) for b, r in _each(ids)]


class _Changed:
    def __init__(self, change: Callable):
        self.change = change

    def __call__(self, chunk):
        return *chunk[:3], np.asarray(self.change(*chunk), float)


# ---- growing one tree ----------------------------------------------------------------------------

def _sides(h: np.ndarray, l2: float, least: float):
    """From [node, bin, 2]: left sums per bin, totals, and the gain of a cut behind each bin (-inf where not allowed)."""
    left = np.cumsum(h, axis=1)
    total = left[:, -1:, :]
    right = total - left
    with np.errstate(divide="ignore", invalid="ignore"):
        score = lambda v: np.where(v[..., 1] + l2 > 0, v[..., 0] ** 2 / (v[..., 1] + l2), 0.0)
        gain = score(left) + score(right) - score(total)
    few = 1e-9
    gain[(left[..., 1] < max(least, few)) | (right[..., 1] < max(least, few))] = -np.inf
    return left, total[:, 0], gain


class PerNode:
    """Best cut of one feature for each node: (gain, bin, left sums, totals)."""

    def __init__(self, l2: float, least: float):
        self.l2, self.least = l2, least

    def __call__(self, h: np.ndarray):
        left, total, gain = _sides(h, self.l2, self.least)
        bin_ = gain.argmax(1)
        k = np.arange(len(h))
        return gain[k, bin_], bin_, left[k, bin_], total


class PerLevel:
    """Best cut of one feature for all nodes together: (gain, bin, left sums, totals)."""

    def __init__(self, l2: float, least: float):
        self.l2, self.least = l2, least

    def __call__(self, h: np.ndarray):
        left, total, gain = _sides(h, self.l2, 0.0)
        whole = np.where(np.isfinite(gain), gain, 0.0).sum(0)  # a node that a cut leaves whole gains nothing
        bin_ = int(whole[:-1].argmax()) if h.shape[1] > 1 else 0
        return float(whole[bin_]), bin_, left[:, bin_], total


class Whole:
    def __call__(self, h: np.ndarray):
        return h


def _leaf(sums: np.ndarray, l2: float) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(sums[..., 1] + l2 > 0, -sums[..., 0] / (sums[..., 1] + l2), 0.0)


TINY = 1e-12


def grow_depth(data, grad, features, p: dict) -> G.Tree:
    out, nodes, family = G.Builder(data.width()), np.array([0]), None
    for level in range(p["depth"]):
        found = data.hist(out.tree(), nodes, features, grad, PerNode(p["l2"], p["least"]), family)
        gains = np.stack([r[1][0] for r in found])
        pick, k = gains.argmax(0), np.arange(len(nodes))
        gain, total = gains[pick, k], found[0][1][3]
        if level == 0:
            out.set_value(nodes, _leaf(total, p["l2"]))
        ok = gain > TINY * np.maximum(1.0, np.abs(total[:, 0]))
        if not ok.any():
            break
        feature = np.array([found[i][0] for i in pick])
        bins = np.array([found[i][1][1][j] for j, i in enumerate(pick)])
        left = np.array([found[i][1][2][j] for j, i in enumerate(pick)])
        first = out.split(nodes[ok], feature[ok], bins[ok].astype(float), gain[ok])
        sums = np.stack([left[ok], (total - left)[ok]], 1).reshape(-1, 2)
        nodes, family = np.stack([first, first + 1], 1).ravel(), (np.flatnonzero(ok), sums[::2, 1] <= sums[1::2, 1])
        out.set_value(nodes, _leaf(sums, p["l2"]))
    return out.tree(True)


def grow_oblivious(data, grad, features, p: dict) -> G.Tree:
    out, nodes, family = G.Builder(data.width()), np.array([0]), None
    for level in range(p["depth"]):
        found = data.hist(out.tree(), nodes, features, grad, PerLevel(p["l2"], p["least"]), family)
        f, (gain, bin_, left, total) = max(found, key=lambda r: (r[1][0], -r[0]))
        if level == 0:
            out.set_value(nodes, _leaf(total, p["l2"]))
        if gain <= TINY:
            break
        first = out.split(nodes, np.full(len(nodes), f), np.full(len(nodes), float(bin_)), np.full(len(nodes), gain / len(nodes)))
        sums, family = np.stack([left, total - left], 1).reshape(-1, 2), (np.arange(len(nodes)), left[:, 1] <= total[:, 1] - left[:, 1])
        nodes = np.stack([first, first + 1], 1).ravel()
        out.set_value(nodes, _leaf(sums, p["l2"]))
    return out.tree(True)


def grow_leaf(data, grad, features, p: dict) -> G.Tree:
    """Best leaf first; histograms of the smaller children only, asked for in batches."""
    search, names = PerNode(p["l2"], p["least"]), list(features)

    def judged(hist: np.ndarray) -> dict:  # [feature, bin, 2]
        gain, bin_, left, total = search(hist)
        f = int(gain.argmax())
        return {"hist": hist, "gain": float(gain[f]), "feature": names[f], "bin": float(bin_[f]), "left": left[f], "total": total[f], "kids": None}

    spec = G.Builder(data.width())  # all splits evaluated so far, also those that the order drops later
    root = data.hist(spec.tree(), np.array([0]), features, grad, Whole())
    known = {0: judged(np.stack([h[0] for _, h in root]))}
    while True:
        order, open_, unknown = [], [0], []
        while len(order) + 1 < p["leaves"] and open_:
            best = max(open_, key=lambda i: (known[i]["gain"], -i))
            if not known[best]["gain"] > TINY * max(1.0, abs(known[best]["total"][0])):
                break
            open_.remove(best)
            order.append(best)
            if known[best]["kids"]:
                open_ += known[best]["kids"]
            elif len(order) + 1 < p["leaves"]:
                unknown.append(best)
        if not unknown:
            break
        ask = []
        for i in unknown:
            k = known[i]
            first = int(spec.split(np.array([i]), np.array([k["feature"]]), np.array([k["bin"]]), np.array([0.0]))[0])
            smaller_left = k["left"][1] <= k["total"][1] - k["left"][1]
            k["kids"] = [first, first + 1]
            ask.append((i, first if smaller_left else first + 1, first + 1 if smaller_left else first))
        got = data.hist(spec.tree(), np.array([a[1] for a in ask]), features, grad, Whole())
        for j, (parent, small, large) in enumerate(ask):
            h = np.stack([v[j] for _, v in got])
            known[small], known[large] = judged(h), judged(known[parent]["hist"] - h)
    out, ids = G.Builder(data.width()), {0: 0}
    out.set_value(np.array([0]), _leaf(known[0]["total"], p["l2"])[None])
    for i in order:
        k = known[i]
        first = int(out.split(np.array([ids[i]]), np.array([k["feature"]]), np.array([k["bin"]]), np.array([k["gain"]]))[0])
        out.set_value(np.array([first, first + 1]), _leaf(np.stack([k["left"], k["total"] - k["left"]]), p["l2"]))
        if k["kids"]:
            ids[k["kids"][0]], ids[k["kids"][1]] = first, first + 1
    return out.tree()


GROWERS = {"depth": grow_depth, "leaf": grow_leaf, "oblivious": grow_oblivious}


# ---- rounds --------------------------------------------------------------------------------------

class _Residual:
    """Gradients of the squared error, on a random share of the rows of each round."""

    costly = False

    def __init__(self, share: float, seed: int, round_: int):
        self.share, self.key, self.plain = share, [seed, round_], share >= 1

    def __call__(self, block, y, s):
        """``y`` None: ``s`` holds scores less labels."""
        r = s if y is None else s - y
        if self.plain:
            return r, np.ones(len(r))
        h = (np.random.default_rng([*self.key, block]).random(len(r)) < self.share).astype(float)
        return r * h, h


class _Step:
    def __init__(self, tree: G.Tree, rate: float):
        self.tree, self.rate = tree, rate

    def __call__(self, block, codes, y, s, at=None):
        return s + self.rate * G.predict(self.tree, codes, at)


def boost(data, p: dict) -> list[G.Tree]:
    """Trees of all rounds; their leaf values carry the learning rate."""
    trees = []
    for r in range(p["rounds"]):
        width = data.width()
        features = list(range(width))
        if p["columns"] < 1:
            features = sorted(np.random.default_rng([p["seed"], r]).permutation(width)[:max(1, int(p["columns"] * width))].tolist())
        tree = GROWERS[p["grow"]](data, _Residual(p["share"], p["seed"], r), features, p)
        data.update(_Step(tree, p["rate"]))
        tree.value = tree.value * p["rate"]
        trees.append(tree)
    return trees


class _Drawn:
    """A resample of the rows by weight: the block's share of all draws falls on its rows by the inverse of its
    cumulative weights; the tree's leaf values are means of the drawn labels."""

    costly, plain = True, False

    def __init__(self, draws: dict[int, int], seed: int, round_: int):
        self.draws, self.key = draws, [seed, round_]

    def __call__(self, block, y, s):
        upto = np.cumsum(s)
        u = np.random.default_rng([*self.key, block]).random(self.draws[block]) * upto[-1]
        c = np.bincount(np.minimum(np.searchsorted(upto, u, "right"), len(y) - 1), minlength=len(y)).astype(float)
        return -y * c, c


class _Errors:
    def __init__(self, tree):
        self.tree = tree

    def __call__(self, block, codes, y, s, at=None):
        e = np.abs(y - G.predict(self.tree, codes, at))
        return (float(e[s > 0].max(initial=0.0)), float((s * e).sum()))


class _Reweigh:
    def __init__(self, tree, most: float, beta: float, rate: float):
        self.tree, self.most, self.beta, self.rate = tree, most, beta, rate

    def __call__(self, block, codes, y, s, at=None):
        e = np.abs(y - G.predict(self.tree, codes, at)) / self.most
        return s * self.beta ** ((1.0 - e) * self.rate)


class _Weight:
    def __call__(self, block, codes, y, s, at=None):
        return block, float(s.sum()), len(y)


def adaboost(data, p: dict) -> tuple[list[G.Tree], list[float]]:
    """AdaBoost.R2 with linear loss: each round fits a tree on as many rows as there are, drawn by weight."""
    trees, weights = [], []
    for r in range(p["rounds"]):
        shares = data.gather(_Weight())  # block, weight, rows
        total, n = sum(w for _, w, _ in shares), sum(k for *_, k in shares)
        if not total > 0:
            break
        draws = np.random.default_rng([p["seed"], r]).multinomial(n, [w / total for _, w, _ in shares])
        tree = grow_depth(data, _Drawn({b: int(k) for (b, *_), k in zip(shares, draws)}, p["seed"], r), list(range(data.width())), p)
        errors = data.gather(_Errors(tree))
        most, mean = max(e for e, _ in errors), sum(s for _, s in errors) / total
        if most <= 0:  # a perfect tree ends it
            trees.append(tree)
            weights.append(1.0)
            break
        error = mean / most
        if error >= 0.5:
            if not trees:
                trees.append(tree)
                weights.append(1.0)
            break
        beta = max(error, 1e-300) / (1.0 - error)
        trees.append(tree)
        weights.append(p["rate"] * math.log(1.0 / beta))
        data.update(_Reweigh(tree, most, beta, p["rate"]))
    return trees, weights


def _run_local(kind: str, p: dict, bins: int):
    """The whole fit over the blocks of a small table."""
    def run(batches):
        blocks = [_open(b, i) for b in batches for i in range(len(b))]
        if blocks:
            data = Local(sorted(blocks, key=lambda b: b[0]), bins)
            result = adaboost(data, p) if kind == "adaboost" else (boost(data, p), None)
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(result)], pa.binary())], ["fit"])
    return run


# ---- stages --------------------------------------------------------------------------------------

class _Common(HasFeaturesCol, HasLabelCol, HasPredictionCol):
    rounds = Param(Params._dummy(), "rounds", "boosting rounds", TypeConverters.toInt)
    rate = Param(Params._dummy(), "rate", "learning rate", TypeConverters.toFloat)
    depth = Param(Params._dummy(), "depth", "levels of a tree", TypeConverters.toInt)
    maxBins = Param(Params._dummy(), "maxBins", "bins per feature, 256 at most", TypeConverters.toInt)
    localRows = Param(Params._dummy(), "localRows", "rows that one task may fit", TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "seed of all draws", TypeConverters.toInt)

    def setFeaturesCol(self, v):
        return self._set(featuresCol=v)

    def setLabelCol(self, v):
        return self._set(labelCol=v)

    def setPredictionCol(self, v):
        return self._set(predictionCol=v)

    def _trained(self, df: DataFrame, kind: str, p: dict, first: Callable[[float], float]):
        """Bin, run the rounds (in a task or over the cluster); trees with real thresholds."""
        bins, label = self.getOrDefault(self.maxBins), self.getLabelCol()
        rows = df.select(vector_to_array(self.getFeaturesCol()).alias("x"), F.col(label).cast("double").alias("y"))
        facts = rows.agg(F.count("*").alias("n"), F.avg("y").alias("mean")).first()
        if not facts["n"]:
            raise ValueError("no rows to fit")
        cuts = sketch_cuts(rows.select("x", F.lit(1.0).alias("w")), bins)
        start = first(facts["mean"])
        blocks = written(rows.transform(arrow, _to_blocks(cuts, start), STATE), "binned", **BLOCK_TABLE)
        if facts["n"] <= self.getOrDefault(self.localRows):
            got = blocks.coalesce(1).transform(arrow, _run_local(kind, p, bins), "fit binary").first()
            trees, weights = pickle.loads(got["fit"])
        else:
            data = Distributed(blocks, bins, [len(c) + 1 for c in cuts], facts["n"], kind != "adaboost")
            trees, weights = adaboost(data, p) if kind == "adaboost" else (boost(data, p), None)
            data.close()
        for t in trees:
            inner = np.flatnonzero(t.feature >= 0)
            t.threshold[inner] = [cuts[t.feature[i]][int(t.threshold[i])] for i in inner]
        return start, trees, weights


class BoostedTrees(Estimator, _Common):
    """Gradient-boosted trees for the squared error. ``grow``: depth, leaf or oblivious (see the module)."""

    grow = Param(Params._dummy(), "grow", "how a tree grows", TypeConverters.toString)
    maxLeaves = Param(Params._dummy(), "maxLeaves", "leaves of a tree (grow=leaf)", TypeConverters.toInt)
    l2 = Param(Params._dummy(), "l2", "penalty on leaf weights", TypeConverters.toFloat)
    minChild = Param(Params._dummy(), "minChild", "least Hessian sum of a child", TypeConverters.toFloat)
    rowShare = Param(Params._dummy(), "rowShare", "share of rows per round", TypeConverters.toFloat)
    columnShare = Param(Params._dummy(), "columnShare", "share of features per round", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, featuresCol="features", labelCol="label", predictionCol="prediction", rounds=300, rate=0.05, depth=6, maxBins=256,
                 grow="depth", maxLeaves=31, l2=1.0, minChild=1.0, rowShare=1.0, columnShare=1.0, localRows=LOCAL_ROWS, seed=42):
        super().__init__()
        self._setDefault(featuresCol="features", labelCol="label", predictionCol="prediction", rounds=300, rate=0.05, depth=6, maxBins=256,
                         grow="depth", maxLeaves=31, l2=1.0, minChild=1.0, rowShare=1.0, columnShare=1.0, localRows=LOCAL_ROWS, seed=42)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> "BoostedTreesModel":
        get = self.getOrDefault
        if get(self.grow) not in GROWERS or not 2 <= get(self.maxBins) <= 256:
            raise ValueError("grow must be one of " + ", ".join(GROWERS) + "; maxBins in 2..256")
        p = {"rounds": get(self.rounds), "rate": get(self.rate), "depth": get(self.depth), "grow": get(self.grow), "leaves": get(self.maxLeaves),
             "l2": get(self.l2), "least": get(self.minChild), "share": get(self.rowShare), "columns": get(self.columnShare), "seed": get(self.seed)}
        start, trees, _ = self._trained(df, "boost", p, float)
        return BoostedTreesModel()._of(trees, start, self)


class AdaBoostR2(Estimator, _Common):
    """AdaBoost.R2 (linear loss): trees on weighted resamples, weighted-median prediction."""

    @keyword_only
    def __init__(self, featuresCol="features", labelCol="label", predictionCol="prediction", rounds=50, rate=1.0, depth=3, maxBins=256,
                 localRows=LOCAL_ROWS, seed=42):
        super().__init__()
        self._setDefault(featuresCol="features", labelCol="label", predictionCol="prediction", rounds=50, rate=1.0, depth=3, maxBins=256,
                         localRows=LOCAL_ROWS, seed=42)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> "AdaBoostR2Model":
        get = self.getOrDefault
        p = {"rounds": get(self.rounds), "rate": get(self.rate), "depth": get(self.depth), "l2": 0.0, "least": 1.0, "seed": get(self.seed)}
        _, trees, weights = self._trained(df, "adaboost", p, lambda mean: 1.0)
        model = AdaBoostR2Model()._of(trees, 0.0, self)
        return model._set(weights=[float(w) for w in weights])


class _TreesModel(Model, HasFeaturesCol, HasPredictionCol, DefaultParamsReadable, DefaultParamsWritable):
    """Trees as flat arrays (saved with the pipeline like any stage), scored over Arrow batches."""

    feature = Param(Params._dummy(), "feature", "split features of all trees, -1 in leaves", TypeConverters.toListInt)
    threshold = Param(Params._dummy(), "threshold", "split thresholds (left if not above)", TypeConverters.toListFloat)
    left = Param(Params._dummy(), "left", "left children within a tree", TypeConverters.toListInt)
    value = Param(Params._dummy(), "value", "node values", TypeConverters.toListFloat)
    sizes = Param(Params._dummy(), "sizes", "nodes per tree", TypeConverters.toListInt)
    gains = Param(Params._dummy(), "gains", "gain per feature over all trees", TypeConverters.toListFloat)
    start = Param(Params._dummy(), "start", "prediction before the first tree", TypeConverters.toFloat)

    def _of(self, trees: Sequence[G.Tree], start: float, est):
        flat = lambda k: np.concatenate([getattr(t, k) for t in trees]).tolist()
        return self._set(feature=flat("feature"), threshold=flat("threshold"), left=flat("left"), value=flat("value"),
                         sizes=[t.size for t in trees], gains=np.sum([t.gain for t in trees], axis=0).tolist(), start=float(start),
                         featuresCol=est.getFeaturesCol(), predictionCol=est.getPredictionCol())

    def trees(self) -> list[G.Tree]:
        get = self.getOrDefault
        cuts = np.cumsum(get(self.sizes))[:-1]
        cols = [np.split(np.array(get(p), t), cuts) for p, t in ((self.feature, np.int16), (self.threshold, float), (self.left, np.int32), (self.value, float))]
        return [G.Tree(*c, np.zeros(0)) for c in zip(*cols)]

    @property
    def featureImportances(self):
        from pyspark.ml.linalg import Vectors
        g = np.array(self.getOrDefault(self.gains))
        return Vectors.dense(g / (g.sum() or 1.0))

    def _scorer(self) -> Callable[[np.ndarray], np.ndarray]:
        raise NotImplementedError

    def _transform(self, df: DataFrame) -> DataFrame:
        ship(df.sparkSession)
        score = self._scorer()

        @F.arrow_udf("double")
        def predicted(x: pa.Array) -> pa.Array:
            flat = x.flatten().to_numpy(zero_copy_only=False)
            return pa.array(score(np.ascontiguousarray(flat.reshape(len(x), -1).T)))
        return df.withColumn(self.getPredictionCol(), predicted(vector_to_array(self.getFeaturesCol())))


class BoostedTreesModel(_TreesModel):
    def _scorer(self):
        trees, start = self.trees(), self.getOrDefault(self.start)

        def score(x):
            out = np.full(x.shape[1], start)
            for t in trees:
                out += G.predict(t, x)
            return out
        return score


class AdaBoostR2Model(_TreesModel):
    weights = Param(Params._dummy(), "weights", "tree weights", TypeConverters.toListFloat)

    def _scorer(self):
        trees, weights = self.trees(), np.array(self.getOrDefault(self.weights))
        return lambda x: weighted_median(np.stack([G.predict(t, x) for t in trees]), weights)


def weighted_median(predictions: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Per column the first prediction, in order, whose running weight reaches half the total."""
    rows = np.ascontiguousarray(predictions.T)
    order = np.argsort(rows, axis=1, kind="stable")
    upto = np.cumsum(weights[order], axis=1)
    at = (upto >= 0.5 * upto[:, -1:]).argmax(1)
    each = np.arange(len(rows))
    return rows[each, order[each, at]]
