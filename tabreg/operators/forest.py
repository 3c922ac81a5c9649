"""Forests without a depth limit: extremely randomised trees and bootstrap forests, as Spark ML stages.

Fit, in two phases.

1. While a node holds more than ``localRows`` (at most ``NODE_ROWS``) rows, its level is split by aggregations over the whole table, for all
   open nodes of a group of trees at once: tasks route their blocks of rows through the trees so far and send
   (n, sum) per (tree, node, feature, bin); Spark sums them, a window accumulates over bins and ``max_by`` takes the best
   split, so one row per node returns. Random trees first aggregate each node's range, draw one threshold per
   (node, feature), and have two bins; best-split forests use the table's quantiles as bins here.
2. Smaller nodes go to one task each, which grows the rest exactly (``treegrow``). A table of ``localRows`` rows and
   ``LOCAL_BYTES`` as codes at most is broadcast instead (its features as places among their distinct values), and the trees
   are dealt to tasks: no row is shuffled and every split is exact.

The number of trees per group keeps open nodes under ``MOST_OPEN``, so what the driver holds does not grow with the data.
Bootstrap counts are Poisson(1) draws seeded by (tree, block of rows).

A fully grown forest is as large as its data, so the model is a table (a row per tree and part) in the shared
checkpoint folder, never held whole. Scoring deals blocks of rows to groups of trees (``GROUP_BYTES`` of nodes each)
and adds the partial sums up; rows of three ``LOCAL_BYTES`` at most are broadcast to the trees instead. ``save`` copies the table.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabreg.cluster import BLOCK_TABLE, arrow, table_path, written
from tabreg.operators import treegrow as G

LOCAL_ROWS = 3 << 20  # rows of a table that tasks may grow whole trees from
NODE_ROWS = 1 << 20  # of larger tables: rows of a node that one task may finish
LOCAL_BYTES = 128 << 20
TASKS_PER_CORE = 6  # tasks that share the trees of a small table
MOST_OPEN = 4096
GROUP_BYTES = 48 << 20
BINS = 64
BLOCK_ROWS = 1 << 16

BLOCKS = "block long, n int, x binary, y binary, rid binary"
PARTS = "tree int, node int, feature binary, threshold binary, left binary, value binary, gain array<double>"


# ---- blocks of rows ------------------------------------------------------------------------------

def _to_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (x array, y, rid) -> blocks: features x rows, labels and row ids as raw bytes."""
    part, seq = TaskContext.get().partitionId(), 0
    for batch in batches:
        for a in range(0, len(batch), BLOCK_ROWS):
            b = batch.slice(a, BLOCK_ROWS)
            flat = b.column(0).flatten().to_numpy(zero_copy_only=False).astype(float)
            x = np.ascontiguousarray(flat.reshape(len(b), -1).T)
            yield pa.RecordBatch.from_arrays(
                [pa.array([part << 32 | seq], pa.int64()), pa.array([len(b)], pa.int32()), pa.array([x.tobytes()], pa.binary()),
                 pa.array([b.column(1).to_numpy(zero_copy_only=False).astype(float).tobytes()], pa.binary()),
                 pa.array([b.column(2).to_numpy(zero_copy_only=False).astype(np.int64).tobytes()], pa.binary())],
                ["block", "n", "x", "y", "rid"])
            seq += 1


def blocks(df: DataFrame, features: str, label: str | None = None, rid: str | None = None) -> DataFrame:
    y = F.col(label).cast("double") if label else F.lit(0.0)
    r = F.col(rid) if rid else F.lit(0).cast("long")
    return df.select(vector_to_array(features).alias("x"), y.alias("y"), r.alias("rid")).transform(arrow, _to_blocks, BLOCKS)


def _open_block(batch: pa.RecordBatch, i: int):
    n = batch.column("n")[i].as_py()
    x = np.frombuffer(batch.column("x")[i].as_buffer(), float).reshape(-1, n)
    return batch.column("block")[i].as_py(), x, np.frombuffer(batch.column("y")[i].as_buffer(), float)


def _weights(bootstrap: bool, seed: int, tree: int, block: int, n: int) -> np.ndarray:
    return np.random.default_rng([seed, tree, block]).poisson(1.0, n).astype(float) if bootstrap else np.ones(n)


# ---- parts of trees ------------------------------------------------------------------------------

def _part(tree: int, node: int, t: G.Tree) -> tuple:
    return (tree, node, t.feature.tobytes(), t.threshold.tobytes(), t.left.tobytes(), t.value.tobytes(), t.gain.tolist())


def _part_batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ["tree", "node", "feature", "threshold", "left", "value", "gain"]
    types = [pa.int32(), pa.int32(), *[pa.binary()] * 4, pa.list_(pa.float64())]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


def _read_part(r) -> G.Tree:
    kinds = (("feature", np.int16), ("threshold", float), ("left", np.int32), ("value", float))
    return G.Tree(*(np.frombuffer(r[k], t) for k, t in kinds), np.array(r["gain"]))


TOP = -1  # part that holds a tree's upper levels; the others hang under the node of their number


def _grow_whole(data, random: bool, bootstrap: bool, seed: int, min_leaf: int, depth):
    """Whole trees over a broadcast table."""
    def run(batches):
        coded, y, shards = data.value
        few = len(y) <= G.DEEP_ROWS
        x = coded.rows() if few else None
        for batch in batches:
            for tree in batch.column(0).to_pylist():
                w = np.concatenate([_weights(bootstrap, seed, tree, b, n) for b, n in shards])
                if few:
                    yield _part_batch([_part(tree, 0, G.grow(random, x, y, w, [seed, tree, 0], min_leaf, depth))])
                else:
                    top, pieces = G.grow_pieces(random, coded, y, w, [seed, tree, 0], min_leaf, depth)
                    rows = [_part(tree, TOP, top), *(_part(tree, node, t) for node, t in pieces.items())]
                    for a in range(0, len(rows), 32):
                        yield _part_batch(rows[a:a + 32])
    return run


def _column(feature: int):
    """(block, n, values) of one feature, or of the labels (-1)."""
    def run(batches):
        for batch in batches:
            for i in range(len(batch)):
                block, x, y = _open_block(batch, i)
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([len(y)], pa.int32()),
                                                  pa.array([(y if feature < 0 else x[feature]).tobytes()], pa.binary())], ["block", "n", "v"])
    return run


# ---- upper levels --------------------------------------------------------------------------------

def _routed(tops: dict, bootstrap: bool, seed: int):
    """Per block and tree: (tree, rows of each node, x, y, w)."""
    def each(batch):
        for i in range(len(batch)):
            block, x, y = _open_block(batch, i)
            for tree, (top, wanted) in tops.items():
                w = _weights(bootstrap, seed, tree, block, len(y))
                node = G.walk(top, x)
                keep = np.flatnonzero((w > 0) & np.isin(node, wanted))
                if len(keep):
                    keep = keep[np.argsort(node[keep], kind="stable")]
                    ids, first = np.unique(node[keep], return_index=True)
                    yield tree, ids, first, x[:, keep], y[keep], w[keep]
    return each


def _send_ranges(tops, bootstrap, seed):
    def run(batches):
        for batch in batches:
            for tree, ids, first, x, y, w in _routed(tops.value, bootstrap, seed)(batch):
                k, f = len(ids), len(x)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(k * f, tree), pa.int32()), pa.array(np.tile(ids, f), pa.int32()),
                     pa.array(np.repeat(np.arange(f), k), pa.int32()),
                     pa.array(np.minimum.reduceat(x, first, axis=1).ravel()), pa.array(np.maximum.reduceat(x, first, axis=1).ravel())],
                    ["tree", "node", "feature", "low", "high"])
    return run


def _send_bins(tops, cuts, bootstrap, seed):
    """(tree, node, feature, bin, n, s): ``cuts`` maps a (tree, node) to thresholds per feature, or holds those of the table."""
    def run(batches):
        table = cuts.value
        for batch in batches:
            for tree, ids, first, x, y, w in _routed(tops.value, bootstrap, seed)(batch):
                local = np.repeat(np.arange(len(ids)), np.diff(np.append(first, len(y))))
                for f in range(len(x)):
                    if isinstance(table, dict):
                        edge = np.array([table[tree, int(i)][f] for i in ids])
                        code, bins = (x[f] > edge[local]).astype(np.int64), 2
                    else:
                        code, bins = np.searchsorted(table[f], x[f], "left"), len(table[f]) + 1
                    key = local * bins + code
                    n = np.bincount(key, w, len(ids) * bins)
                    s = np.bincount(key, w * y, len(ids) * bins)
                    some = np.flatnonzero(n)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(some), tree), pa.int32()), pa.array(ids[some // bins], pa.int32()),
                         pa.array(np.full(len(some), f), pa.int32()), pa.array(some % bins, pa.int32()), pa.array(n[some]), pa.array(s[some])],
                        ["tree", "node", "feature", "bin", "n", "s"])
    return run


def best_splits(sums: DataFrame, min_leaf: int) -> DataFrame:
    """(tree, node, n, s, best struct(score, feature, bin, nl)) from (tree, node, feature, bin, n, s)."""
    whole = Window.partitionBy("tree", "node", "feature")
    upto = whole.orderBy("bin")
    run = sums.select("tree", "node", "feature", "bin", F.sum("n").over(upto).alias("nl"), F.sum("s").over(upto).alias("sl"),
                      F.sum("n").over(whole).alias("n"), F.sum("s").over(whole).alias("s"))
    nr, sr = F.col("n") - F.col("nl"), F.col("s") - F.col("sl")
    can = (F.col("nl") >= min_leaf) & (nr >= min_leaf)
    score = F.when(can, F.col("sl") ** 2 / F.col("nl") + sr ** 2 / F.when(can, nr))
    return (run.withColumn("best", F.when(can, F.struct(score.alias("score"), (-F.col("feature")).alias("nf"),
                                                        (-F.col("bin")).alias("nb"), F.col("nl").alias("nl"))))
            .groupBy("tree", "node").agg(F.first("n").alias("n"), F.first("s").alias("s"), F.max("best").alias("best")))


def _send_rows(tops, bootstrap, seed):
    def run(batches):
        for batch in batches:
            for tree, ids, first, x, y, w in _routed(tops.value, bootstrap, seed)(batch):
                ends = np.append(first[1:], len(y))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(ids), tree), pa.int32()), pa.array(ids, pa.int32()), pa.array(ends - first, pa.int32()),
                     *(pa.array([np.ascontiguousarray(v[..., a:b]).tobytes() for a, b in zip(first, ends)], pa.binary())
                       for v in (x, y, w))], ["tree", "node", "n", "x", "y", "w"])
    return run


def _grow_parts(random: bool, seed: int, min_leaf: int, depth_left: dict):
    """Rows of one node after another (sorted) -> its subtree."""
    def solve(tree, node, held):
        x, y, w = (np.concatenate(c, axis=-1) for c in zip(*held))
        by = np.lexsort((w, y, *x[::-1]))  # one order, however the chunks came in
        depth = depth_left.get((tree, node))
        return _part_batch([_part(tree, node, G.grow(random, x[:, by], y[by], w[by], [seed, tree, node + 1], min_leaf, depth))])

    def run(batches):
        key, held = None, []
        for batch in batches:
            for i in range(len(batch)):
                now = (batch.column("tree")[i].as_py(), batch.column("node")[i].as_py())
                if now != key:
                    if held:
                        yield solve(*key, held)
                    key, held = now, []
                n = batch.column("n")[i].as_py()
                held.append(tuple(np.frombuffer(batch.column(c)[i].as_buffer(), float).reshape(s)
                                  for c, s in (("x", (-1, n)), ("y", n), ("w", n))))
        if held:
            yield solve(*key, held)
    return run


# ---- the stages ----------------------------------------------------------------------------------

class _ForestParams(HasFeaturesCol, HasLabelCol, HasPredictionCol):
    numTrees = Param(Params._dummy(), "numTrees", "trees", TypeConverters.toInt)
    randomThresholds = Param(Params._dummy(), "randomThresholds", "one random threshold per node and feature", TypeConverters.toBoolean)
    bootstrap = Param(Params._dummy(), "bootstrap", "Poisson bootstrap of the rows of each tree", TypeConverters.toBoolean)
    minLeaf = Param(Params._dummy(), "minLeaf", "least rows (by weight) of a leaf", TypeConverters.toInt)
    maxDepth = Param(Params._dummy(), "maxDepth", "most levels; -1: no limit", TypeConverters.toInt)
    localRows = Param(Params._dummy(), "localRows", "rows that one task may grow a tree or a node from", TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "seed of all draws", TypeConverters.toInt)


class UnlimitedForest(Estimator, _ForestParams):
    """Regression forest without a depth limit. ``randomThresholds`` without ``bootstrap``: extremely randomised trees."""

    @keyword_only
    def __init__(self, featuresCol="features", labelCol="label", predictionCol="prediction", numTrees=300, randomThresholds=True,
                 bootstrap=False, minLeaf=1, maxDepth=-1, localRows=LOCAL_ROWS, seed=42):
        super().__init__()
        self._setDefault(featuresCol="features", labelCol="label", predictionCol="prediction", numTrees=300, randomThresholds=True,
                         bootstrap=False, minLeaf=1, maxDepth=-1, localRows=LOCAL_ROWS, seed=42)
        self._set(**self._input_kwargs)

    def setFeaturesCol(self, v):
        return self._set(featuresCol=v)

    def setLabelCol(self, v):
        return self._set(labelCol=v)

    def setPredictionCol(self, v):
        return self._set(predictionCol=v)

    def _fit(self, df: DataFrame) -> "UnlimitedForestModel":
        get = self.getOrDefault
        data = written(blocks(df, self.getFeaturesCol(), self.getLabelCol()), "forest-rows", **BLOCK_TABLE)
        facts = data.agg(F.sum("n").alias("n"), F.sum(F.length("x")).alias("bytes")).first()
        n, width = facts["n"] or 0, (facts["bytes"] or 0) // 8 // max(facts["n"] or 1, 1)
        path = table_path(df.sparkSession, "forest")
        if not n:
            raise ValueError("no rows to fit")
        if n <= get(self.localRows) and n * (4 * width + 8) <= LOCAL_BYTES:
            self._fit_small(data, width, path)
        else:
            self._fit_large(data, n, width, path)
        model = UnlimitedForestModel(path)
        return model._set(featuresCol=self.getFeaturesCol(), predictionCol=self.getPredictionCol())

    def _growing(self):
        get = self.getOrDefault
        depth = get(self.maxDepth)
        return get(self.randomThresholds), get(self.bootstrap), get(self.seed), get(self.minLeaf), depth if depth >= 0 else None

    def _fit_small(self, data: DataFrame, width: int, path: str) -> None:
        spark, trees = data.sparkSession, self.getOrDefault(self.numTrees)

        def column(f: int):  # one at a time; at most localRows numbers
            t = data.transform(arrow, _column(f), "block long, n int, v binary").orderBy("block").toArrow()
            return np.concatenate([np.frombuffer(v.as_buffer(), float) for v in t.column("v")]), t
        y, t = column(-1)
        shards = list(zip(t.column("block").to_pylist(), t.column("n").to_pylist()))
        whole = spark.sparkContext.broadcast((G.Coded.of(column(f)[0] for f in range(width)), y, shards))
        tasks = min(trees, TASKS_PER_CORE * spark.sparkContext.defaultParallelism)
        (spark.range(0, trees, 1, tasks).transform(arrow, _grow_whole(whole, *self._growing()), PARTS)
         .write.options(**BLOCK_TABLE).parquet(path))

    def _fit_large(self, data: DataFrame, n: int, width: int, path: str) -> None:
        get, local = self.getOrDefault, self.getOrDefault(self.localRows)
        local = min(local, NODE_ROWS)
        per = max(1, min(get(self.numTrees), MOST_OPEN * local // (2 * n)))
        cuts = None if get(self.randomThresholds) else self._cuts(data)
        for a in range(0, get(self.numTrees), per):
            self._fit_group(data, list(range(a, min(a + per, get(self.numTrees)))), width, path, cuts)

    def _cuts(self, data: DataFrame) -> list[np.ndarray]:
        """Quantiles of each feature (the bins of the upper levels), from one aggregation over sorted samples of blocks."""
        def points(batches):
            for batch in batches:
                for i in range(len(batch)):
                    _, x, _ = _open_block(batch, i)
                    q = np.quantile(x, np.linspace(0, 1, 4 * BINS + 1), axis=1, method="inverted_cdf").T
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(x)), q.shape[1]), pa.int32()), pa.array(q.ravel())],
                                                     ["feature", "v"])
        q = (data.transform(arrow, points, "feature int, v double").groupBy("feature")
             .agg(F.percentile_approx("v", [i / BINS for i in range(1, BINS)], 10_000).alias("q")).orderBy("feature").collect())
        return [np.unique(r["q"]) for r in q]

    def _fit_group(self, data: DataFrame, trees: list[int], width: int, path: str, cuts) -> None:
        spark = data.sparkSession
        random, bootstrap, seed, min_leaf, limit = self._growing()
        local, grown = min(self.getOrDefault(self.localRows), NODE_ROWS), {t: G.Builder(width) for t in trees}
        open_, done, depth = {t: [0] for t in trees}, {t: [] for t in trees}, {}
        level = 0
        while any(open_.values()) and (limit is None or level < limit):
            tops = spark.sparkContext.broadcast({t: (grown[t].tree(), np.array(v)) for t, v in open_.items() if v})
            if random:
                ranges = (data.transform(arrow, _send_ranges(tops, bootstrap, seed), "tree int, node int, feature int, low double, high double")
                          .groupBy("tree", "node", "feature").agg(F.min("low").alias("low"), F.max("high").alias("high")))
                table: dict = {}
                for r in ranges.collect():  # open nodes x features
                    u = np.random.default_rng([seed, r["tree"], r["node"], r["feature"]]).random()
                    cut = r["low"] + u * (r["high"] - r["low"])
                    table.setdefault((r["tree"], r["node"]), np.zeros(width))[r["feature"]] = cut if cut < r["high"] else r["low"]
            else:
                table = cuts
            known = spark.sparkContext.broadcast(table)
            sums = (data.transform(arrow, _send_bins(tops, known, bootstrap, seed), "tree int, node int, feature int, bin int, n double, s double")
                    .groupBy("tree", "node", "feature", "bin").agg(F.sum("n").alias("n"), F.sum("s").alias("s")))
            found = best_splits(sums, min_leaf).collect()  # a row per open node
            open_ = {t: [] for t in trees}
            for r in sorted(found, key=lambda r: (r["tree"], r["node"])):
                b, best, node = grown[r["tree"]], r["best"], np.array([r["node"]])
                b.set_value(node, np.array([r["s"] / r["n"]]))
                gain = best["score"] - r["s"] ** 2 / r["n"] if best else 0.0
                if r["n"] <= local:  # only a root can be: the others are sorted out below
                    done[r["tree"]].append(r["node"])
                elif best and gain > 1e-12 * abs(r["s"] ** 2 / r["n"]):
                    f, bin_ = -best["nf"], -best["nb"]
                    cut = table[r["tree"], r["node"]][f] if random else table[f][bin_]
                    first = int(b.split(node, np.array([f]), np.array([cut]), np.array([gain]))[0])
                    for child, rows in ((first, best["nl"]), (first + 1, r["n"] - best["nl"])):
                        depth[r["tree"], child] = level + 1
                        (done if rows <= local else open_)[r["tree"]].append(child)
            tops.unpersist()
            known.unpersist()
            level += 1
        tops = spark.sparkContext.broadcast({t: (grown[t].tree(), np.array(v)) for t, v in done.items() if v})
        left = {} if limit is None else {(t, c): limit - depth.get((t, c), 0) for t, v in done.items() for c in v}
        rows = data.transform(arrow, _send_rows(tops, bootstrap, seed), "tree int, node int, n int, x binary, y binary, w binary")
        (rows.repartition("tree", "node").sortWithinPartitions("tree", "node")
         .transform(arrow, _grow_parts(random, seed, min_leaf, left), PARTS).write.options(**BLOCK_TABLE).mode("append").parquet(path))
        upper = [_part(t, TOP, b.tree()) for t, b in grown.items()]
        spark.createDataFrame(pa.Table.from_batches([_part_batch(upper)])).select(
            *(F.col(c.split()[0]).cast(c.split()[1]) for c in PARTS.split(", "))).write.mode("append").parquet(path)


def _whole_tree(parts: list) -> G.Tree:
    own = {r["node"]: _read_part(r) for r in parts}
    if TOP not in own:
        return own[0]
    return G.join_trees(own.pop(TOP), own)


SCORED = "grp int, block long, rid binary, total binary"


def _score(batches):
    """Per group of trees: first its parts (kind 0), then blocks of rows (kind 1), sorted so; sums per block."""
    key, parts, trees = None, {}, None
    for batch in batches:
        for i in range(len(batch)):
            row = {c: batch.column(c)[i] for c in batch.schema.names}
            now = (row["grp"].as_py(), row["salt"].as_py())
            if now != key:
                key, parts, trees = now, {}, None
            if row["kind"].as_py() == 0:
                parts.setdefault(row["tree"].as_py(), []).append(
                    {c: row[c].as_py() for c in ("node", "feature", "threshold", "left", "value", "gain")})
                continue
            if trees is None:
                trees = [_whole_tree(p) for p in parts.values()]
                parts = {}
            _, x, _ = _open_block(batch, i)
            total = np.zeros(x.shape[1])
            for t in trees:
                total += G.predict(t, x)
            yield pa.RecordBatch.from_arrays([batch.column("grp").slice(i, 1), batch.column("block").slice(i, 1), batch.column("rid").slice(i, 1),
                                              pa.array([total.tobytes()], pa.binary())], ["grp", "block", "rid", "total"])


def _score_few(rows):
    """One group of trees (their parts sorted by tree) over broadcast blocks of rows; sums per block."""
    def run(batches):
        held = rows.value
        grp, tree, parts, totals = None, None, [], None

        def add():
            t = _whole_tree(parts)
            parts.clear()  # a tree of millions of nodes is held once while rows walk it
            for total, (_, x, _) in zip(totals, held):
                total += G.predict(t, x)
        for batch in batches:
            for i in range(len(batch)):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                if row["tree"] != tree:
                    if parts:
                        add()
                    else:
                        grp, totals = row["grp"], [np.zeros(x.shape[1]) for _, x, _ in held]
                    tree, parts = row["tree"], []
                parts.append(row)
        if parts:
            add()
            for (block, _, rid), total in zip(held, totals):
                yield pa.RecordBatch.from_arrays([pa.array([grp], pa.int32()), pa.array([block], pa.int64()), pa.array([rid], pa.binary()),
                                                  pa.array([total.tobytes()], pa.binary())], ["grp", "block", "rid", "total"])
    return run


def _add_up(trees: int):
    """Partial sums of one block after another (sorted) -> (rid, prediction)."""
    def run(batches):
        key, rid, total = None, None, None

        def out():
            return pa.RecordBatch.from_arrays([pa.array(rid), pa.array(total / trees)], ["rid", "prediction"])
        for batch in batches:
            for i in range(len(batch)):
                block = batch.column("block")[i].as_py()
                part = np.frombuffer(batch.column("total")[i].as_buffer(), float)
                if block != key:
                    if key is not None:
                        yield out()
                    key, rid, total = block, np.frombuffer(batch.column("rid")[i].as_buffer(), np.int64), np.zeros(len(part))
                total = total + part
        if key is not None:
            yield out()
    return run


def _dealt_trees(rows: DataFrame, model: DataFrame, size) -> DataFrame:
    """Sums of groups of trees over few rows: the rows are broadcast, each tree is moved once."""
    spark = rows.sparkSession
    t = rows.orderBy("block").toArrow()  # 3 LOCAL_BYTES at most
    held = spark.sparkContext.broadcast([(*_open_block(b, i)[:2], b.column("rid")[i].as_py()) for b in t.to_batches() for i in range(len(b))])
    groups = min(size["trees"], TASKS_PER_CORE * spark.sparkContext.defaultParallelism)
    return (model.withColumn("grp", F.pmod("tree", F.lit(groups))).repartitionById(groups, F.col("grp")).sortWithinPartitions("tree", "node")
            .transform(arrow, _score_few(held), SCORED))


def _dealt_rows(rows: DataFrame, model: DataFrame, size) -> DataFrame:
    """Sums of groups of trees over blocks of rows: both are shuffled, every block to every group."""
    groups = max(1, min(size["trees"], -(-size["bytes"] * 3 // GROUP_BYTES)))
    salts = max(1, -(-rows.sparkSession.sparkContext.defaultParallelism // groups))
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    none = lambda c, t: F.lit(None).cast(t).alias(c)
    left = model.withColumn("salt", every(salts)).select(
        F.pmod("tree", F.lit(groups)).alias("grp"), "salt", F.lit(0).alias("kind"), "tree", "node", "feature", "threshold", "left",
        "value", "gain", none("block", "long"), none("n", "int"), none("x", "binary"), none("y", "binary"), none("rid", "binary"))
    right = rows.withColumn("grp", every(groups)).select(
        "grp", F.pmod(F.xxhash64("block"), F.lit(salts)).cast("int").alias("salt"), F.lit(1).alias("kind"), none("tree", "int"),
        none("node", "int"), none("feature", "binary"), none("threshold", "binary"), none("left", "binary"), none("value", "binary"),
        none("gain", "array<double>"), "block", "n", "x", "y", "rid")
    both = left.unionByName(right).repartition(groups * salts, "grp", "salt").sortWithinPartitions("grp", "salt", "kind")
    return both.transform(arrow, _score, SCORED)


class _Writer(MLWriter):
    def __init__(self, model):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        spark = self.sparkSession
        DefaultParamsWriter.saveMetadata(self.model, path, spark)
        spark.read.parquet(self.model.trees).write.mode("overwrite").parquet(f"{path}/trees")


class _Reader(MLReader):
    def load(self, path: str) -> "UnlimitedForestModel":
        meta = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = UnlimitedForestModel(f"{path}/trees")
        DefaultParamsReader.getAndSetParams(model, meta)
        model._resetUid(meta["uid"])
        return model


class UnlimitedForestModel(Model, HasFeaturesCol, HasPredictionCol, MLWritable, MLReadable):
    """A forest kept as a table; predictions are means over its trees."""

    def __init__(self, trees: str):
        super().__init__()
        self.trees = trees

    def write(self):
        return _Writer(self)

    @classmethod
    def read(cls):
        return _Reader()

    def copy(self, extra=None):
        that = super().copy(extra)
        that.trees = self.trees
        return that

    def table(self) -> DataFrame:
        return SparkSession.active().read.parquet(self.trees)

    @functools.cached_property
    def featureImportances(self):
        """Mean over trees of each tree's shares of squared-error reduction."""
        from pyspark.ml.linalg import Vectors
        per = self.table().select("tree", F.posexplode("gain").alias("i", "g")).groupBy("tree", "i").agg(F.sum("g").alias("g"))
        total = F.sum("g").over(Window.partitionBy("tree"))
        rows = (per.withColumn("share", F.when(total > 0, F.col("g") / total).otherwise(0.0)).groupBy("i").agg(F.avg("share").alias("v"))
                .orderBy("i").collect())
        whole = sum(r["v"] for r in rows) or 1.0
        return Vectors.dense([r["v"] / whole for r in rows])

    def _transform(self, df: DataFrame) -> DataFrame:
        out = self.getPredictionCol()
        base = written(df.withColumn("__rid", F.monotonically_increasing_id()), "scored-rows")  # ids must not change
        rows = blocks(base, self.getFeaturesCol(), rid="__rid")
        model = self.table()
        size = model.agg(F.countDistinct("tree").alias("trees"), F.sum(F.length("threshold")).alias("bytes"), F.max(F.size("gain")).alias("width")).first()
        few = base.count() * (size["width"] + 2) * 8 <= 3 * LOCAL_BYTES
        sums = (_dealt_trees if few else _dealt_rows)(rows, model, size).repartition("block").sortWithinPartitions("block", "grp")
        scored = sums.transform(arrow, _add_up(size["trees"]), "rid long, prediction double")
        return (base.join(scored.select(F.col("rid").alias("__rid"), F.col("prediction").alias(out)), "__rid")
                .select(*[f"`{c}`" for c in df.columns], f"`{out}`"))
