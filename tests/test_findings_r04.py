"""Tests of the findings of round 4."""

from __future__ import annotations

import threading
import time
from types import SimpleNamespace

import numpy as np
import pytest


@pytest.mark.parametrize("module", ["tabreg.cluster", "tabreg.llm.shared"])
def test_the_package_is_shipped_once_however_many_fits_begin_together(module):
    import importlib
    ship, paths = importlib.import_module(module).ship, []

    def add(path):
        time.sleep(0.05)
        paths.append(path)
    spark = SimpleNamespace(sparkContext=SimpleNamespace(applicationId=f"test-{module}", addPyFile=add))
    threads = [threading.Thread(target=ship, args=(spark,)) for _ in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(paths) == 1  # a second file of that name is an error on a cluster


def test_features_counted_together_give_each_its_own_histogram():
    from tabreg.operators import boosting as B
    rng = np.random.default_rng(3)
    widths, n, nodes = [256, 50, 11, 9, 1, 2, 2], 4000, 3
    codes = np.stack([rng.integers(0, w, n) for w in widths]).astype(np.uint8)
    g, h, local = rng.normal(size=n), rng.integers(0, 4, n).astype(float), rng.integers(0, nodes, n)
    for features in (range(7), [1, 3, 5]):
        for weights in (None, h):
            for place in (None, local):
                many = 1 if place is None else nodes
                b = B.Bundles(widths, list(features))
                assert len(b.groups) < len(features) and all(b.cells(k) <= B.CELLS for k in b.groups)
                totals = b.empty(many)
                for rows in (slice(0, 1500), slice(1500, n)):
                    b.add(totals, codes[:, rows], None if place is None else place[rows], g[rows], None if weights is None else weights[rows])
                got = b.by_feature(totals, many)
                assert sorted(got) == list(features)
                for f in features:
                    want = np.zeros((many, widths[f], 2))
                    np.add.at(want, (0 if place is None else place, codes[f]), np.stack([g, np.ones(n) if weights is None else weights], 1))
                    assert np.allclose(got[f], want)


def test_small_trees_are_walked_alike_without_look_ups():
    from tabreg.operators import treegrow as G
    rng = np.random.default_rng(4)
    x = rng.random((4, 3000))
    x[0, :50] = np.nan
    for same in (True, False):  # whole levels that ask the same, and any shape
        b, nodes = G.Builder(4), np.array([0])
        for _ in range(6):
            kept = nodes if same else nodes[rng.random(len(nodes)) < 0.8]
            f, cut = (rng.integers(0, 4), rng.random()) if same else (rng.integers(0, 4, len(kept)), rng.random(len(kept)))
            first = b.split(kept, np.full(len(kept), f), np.full(len(kept), cut), np.ones(len(kept)))
            nodes = np.stack([first, first + 1], 1).ravel()
        t = b.tree()
        want = G.walk(t, x, np.zeros(3000, np.int64))  # from given nodes: by look-ups
        assert np.array_equal(G.walk(t, x), want) and len(np.unique(want)) > 5


def test_only_smaller_children_are_summed_and_a_resample_is_drawn_once(spark, monkeypatch):
    from pyspark.ml.functions import array_to_vector
    from pyspark.sql import functions as F

    from tabreg.operators import boosting as B
    rows = spark.range(0, 3000, 1, 3).select(array_to_vector(F.array(F.rand(1), F.rand(2), F.round(F.rand(3), 1))).alias("features"), F.rand(4).alias("label"))
    df = rows.persist()
    asked, real = [], B._Partial

    def partial(tree, nodes, bundles, grad):
        asked.append((len(nodes), grad))
        return real(tree, nodes, bundles, grad)
    monkeypatch.setattr(B, "_Partial", partial)
    for est in (dict(grow="depth"), dict(grow="oblivious"), None):
        make = lambda local: (B.AdaBoostR2(rounds=2, rate=0.5, depth=3, maxBins=64, localRows=local, seed=2) if est is None
                              else B.BoostedTrees(rounds=2, depth=3, maxBins=64, localRows=local, seed=2, **est))
        del asked[:]
        a, b = make(10).fit(df), make(10_000).fit(df)
        assert [n for n, _ in asked] == [1, 1, 2] * 2
        assert all((g is None) == (est is None) for _, g in asked)
        assert a.getOrDefault("feature") == b.getOrDefault("feature") and np.allclose(a.getOrDefault("value"), b.getOrDefault("value"))
    df.unpersist()


def test_svr_rows_are_drawn_by_all_tasks_and_held_in_small_partitions(spark, monkeypatch):
    from pyspark.sql import functions as F

    from tabreg.operators import svr as S
    from tabreg.operators.forest import BLOCKS
    rows = [(b, 40, np.full((2, 40), float(b)).tobytes(), np.arange(40.0).tobytes(), None) for b in range(60)]
    data = spark.createDataFrame(rows, BLOCKS)
    cores = spark.sparkContext.defaultParallelism
    assert S.dealt_out(data, 2400, 2).rdd.getNumPartitions() == 2 * cores
    monkeypatch.setattr(S, "PART_BYTES", 2400 * 3 * 8 // 30)
    held = S.dealt_out(data, 2400, 2)
    assert held.columns == ["block", "n", "x", "y"] and held.rdd.getNumPartitions() == 30  # not two a core, whatever the rows
    held = held.persist()
    drawn = S.gathered(held, 0.5, 3)
    assert drawn.rdd.getNumPartitions() == 1 and 0.4 < drawn.agg(F.sum("n")).first()[0] / 2400 < 0.6
    real = S._drawn
    seen = spark.sparkContext.accumulator(0)

    def counted(share, seed):
        def run(batches):
            seen.add(1)
            yield from real(share, seed)(batches)
        return run
    monkeypatch.setattr(S, "_drawn", counted)
    assert S.gathered(held, 0.5, 3).agg(F.sum("n")).first()[0] == drawn.agg(F.sum("n")).first()[0]
    assert seen.value >= 30  # one task a partition, not one for all
    held.unpersist()


def test_tables_of_blocks_have_small_row_groups(spark):
    import pyarrow.parquet as pq

    from tabreg.cluster import BLOCK_TABLE, written
    noise = [(i, np.random.default_rng(i).bytes(1 << 20)) for i in range(40)]
    df = written(spark.createDataFrame(noise, "i int, b binary").coalesce(1), "test-blocks", **BLOCK_TABLE)
    meta = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in df.inputFiles()]
    assert max(m.row_group(i).total_byte_size for m in meta for i in range(m.num_row_groups)) <= 16 << 20
    assert {r["i"]: bytes(r["b"]) for r in df.collect()} == dict(noise)


def plain_forest_tree(x, y, w, seed, random, depth):
    """Level by level and node by node, for the same draws."""
    from tabreg.operators import treegrow as G
    rng, out, level = np.random.default_rng(seed), G.Builder(len(x)), [(0, np.flatnonzero(w > 0))]
    while level:
        u = rng.random((len(x), len(level))) if random else None
        nodes = []
        for i, (node, rows) in enumerate(level):
            n, s, best = w[rows].sum(), (w * y)[rows].sum(), None
            out.set_value(np.array([node]), s / n)
            for f in range(len(x)):
                v = x[f, rows]
                low, high = v.min(), v.max()
                cuts = [low + u[f, i] * (high - low)] if random and low < high else [] if random else (np.unique(v)[1:] + np.unique(v)[:-1]) / 2
                for c in cuts:
                    go = v <= c
                    nl, sl = w[rows][go].sum(), (w * y)[rows][go].sum()
                    score = sl ** 2 / nl + (s - sl) ** 2 / (n - nl)
                    if best is None or score > best[0] + 1e-9 * abs(score):
                        best = score, f, c, go
            if depth and best is not None and np.ptp(y[rows]) > 0 and (random or best[0] > s ** 2 / n * (1 + 1e-12)):
                nodes.append((node, rows, best))
        level, depth = [], depth - 1
        for node, rows, (score, f, c, go) in nodes:
            first = int(out.split(np.array([node]), np.array([f]), np.array([c]), np.array([0.0]))[0])
            level += [(first, rows[go]), (first + 1, rows[~go])]
    return out.tree()


@pytest.mark.parametrize("random", [True, False])
def test_growers_give_the_plain_tree(random):
    from tabreg.operators import treegrow as G
    rng = np.random.default_rng(7)
    x = np.stack([rng.random(150), rng.integers(0, 4, 150).astype(float), rng.normal(size=150)])
    y = 10 * x[0] + x[1] * x[2] + rng.normal(size=150)
    for w in (np.ones(150), rng.poisson(1.0, 150).astype(float)):
        t = (G.grow_random if random else G.grow_best)(x, y, w, [3, 1], max_depth=3)
        p = plain_forest_tree(x, y, w, [3, 1], random, 3)
        assert np.array_equal(t.feature, p.feature) and np.array_equal(t.left, p.left)
        assert np.allclose(t.threshold, p.threshold) and np.allclose(t.value, p.value)


def test_deep_trees_are_the_same_forest_rules_in_pieces(monkeypatch):
    from tabreg.operators import treegrow as G
    rng = np.random.default_rng(9)
    n = 900
    x = np.stack([rng.random(n), rng.integers(0, 9, n).astype(float), np.round(rng.normal(size=n), 2), np.zeros(n)])
    y = 10 * x[0] + x[1] * x[2] + rng.normal(size=n)
    coded = G.Coded.of(x)
    assert [c.dtype for c in coded.codes] == [np.uint16, np.uint8, np.uint16, np.uint8] and np.array_equal(coded.rows(), x)
    w = rng.poisson(1.0, n).astype(float)
    for depth, leaf in ((None, 1), (4, 1), (None, 6)):
        plain = G.grow(False, x, y, w, [1, 2], leaf, depth)
        monkeypatch.setattr(G, "DEEP_ROWS", 100)
        monkeypatch.setattr(G, "PIECE_ROWS", 60)
        top, pieces = G.grow_pieces(False, coded, y, w, [1, 2], leaf, depth)
        deep, random = G.grow(False, x, y, w, [1, 2], leaf, depth), G.grow(True, x, y, w, [1, 2], leaf, depth)
        monkeypatch.undo()
        assert len(pieces) > 5 and top.size == 2 * len(pieces) - 1
        used = w > 0  # the same splits but for ties in nodes of a few rows: the same values where rows were fitted
        close = np.isclose(G.predict(deep, x)[used], G.predict(plain, x)[used])
        assert close.all() if depth else close.mean() > 0.99
        assert deep.gain.sum() == pytest.approx(plain.gain.sum(), rel=1e-3)
        at = G.walk(random, x)[used]
        count, total = np.bincount(at, w[used]), np.bincount(at, (w * y)[used])
        some = count > 0
        assert np.allclose(random.value[:len(count)][some], total[some] / count[some]) and count[some].min() >= leaf
        if depth is None and leaf == 1:
            assert np.allclose(G.predict(random, x)[used], y[used])
    a, b, c = (G._one_split(np.array([2, 0, 5, 2, 0]), np.arange(60.0) ** 2, np.array([1.0, 5, 2, 1, 6]), np.ones(5), 5.0, 15.0, 1, d) for d in (None, 0.0, 0.99))
    assert a[1:] == (2.0, 0) and b[1:] == (0.0, 0) and c[1:] == (24.75, 4)


def test_a_table_of_pieces_is_the_forest(spark, monkeypatch):
    from pyspark.ml.linalg import Vectors

    from tabreg.operators import forest as T
    from tabreg.operators import treegrow as G
    # 2.9 million rows of nine features, the train rows of a table of 0.1 GB, are grown by tasks without a shuffle of rows
    assert T.LOCAL_ROWS >= 2_900_000 and T.LOCAL_BYTES >= 2_900_000 * (4 * 9 + 8)
    rng = np.random.default_rng(4)
    x = rng.random((700, 3))
    df = spark.createDataFrame([(i, Vectors.dense(r), float(r[0] + 3 * (r[1] > 0.4))) for i, r in enumerate(x)], ["id", "features", "label"]).repartition(3, "id")
    data = T.written(T.blocks(df, "features", "label"), "test-forest")
    t = data.orderBy("block").toArrow()
    held = [T._open_block(b, i) for b in t.to_batches() for i in range(len(b))]
    whole = np.concatenate([h[1] for h in held], 1), np.concatenate([h[2] for h in held]), [(h[0], len(h[2])) for h in held]
    monkeypatch.setattr(G, "DEEP_ROWS", 100)
    monkeypatch.setattr(G, "PIECE_ROWS", 50)
    ship = type("B", (), {"value": (G.Coded.of(whole[0]), *whole[1:])})
    import pyarrow as pa
    trees = pa.RecordBatch.from_arrays([pa.array([0, 1, 2])], ["id"])
    got = pa.Table.from_batches(list(T._grow_whole(ship, True, False, 5, 1, None)(iter([trees])))).to_pylist()
    assert len(got) > 30 and {r["node"] for r in got} > {T.TOP}
    for tree in range(3):
        joined = T._whole_tree([r for r in got if r["tree"] == tree])
        assert np.allclose(G.predict(joined, whole[0]), whole[1])
