"""Tree learners and moment regressions against plain versions on small tables, and across their two ways to run."""
import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tabreg.operators import boosting as B
from tabreg.operators import linear as L
from tabreg.operators import models as M
from tabreg.operators import treegrow as G
from tabreg.operators.evaluate import learning_curve, regression_metrics
from tabreg.operators.forest import UnlimitedForest, UnlimitedForestModel, best_splits
from tabreg.operators.prep import DropFirstOneHot, preparation_pipeline


def table(n=400, seed=0):
    rng = np.random.default_rng(seed)
    x = np.round(rng.random((n, 3)), 2)
    y = np.where(x[:, 0] > 0.5, 10 * x[:, 1], 5.0) + x[:, 2] ** 2 + rng.normal(0, 0.1, n)
    return x, y


def frame(spark, x, y):
    return spark.createDataFrame([(i, Vectors.dense(r), float(v)) for i, (r, v) in enumerate(zip(x, y))], ["id", "features", "label"])


# ---- plain trees ---------------------------------------------------------------------------------

def plain_tree(x, y, w):
    """Exact best splits, node by node; prediction of each row."""
    out = np.zeros(len(y))

    def rec(rows):
        n, s = w[rows].sum(), (w * y)[rows].sum()
        best = None
        if y[rows].min() < y[rows].max():
            for f in range(x.shape[1]):
                for c in np.unique(x[rows, f])[:-1]:
                    left = rows[x[rows, f] <= c]
                    right = rows[x[rows, f] > c]
                    score = (w * y)[left].sum() ** 2 / w[left].sum() + (w * y)[right].sum() ** 2 / w[right].sum()
                    if best is None or score > best[0] + 1e-9:
                        best = score, left, right
        if best is None:
            out[rows] = s / n
        else:
            rec(best[1])
            rec(best[2])
    rec(np.flatnonzero(w > 0))
    return out


def test_best_tree_is_the_plain_tree():
    x, y = table(80)
    w = np.random.default_rng(1).poisson(1, 80).astype(float)
    t = G.grow_best(x.T, y, w)
    assert np.allclose(G.predict(t, x.T)[w > 0], plain_tree(x, y, w)[w > 0])


def test_random_tree_splits_inside_the_nodes_ranges_down_to_pure_leaves():
    x, y = table(300)
    t = G.grow_random(x.T, y, np.ones(300), 5)
    leaf = G.walk(t, x.T)
    for v in np.unique(leaf):
        rows = leaf == v
        assert np.ptp(y[rows]) == 0 or np.ptp(x[rows], axis=0).max() == 0
        assert t.value[v] == pytest.approx(y[rows].mean())
    for node in range(t.size):  # each threshold lies in its node's range
        if t.feature[node] >= 0:
            f, c = t.feature[node], t.threshold[node]
            at = np.ones(300, bool)
            path, here = [], node
            while here:
                parent = next(p for p in range(here) if t.feature[p] >= 0 and here in (t.left[p], t.left[p] + 1))
                path.append((parent, here == t.left[parent]))
                here = parent
            for p, left in path:
                at &= (x[:, t.feature[p]] <= t.threshold[p]) == left
            assert x[at, f].min() <= c < x[at, f].max()


def test_one_random_split_is_the_best_of_its_thresholds():
    x, y = table(200)
    t = G.grow_random(x.T, y, np.ones(200), 9, max_depth=1)
    u = np.random.default_rng(9).random((3, 1))[:, 0]
    cuts = x.min(0) + u * np.ptp(x, axis=0)
    sse = [sum(((y[m] - y[m].mean()) ** 2).sum() for m in (x[:, f] <= c, x[:, f] > c)) for f, c in enumerate(cuts)]
    assert t.feature[0] == int(np.argmin(sse)) and t.threshold[0] == pytest.approx(cuts[t.feature[0]])


@pytest.mark.parametrize("how", [dict(randomThresholds=True, bootstrap=False), dict(randomThresholds=False, bootstrap=True)])
def test_forest_small_and_large_ways(spark, how, scratch):
    x, y = table(900)
    df = frame(spark, x, y).repartition(3, "id").persist()
    fits = {}
    for local in (100_000, 60):  # in one piece; upper levels by aggregations over the table
        model = UnlimitedForest(numTrees=8, localRows=local, seed=3, **how).fit(df)
        out = model.transform(df)
        assert out.columns == ["id", "features", "label", "prediction"] and out.count() == 900
        fits[local] = regression_metrics(out).first()
        trees = model.table().groupBy("tree").count().collect()
        assert len(trees) == 8 and (local > 900 or all(r["count"] > 2 for r in trees))
        assert sum(model.featureImportances) == pytest.approx(1.0)
        if not how["bootstrap"]:  # grown to the end, all rows in each tree: training rows come back
            assert fits[local]["mae"] < 0.05
    assert fits[60]["r2"] > 0.95 and abs(fits[60]["r2"] - fits[100_000]["r2"]) < 0.03
    model.write().overwrite().save(f"{scratch}/forest")
    back = UnlimitedForestModel.load(f"{scratch}/forest")
    p, q = (m.transform(df).select("id", "prediction").orderBy("id").collect() for m in (model, back))
    assert p == q


def test_forest_predicts_the_mean_of_its_trees(spark):
    x, y = table(300)
    df = frame(spark, x, y)
    model = UnlimitedForest(numTrees=5, randomThresholds=True, seed=3).fit(df)
    rows = model.table().collect()
    from tabreg.operators.forest import _read_part
    want = np.mean([G.predict(_read_part(r), x.T) for r in rows], axis=0)
    got = [r.prediction for r in model.transform(df).orderBy("id").collect()]
    assert np.allclose(got, want)


def test_forest_depth_limit_and_min_leaf(spark):
    x, y = table(500)
    df = frame(spark, x, y)
    for local in (100_000, 100):
        model = UnlimitedForest(numTrees=3, randomThresholds=False, maxDepth=2, localRows=local).fit(df)
        assert model.transform(df).select("prediction").distinct().count() <= 4 ** 3
    leafy = UnlimitedForest(numTrees=1, randomThresholds=False, minLeaf=50).fit(df).transform(df)
    assert leafy.groupBy("prediction").count().agg(F.min("count")).first()[0] >= 50


def test_best_splits_from_bins(spark):
    sums = spark.createDataFrame([(0, 0, 0, 0, 10.0, 10.0), (0, 0, 0, 1, 10.0, 50.0), (0, 0, 1, 0, 10.0, 30.0), (0, 0, 1, 1, 10.0, 30.0)],
                                 "tree int, node int, feature int, bin int, n double, s double")
    r = best_splits(sums, 1).first()
    assert (-r["best"]["nf"], -r["best"]["nb"], r["n"], r["s"], r["best"]["score"]) == (0, 0, 20.0, 60.0, 10.0 + 250.0)
    assert best_splits(sums, 11).first()["best"] is None


# ---- boosting ------------------------------------------------------------------------------------

def binned(n=300, bins=16, seed=0):
    x, y = table(n, seed)
    cuts = [B.cut_points(*np.unique(x[:, f], return_counts=True), bins) for f in range(3)]
    codes = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)]).astype(np.uint8)
    return codes, y


def settings(**how):
    return {"rounds": 4, "rate": 0.3, "depth": 3, "grow": "depth", "leaves": 6, "l2": 1.0, "least": 1.0, "share": 1.0, "columns": 1.0, "seed": 1} | how


def fit_codes(codes, y, p, bins=16):
    data = B.Local([(0, codes, y, np.full(len(y), y.mean()))], bins)
    trees = B.boost(data, p)
    return trees, data.blocks[0][3]


def gain(g, h, left, l2):
    s = lambda m: g[m].sum() ** 2 / (h[m].sum() + l2) if h[m].sum() + l2 > 0 else 0.0
    return s(left) + s(~left) - s(np.ones(len(g), bool))


def cuts_of(codes, rows, least):
    for f in range(len(codes)):
        for b in range(int(codes[f].max())):
            left = codes[f][rows] <= b
            if left.sum() >= least and (~left).sum() >= least:
                yield f, b, left


def plain_depth(codes, g, p):
    out = np.zeros(len(g))

    def rec(rows, level):
        best = max(((gain(g[rows], np.ones(len(rows)), left, p["l2"]), -f, -b) for f, b, left in cuts_of(codes, rows, p["least"])), default=(0.0,))
        if level == p["depth"] or best[0] <= 1e-9:
            out[rows] = -g[rows].sum() / (len(rows) + p["l2"])
            return
        left = codes[-best[1]][rows] <= -best[2]
        rec(rows[left], level + 1)
        rec(rows[~left], level + 1)
    rec(np.arange(len(g)), 0)
    return out


def plain_leaf(codes, g, p):
    leaves = [np.arange(len(g))]
    while len(leaves) < p["leaves"]:
        best = max((max(((gain(g[rows], np.ones(len(rows)), left, p["l2"]), -f, -b) for f, b, left in cuts_of(codes, rows, p["least"])),
                        default=(0.0, 0, 0)) + (i,) for i, rows in enumerate(leaves)), key=lambda t: t[0])
        if best[0] <= 1e-9:
            break
        rows = leaves.pop(best[3])
        left = codes[-best[1]][rows] <= -best[2]
        leaves += [rows[left], rows[~left]]
    out = np.zeros(len(g))
    for rows in leaves:
        out[rows] = -g[rows].sum() / (len(rows) + p["l2"])
    return out


def plain_oblivious(codes, g, p):
    leaf = np.zeros(len(g), int)
    for _ in range(p["depth"]):
        def whole(f, b):
            return sum(gain(g[leaf == v], np.ones((leaf == v).sum()), codes[f][leaf == v] <= b, p["l2"]) for v in np.unique(leaf))
        f, b = max(((f, b) for f in range(len(codes)) for b in range(int(codes[f].max()))), key=lambda t: (round(whole(*t), 9), -t[0], -t[1]))
        leaf = leaf * 2 + (codes[f] > b)
    out = np.zeros(len(g))
    for v in np.unique(leaf):
        out[leaf == v] = -g[leaf == v].sum() / ((leaf == v).sum() + p["l2"])
    return out


@pytest.mark.parametrize("grow,plain", [("depth", plain_depth), ("leaf", plain_leaf), ("oblivious", plain_oblivious)])
@pytest.mark.parametrize("l2,least", [(1.0, 1.0), (0.0, 7.0)])
def test_boosting_is_the_plain_version(grow, plain, l2, least):
    codes, y = binned()
    p = settings(grow=grow, l2=l2, least=least)
    _, scores = fit_codes(codes, y, p)
    s = np.full(len(y), y.mean())
    for _ in range(p["rounds"]):
        s = s + p["rate"] * plain(codes, s - y, p)
    assert np.allclose(scores, s)


def test_leaf_weight_and_gain_closed_form():
    h = np.array([[[3.0, 2.0], [-5.0, 3.0]]])  # one node, two bins: (g, h)
    gain_, bin_, left, total = B.PerNode(1.0, 1.0)(h)
    assert gain_[0] == pytest.approx(9 / 3 + 25 / 4 - 4 / 6) and bin_[0] == 0 and left[0].tolist() == [3.0, 2.0] and total[0].tolist() == [-2.0, 5.0]
    assert B._leaf(total, 1.0)[0] == pytest.approx(2 / 6)


@pytest.mark.parametrize("est", [dict(grow="depth", rowShare=0.7, columnShare=0.7, depth=3), dict(grow="leaf", maxLeaves=5, l2=0.0, minChild=5.0),
                                 dict(grow="oblivious", l2=3.0, depth=3), None])
def test_boosting_small_and_large_ways_agree(spark, est, scratch, monkeypatch):
    monkeypatch.setattr(B, "WRITE_EVERY", 2)
    x, y = table(400)
    df = frame(spark, x, y).repartition(3, "id").persist()
    make = lambda local: (B.AdaBoostR2(rounds=4, rate=0.5, depth=2, maxBins=32, localRows=local) if est is None
                          else B.BoostedTrees(rounds=3, rate=0.3, maxBins=32, localRows=local, **est))
    a, b = make(1000).fit(df), make(10).fit(df)
    assert a.getOrDefault(a.feature) == b.getOrDefault(b.feature)
    assert np.allclose(a.getOrDefault(a.value), b.getOrDefault(b.value)) and np.allclose(a.getOrDefault(a.threshold), b.getOrDefault(b.threshold))
    a.write().overwrite().save(f"{scratch}/m")
    back = type(a).load(f"{scratch}/m")
    p, q = ([r.prediction for r in m.transform(df).orderBy("id").collect()] for m in (a, back))
    assert p == q
    if est is None:
        weights, trees = np.array(a.getOrDefault(a.weights)), a.trees()
        assert np.allclose(p, B.weighted_median(np.stack([G.predict(t, x.T) for t in trees]), weights))
    else:
        assert np.allclose(p, a.getOrDefault(a.start) + sum(G.predict(t, x.T) for t in a.trees()))
    assert sum(a.featureImportances) == pytest.approx(1.0)


def test_sketch_cuts_split_the_weight_evenly(spark):
    rng = np.random.default_rng(3)
    v, w = rng.exponential(size=20_000), rng.random(20_000)
    df = spark.createDataFrame([([float(a), float(i % 3)], float(b)) for i, (a, b) in enumerate(zip(v, w))], "x array<double>, w double").repartition(5)
    first, second = B.sketch_cuts(df, 16, size=512)
    shares = np.diff(np.concatenate([[0], [w[v <= c].sum() for c in first], [w.sum()]])) / w.sum()
    assert len(first) == 15 and np.abs(shares - 1 / 16).max() < 0.01
    assert second.tolist() == [0.5, 1.5]


def test_resample_draws_by_weight():
    s = np.array([0.0, 1.0, 3.0, 0.0])
    _, c = B._Drawn({7: 40_000}, 1, 0)(7, np.zeros(4), s)
    assert c[0] == c[3] == 0 and c.sum() == 40_000 and c[2] / c[1] == pytest.approx(3.0, rel=0.05)


def test_boosting_rejects_what_it_cannot_do(spark):
    df = frame(spark, *table(10))
    for est in (B.BoostedTrees(grow="best"), B.BoostedTrees(maxBins=300)):
        with pytest.raises(ValueError):
            est.fit(df)
    with pytest.raises(ValueError, match="no rows"):
        B.BoostedTrees().fit(df.where("id < 0"))
    with pytest.raises(ValueError, match="no rows"):
        UnlimitedForest().fit(df.where("id < 0"))


# ---- moment regressions --------------------------------------------------------------------------

def messy(spark, n=600):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(n):
        a, b, k = rng.normal(), rng.normal(), rng.choice(["x", "y", "z"] + (["rare"] if i < 3 else []))
        y = 3 * a - 2 * b + a * b + {"x": 0, "y": 1, "z": 2, "rare": 9}[k] + rng.normal(0, 0.1)
        rows.append((i, float(a) if i % 11 else None, float(b) if i % 7 else float("nan"), str(k), float(y)))
    return spark.createDataFrame(rows, "id int, a double, b double, k string, label double")


@pytest.mark.parametrize("name", ["Linear Regression", "Ridge Regression", "Lasso Regression"])
def test_fold_scores_equal_refitted_pipelines(spark, name):
    df = messy(spark).persist()
    c = M.catalogue()[name]
    inter = ("ab", "a", "b")
    got = {r["fold"]: r for r in M.cross_validate(c, df, ["a", "b"], ["k"], inter, "label", "id", 3).collect()}
    from tabreg.functions.stats import hash_bucket
    data = df.withColumn("fold", hash_bucket(F.col("id"), "fold42", 3))
    for f in range(3):
        model, _ = M.fit_candidate(c, data.where(F.col("fold") != f), ["a", "b"], ["k"], inter, "label")
        want = regression_metrics(model.transform(data.where(F.col("fold") == f))).first()
        for m in ("n", "mae", "mse", "rmse", "r2"):
            assert got[f][m] == pytest.approx(want[m], rel=1e-6)


def test_learning_curve_equals_refitted_pipelines(spark):
    df = messy(spark, 400).persist()
    c = M.catalogue()["Ridge Regression"]
    slow = M.Candidate("other", True, c.build)
    object.__setattr__(slow, "moments", lambda facts: None)
    a, b = (learning_curve(x, df, ["a", "b"], ["k"], ("ab", "a", "b"), "label", "id", fractions=(0.5, 1.0), folds=2).orderBy("fraction").collect()
            for x in (c, slow))
    for r, s in zip(a, b):
        assert np.allclose(list(r), list(s), rtol=1e-6)


def test_moments_merge_exactly_and_solve():
    rng = np.random.default_rng(2)
    z = rng.normal(size=(50, 4)) + 1e6
    whole, parts = L.Moments.of(z), L.total([L.Moments.of(z[:10]), L.Moments.of(z[10:])])
    assert np.allclose(whole.cross, parts.cross) and np.allclose(whole.mean, parts.mean)
    x, y = rng.normal(size=(100, 3)), rng.normal(size=100)
    m = L.Moments.of(np.column_stack([x, y]))
    w, b = L.solve(m, "ols")
    assert np.allclose(np.append(w, b), np.linalg.lstsq(np.column_stack([x, np.ones(100)]), y, rcond=None)[0])
    sse, r2 = L.sse_r2(m, w, b)
    e = y - x @ w - b
    assert sse == pytest.approx((e ** 2).sum()) and r2 == pytest.approx(1 - (e ** 2).sum() / ((y - y.mean()) ** 2).sum())
    dup = L.Moments.of(np.column_stack([x, x[:, 0], y]))  # a column twice: the least-norm answer still predicts alike
    w2, b2 = L.solve(dup, "ols")
    assert np.allclose(np.column_stack([x, x[:, 0]]) @ w2 + b2, x @ w + b)


def test_two_encoders_and_a_look_alike_column(spark):
    df = spark.createDataFrame([("a", "p", 1.0, 5.0), ("b", "q", 2.0, 6.0)], "k string, m string, __dummy_0 double, v double")
    one, two = (DropFirstOneHot(inputCols=[c]).fit(df) for c in "km")
    out = two.transform(one.transform(df))
    assert len(set(out.columns)) == len(out.columns) == 6
    assert [r[one.outputColumns()[0]] for r in out.orderBy("k").collect()] == [0.0, 1.0]
    model = preparation_pipeline(["v"], ["k"], False).fit(df)
    assert [len(r.features) for r in model.transform(df).collect()] == [2, 2]


def test_forest_scores_a_stream_by_batches(spark, scratch):
    from pyspark.ml import PipelineModel
    from tabreg.streaming.scoring import score_batches, score_stream
    x, y = table(60)
    df = frame(spark, x, y)
    model = PipelineModel([UnlimitedForest(numTrees=2, seed=1).fit(df)])
    df.repartition(2).write.parquet(f"{scratch}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{scratch}/in")
    with pytest.raises(ValueError, match="score_batches"):
        score_stream(model, stream)
    score_batches(model, stream, f"{scratch}/out", f"{scratch}/ckpt", lambda s: s.select("id", "prediction")).awaitTermination()
    got = spark.read.parquet(f"{scratch}/out").select("id", "prediction").orderBy("id").collect()
    assert got == model.transform(df).select("id", "prediction").orderBy("id").collect()
