"""Closed-form and property checks for the Spark ML pool and the explanation operators."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from tabreg.operators import explain as X
from tabreg.operators import models as M
from tabreg.operators.prep import feature_names, named_features
from tabreg.sources.tables import CATEGORICAL_FEATURES, INTERACTION, NUMERIC_FEATURES, line_charge_split

from conftest import SF_SMALL

NUM, CAT = NUMERIC_FEATURES, CATEGORICAL_FEATURES


@pytest.fixture(scope="module")
def data(spark):
    return line_charge_split(spark, SF_SMALL).cache()


def _design(model, df):
    from pyspark.ml.functions import vector_to_array
    rows = model.transform(df).select(vector_to_array("features").alias("v"), "charge").collect()
    return np.array([r["v"] for r in rows]), np.array([r["charge"] for r in rows])


def _fit(name, data):
    c = M.catalogue(0.02)[name]
    model, _ = M.fit_candidate(c, data.where("split = 'train'"), NUM, CAT, INTERACTION, "charge")
    return model


def test_ols_matches_least_squares(data):
    model = _fit("Linear Regression", data)
    Xm, y = _design(model, data.where("split = 'train'"))
    A = np.column_stack([Xm, np.ones(len(y))])
    w, *_ = np.linalg.lstsq(A, y, rcond=None)
    lr = model.stages[-1]
    assert np.allclose(lr.coefficients.toArray(), w[:-1], rtol=1e-6, atol=1e-6)
    assert lr.intercept == pytest.approx(w[-1], rel=1e-6)


def test_ridge_matches_normal_equations(data):
    model = _fit("Ridge Regression", data)
    Xm, y = _design(model, data.where("split = 'train'"))
    Xc, yc = Xm - Xm.mean(axis=0), y - y.mean()
    w = np.linalg.solve(Xc.T @ Xc + 1.0 * np.eye(Xc.shape[1]), Xc.T @ yc)
    assert np.allclose(model.stages[-1].coefficients.toArray(), w, rtol=1e-4, atol=1e-3)


def _lasso_cd(Xm, y, alpha, iters=5000):
    n, p = Xm.shape
    Xc, yc = Xm - Xm.mean(axis=0), y - y.mean()
    w = np.zeros(p)
    norms = (Xc ** 2).sum(axis=0) / n
    for _ in range(iters):
        for j in range(p):
            if norms[j] == 0:
                continue
            r = yc - Xc @ w + Xc[:, j] * w[j]
            rho = Xc[:, j] @ r / n
            w[j] = np.sign(rho) * max(abs(rho) - alpha, 0.0) / norms[j]
    return w


def test_lasso_matches_coordinate_descent(data):
    model = _fit("Lasso Regression", data)
    Xm, y = _design(model, data.where("split = 'train'"))
    w = _lasso_cd(Xm, y, 0.001)
    assert np.allclose(model.stages[-1].coefficients.toArray(), w, rtol=1e-3, atol=1e-2)


def test_linear_contributions_sum_to_prediction_minus_mean(spark, data):
    model = _fit("Linear Regression", data)
    names = feature_names(model)
    prepared = named_features(model, data)
    means = prepared.agg(*[F.avg(n).alias(n) for n in names]).first()
    lr = model.stages[-1]
    contrib = X.shap_linear(prepared, names, lr.coefficients.toArray().tolist(), "row_key",
                            [float(means[n]) for n in names])
    sums = contrib.groupBy("row_key").agg(F.sum("contribution").alias("s"))
    pred = model.transform(data).select("row_key", "prediction")
    mean_pred = pred.agg(F.avg("prediction")).first()[0]
    bad = sums.join(pred, "row_key").where(F.abs(F.col("s") - (F.col("prediction") - mean_pred)) > 1e-6).count()
    assert bad == 0


def test_sampled_shapley_efficiency(spark, data):
    model = _fit("Decision Tree", data)
    test = data.where("split = 'test'")
    bg = X.background_rows(data.where("split = 'train'"), "row_key", 5)
    contrib = X.shap_sampled(model, test, bg, [*NUM, *CAT], "row_key", permutations=2)
    sums = contrib.groupBy("row_key").agg(F.sum("contribution").alias("s"))
    fx = model.transform(test).select("row_key", F.col("prediction").alias("fx"))
    fz = model.transform(bg).agg(F.avg("prediction")).first()[0]
    joined = sums.join(fx, "row_key")
    assert joined.count() == test.count()
    assert joined.where(F.abs(F.col("s") - (F.col("fx") - fz)) > 1e-6).count() == 0


def test_permutation_importance_shapes(spark, data):
    model = _fit("Linear Regression", data)
    imp = X.importance_permutation(model, data.where("split = 'test'"), [*NUM, *CAT], "row_key", "charge",
                                   repeats=2).collect()
    assert {r["feature"] for r in imp} == {*NUM, *CAT}
    by = {r["feature"]: r["importance_mean"] for r in imp}
    assert by["l_extendedprice"] > by["l_linenumber"]


def test_adaboost_runs_and_predicts_in_label_range(spark, data):
    model = _fit("AdaBoost", data)
    out = model.transform(data.where("split = 'test'"))
    lo, hi = data.agg(F.min("charge"), F.max("charge")).first()
    r = out.agg(F.count("prediction"), F.min("prediction"), F.max("prediction")).first()
    assert r[0] == out.count() and lo <= r[1] <= r[2] <= hi


def test_weighted_median_rule():
    from tabreg.operators.boosting import weighted_median
    # sorted predictions 1 (0.2), 5 (0.5 -> cum 0.7 >= 0.5): weighted median is 5
    assert weighted_median(np.array([[9.0], [1.0], [5.0]]), np.array([0.3, 0.2, 0.5])).tolist() == [5.0]


def test_train_all_isolates_failures(spark, data):
    pool = {k: v for k, v in M.catalogue(0.02).items() if k in ("Linear Regression", "Decision Tree")}
    pool["Broken"] = M.Candidate("Broken", False, lambda f: (_ for _ in ()).throw(RuntimeError("boom")))
    results, failures, fitted = M.train_all(data, pool, NUM, CAT, INTERACTION, "charge", "row_key")
    assert {r["algorithm"] for r in results.collect()} == {"Linear Regression", "Decision Tree"}
    assert [r["algorithm"] for r in failures.collect()] == ["Broken"]


def test_model_save_load_round_trip(spark, data, scratch):
    model = _fit("Gradient Boosting", data)
    M.save_model(model, f"{scratch}/model")
    back = M.load_model(f"{scratch}/model")
    a = model.transform(data).select("row_key", "prediction")
    b = back.transform(data).select("row_key", F.col("prediction").alias("p2"))
    assert a.join(b, "row_key").where(F.abs(F.col("prediction") - F.col("p2")) > 1e-9).count() == 0


def test_adaboost_saves_and_matches_its_trees(spark, data, scratch):
    model = _fit("AdaBoost", data)
    M.save_model(model, f"{scratch}/ada")
    back = M.load_model(f"{scratch}/ada")
    a = model.transform(data).select("row_key", "prediction")
    b = back.transform(data).select("row_key", F.col("prediction").alias("p2"))
    assert a.join(b, "row_key").where("prediction <> p2").count() == 0


def test_predict_batch_checks_keeps_and_derives(data):
    model = _fit("Linear Regression", data)
    out = M.predict_batch(model, data, [*NUM, *CAT], INTERACTION, "p")
    assert out.columns == [*data.columns, INTERACTION[0], "p"]
    assert out.join(data, data.columns).count() == data.count()  # inputs come back as they went in
    with pytest.raises(Exception, match="l_tax"):
        M.predict_batch(model, data.drop("l_tax"), [*NUM, *CAT], INTERACTION)


def test_permutation_importance_of_an_unused_column_is_zero(spark, data):
    model = _fit("Linear Regression", data)
    lr = model.stages[-1]
    imp = {r["feature"]: r for r in X.importance_permutation(
        model, data.where("split = 'test'"), [*NUM, *CAT], "row_key", "charge", repeats=3).collect()}
    assert len(imp) == len(NUM) + len(CAT) and abs(imp["l_linenumber"]["importance_mean"]) < 0.01
    assert imp["l_extendedprice"]["importance_mean"] > 0.5 and len(lr.coefficients) == len(feature_names(model))


def test_cross_validation_uses_the_folds_own_facts(data):
    seen = []
    real = M.training_facts
    c = M.Candidate("Tree", False, lambda f: (seen.append(f["n"]), M.catalogue()["Decision Tree"].build(f))[1])
    train = data.where("split = 'train'")
    M.cross_validate(c, train, NUM, CAT, INTERACTION, "charge", "row_key", 3)
    assert len(seen) == 3 and sum(seen) == 2 * train.count() and real is M.training_facts


def test_model_pool_cross_validates_the_whole_catalogue(spark, monkeypatch):
    from tabreg.plans import q_models
    asked = {}

    def train_all(data, pool, *rest, folds=0, **how):
        asked.update(pool=list(pool), folds=folds)
        row = lambda n, x: (n, x, 1 - x, 1 - x, 0.1, x, 0.01)
        return (spark.createDataFrame([row(n, 0.9 - i / 100) for i, n in enumerate(pool)],
                                      "algorithm string, r2 double, rmse double, mae double, r2_gap double, "
                                      "cv_r2_mean double, cv_r2_std double"),
                spark.createDataFrame([], "algorithm string, failure string"), {})
    monkeypatch.setattr(M, "train_all", train_all)
    out = q_models.q_model_pool(spark, SF_SMALL).collect()
    assert asked == {"pool": list(M.catalogue()), "folds": 5}
    assert sorted(r["deployment_rank"] for r in out) == list(range(1, 13))


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000, 4097])
def test_permutations_are_bijections(n):
    rank = np.arange(n)
    a, b = X.permuted(rank, n, 1), X.permuted(rank, n, 2)
    assert sorted(a.tolist()) == sorted(b.tolist()) == rank.tolist()
    if n > 60:
        assert (a != b).any() and (a != rank).mean() > 0.9 and abs(np.corrcoef(a, rank)[0, 1]) < 0.35


def test_permutation_uses_each_value_once_and_drops_as_numpy_says(spark):
    from pyspark.ml import PipelineModel
    from pyspark.ml.feature import VectorAssembler
    from tabreg.operators.linear import MomentRegression
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=500), rng.normal(size=500)
    df = spark.createDataFrame([(i, float(p), float(q), float(2 * p + q)) for i, (p, q) in enumerate(zip(a, b))], "id int, a double, b double, label double")
    assemble = VectorAssembler(inputCols=["a", "b"], outputCol="features")
    model = PipelineModel([assemble, MomentRegression().fit(assemble.transform(df))])
    got = {r["feature"]: r for r in X.importance_permutation(model, df.repartition(4), ["a", "b"], "id", "label", repeats=3, seed=5).collect()}
    y, want = 2 * a + b, {"a": [], "b": []}
    for i in range(3):
        p = X.permuted(np.arange(500), 500, 5000 + i)
        for f, pred in (("a", 2 * a[p] + b), ("b", 2 * a + b[p])):
            want[f].append(((y - pred) ** 2).sum() / ((y - y.mean()) ** 2).sum())
    for f in "ab":
        assert got[f]["importance_mean"] == pytest.approx(np.mean(want[f]), rel=1e-6)
        assert got[f]["importance_std"] == pytest.approx(np.std(want[f]), rel=1e-5)


def _plain_shapley(f, x, background):
    """By enumeration of all subsets of features."""
    from itertools import combinations
    from math import factorial
    k = len(x)

    def v(s):
        z = background.copy()
        z[:, list(s)] = x[list(s)]
        return f(z).mean()
    out = np.zeros(k)
    for i in range(k):
        others = [j for j in range(k) if j != i]
        for r in range(k):
            for s in combinations(others, r):
                out[i] += factorial(r) * factorial(k - r - 1) / factorial(k) * (v({*s, i}) - v(s))
    return out


@pytest.mark.parametrize("kind", ["own", "spark"])
def test_tree_shapley_is_enumeration(spark, kind):
    from pyspark.ml.linalg import Vectors
    from pyspark.ml.regression import DecisionTreeRegressor, RandomForestRegressor
    from tabreg.operators import treegrow as G
    from tabreg.operators.boosting import BoostedTrees
    from tabreg.operators.treeshap import Explainer, model_trees
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=(200, 4)), 1)
    df = spark.createDataFrame([(Vectors.dense(r), float(r[0] * r[1] + (r[2] > 0) - r[3] ** 2)) for r in x], ["features", "label"])
    models = ([BoostedTrees(rounds=4, depth=3, rate=0.5).fit(df), BoostedTrees(rounds=2, grow="leaf", maxLeaves=9, minChild=2.0).fit(df)] if kind == "own"
              else [DecisionTreeRegressor(maxDepth=4).fit(df), RandomForestRegressor(numTrees=3, maxDepth=3, seed=1).fit(df)])
    for model in models:
        trees = model_trees(model)
        f = lambda z: sum(w * G.predict(t, np.ascontiguousarray(z.T)) for w, t in trees)
        start = model.getOrDefault("start") if kind == "own" else 0.0
        pred = [r.prediction for r in model.transform(df).collect()]
        assert np.allclose(f(x) + start, pred)
        phi = Explainer(trees, x[:30].T)(x[100:110].T)
        for i in range(10):
            assert np.allclose(phi[:, i], _plain_shapley(f, x[100 + i], x[:30].copy()))


def test_tree_contributions_sum_to_prediction_minus_background(spark, data):
    for name in ("Decision Tree", "gbt_wide"):
        model = _fit(name, data)
        test = data.where("split = 'test'")
        bg = X.background_rows(data.where("split = 'train'"), "row_key", 20)
        contrib = X.shap_tree(model, test, bg, "row_key")
        assert {r[0] for r in contrib.select("feature").distinct().collect()} == set(feature_names(model))
        sums = contrib.groupBy("row_key").agg(F.sum("contribution").alias("s"))
        fz = model.transform(bg).agg(F.avg("prediction")).first()[0]
        joined = sums.join(model.transform(test).select("row_key", F.col("prediction").alias("fx")), "row_key")
        assert joined.count() == test.count()
        assert joined.where(F.abs(F.col("s") - (F.col("fx") - fz)) > 1e-6 * F.abs(F.col("fx"))).count() == 0
    with pytest.raises(ValueError, match="no trees"):
        X.shap_tree(_fit("Linear Regression", data), test, bg, "row_key")
