"""Properties of the reference's preprocessing tests, re-expressed for the Spark stages."""
import pytest
from pyspark.sql import functions as F

from tabreg.operators.columns import MissingColumnsError, require_columns, select_ordered
from tabreg.operators.prep import (DropFirstOneHot, ExactMedianImputer, InteractionFeature, PopulationScaler,
                                   feature_names, named_features, preparation_pipeline, prepare_input)
from tabreg.operators.split import hash_split
from tabreg.sources.tables import CATEGORICAL_FEATURES, INTERACTION, NUMERIC_FEATURES, line_charge

from conftest import SF_SMALL

BUILDING = ["Relative_Compactness", "Wall_Area", "Roof_Area", "Overall_Height", "Orientation", "Glazing_Area",
            "Glazing_Area_Distribution"]


def test_interaction_value_and_input_unchanged(spark):
    df = spark.createDataFrame([(0.86, 294.0, 147.0, 7.0, 2, 0.10, 1)], BUILDING)
    t = InteractionFeature(inputCols=["Relative_Compactness", "Overall_Height"], outputCol="Compactness_Height")
    out = t.transform(df)
    assert out.first()["Compactness_Height"] == pytest.approx(6.02)
    assert df.columns == BUILDING  # input not changed
    assert out.columns == BUILDING + ["Compactness_Height"]
    assert t.transform(out).columns == out.columns  # not added twice


def test_split_disjoint_covering_deterministic_and_partition_independent(spark):
    lc = line_charge(spark, SF_SMALL)
    a = hash_split(lc, "row_key").select("row_key", "split")
    b = hash_split(lc.repartition(7), "row_key").select("row_key", "split")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    tr, te = a.where("split = 'train'"), a.where("split = 'test'")
    assert tr.join(te, "row_key").count() == 0
    assert tr.count() + te.count() == lc.count()
    frac = te.count() / lc.count()
    assert 0.15 < frac < 0.25


def test_required_columns_error_names_missing(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "a double, b double")
    with pytest.raises(MissingColumnsError, match="c, d"):
        require_columns(df, ["a", "c", "d"])
    with pytest.raises(MissingColumnsError):
        select_ordered(df, ["b", "zz"])
    assert select_ordered(df, ["b", "a"]).columns == ["b", "a"]


def test_imputer_exact_median_and_nan(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,), (None,), (float("nan"),)], "x double")
    m = ExactMedianImputer(inputCols=["x"]).fit(df)
    assert m.medians()["x"] == 2.5
    vals = [r["x"] for r in m.transform(df).collect()]
    assert vals[-2:] == [2.5, 2.5]


def test_scaler_population_std_and_zero_variance(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0)], "a double, b double")
    out = PopulationScaler(inputCols=["a", "b"]).fit(df).transform(df).collect()
    pop_std = (2 / 3) ** 0.5
    assert [r["a"] for r in out] == pytest.approx([-1 / pop_std, 0.0, 1 / pop_std])
    assert [r["b"] for r in out] == [0.0, 0.0, 0.0]


def test_one_hot_drops_first_sorted_level_and_unknown_is_zero(spark):
    train = spark.createDataFrame([("b",), ("a",), ("c",)], "k string")
    enc = DropFirstOneHot(inputCols=["k"]).fit(train)
    assert enc.outputNames() == ["k_b", "k_c"]
    out = enc.transform(spark.createDataFrame([("a",), ("c",), ("zz",)], "k string")).collect()
    b, c = enc.outputColumns()
    assert [(r[b], r[c]) for r in out] == [(0.0, 0.0), (0.0, 1.0), (0.0, 0.0)]
    nums = DropFirstOneHot(inputCols=["o"]).fit(spark.createDataFrame([(10,), (2,), (3,)], "o int"))
    assert nums.outputNames() == ["o_3", "o_10"]  # numeric levels sort numerically


def test_tree_and_linear_preparations_same_width_and_finite(spark):
    lc = hash_split(line_charge(spark, SF_SMALL), "row_key")
    train = lc.where("split = 'train'")
    widths = []
    for scale in (False, True):
        m = preparation_pipeline(NUMERIC_FEATURES, CATEGORICAL_FEATURES, scale, INTERACTION).fit(train)
        names = feature_names(m)
        widths.append(len(names))
        assert names[:6] == [*NUMERIC_FEATURES, "price_discount"]
        out = m.transform(lc)
        from pyspark.ml.functions import vector_to_array
        arr = out.select(vector_to_array("features").alias("v"))
        bad = arr.where(F.exists("v", lambda x: F.isnan(x) | (F.abs(x) == float("inf")))).count()
        assert bad == 0
    assert widths[0] == widths[1]


def test_transform_before_fit_is_an_error(spark):
    pipe = preparation_pipeline(NUMERIC_FEATURES, CATEGORICAL_FEATURES, True, INTERACTION)
    with pytest.raises(AttributeError):
        pipe.transform  # an Estimator pipeline has no transform before fit


def test_prepare_input_idempotent(spark):
    lc = line_charge(spark, SF_SMALL)
    once = prepare_input(lc, INTERACTION)
    twice = prepare_input(once, INTERACTION)
    assert once.columns == twice.columns and once.columns.count("price_discount") == 1


def test_global_rank_is_a_permutation_in_key_order(spark):
    from tabreg.operators.split import global_rank, kfold_contiguous
    lc = line_charge(spark, SF_SMALL)
    r = global_rank(lc, ["row_key"])
    n = lc.count()
    s = r.agg(F.count("rank"), F.countDistinct("rank"), F.min("rank"), F.max("rank")).first()
    assert tuple(s) == (n, n, 0, n - 1)
    rows = r.select("row_key", "rank").orderBy("rank").collect()
    keys = [x["row_key"] for x in rows]
    assert keys == sorted(keys)
    sizes = sorted(x["count"] for x in kfold_contiguous(lc, ["row_key"], 5).groupBy("fold").count().collect())
    assert sizes[-1] - sizes[0] <= 1 and sum(sizes) == n


def test_lookalike_columns_are_never_features_and_levels_hold_any_character(spark):
    rows = [(1.0, "a", 2.0, 10.0), (2.0, "b", 3.5, 20.0), (3.0, "a", 2.0, 30.0)]
    df = spark.createDataFrame(rows, "x double, kind string, h double, kind_total double")
    m = preparation_pipeline(["x"], ["kind", "h"], False).fit(df)
    assert feature_names(m) == ["x", "kind_b", "h_3.5"]
    assert [tuple(r["features"].toArray()) for r in m.transform(df).collect()] == [(1, 0, 0), (2, 1, 1), (3, 0, 0)]
    assert "h_3.5" in named_features(m, df).columns


def test_too_many_levels_names_the_column(spark):
    df = spark.createDataFrame([(str(i), "k") for i in range(6)], "a string, b string")
    with pytest.raises(ValueError, match="column a has more than 5 levels"):
        DropFirstOneHot(inputCols=["a", "b"], maxLevels=5).fit(df)
    assert len(DropFirstOneHot(inputCols=["a", "b"], maxLevels=6).fit(df).outputNames()) == 5


def test_all_missing_column_warns(spark):
    with pytest.warns(UserWarning, match="x"):
        ExactMedianImputer(inputCols=["x"]).fit(spark.createDataFrame([(None,)], "x double"))


def test_global_rank_keeps_null_and_repeated_keys(spark):
    from tabreg.operators.split import global_rank
    df = spark.createDataFrame([("a", 1), ("b", 2), (None, 3), ("c", 4), ("c", 5)], "k string, v int")
    rows = sorted(global_rank(df, ["k"]).collect(), key=lambda r: r["rank"])
    assert [r["rank"] for r in rows] == [0, 1, 2, 3, 4]
    assert [r["k"] for r in rows] == [None, "a", "b", "c", "c"] and {r["v"] for r in rows} == {1, 2, 3, 4, 5}
