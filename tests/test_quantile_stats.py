import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabreg.functions.stats import guarded_corr, sample_kurt, sample_skew, sig_round
from tabreg.operators.quantile import exact_quantiles


def _pandas_q(values, p):
    s = pd.Series(values, dtype="float64").dropna()
    return None if s.empty else float(s.quantile(p))


@pytest.mark.parametrize("acc", [10, 10000])
def test_exact_quantiles_match_pandas_with_ties_and_missing(spark, acc):
    rng = np.random.default_rng(7)
    vals = [float(v) for v in rng.integers(0, 20, 500)] + [float("nan")] * 5 + [None] * 5
    vals += [3.0] * 300  # a hot value holding a third of the rows
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = {r["p"]: r["value"] for r in exact_quantiles(df, ["x"], probs, accuracy=acc).collect()}
    for p in probs:
        assert got[p] == pytest.approx(_pandas_q(vals, p))


def test_exact_quantiles_small_n(spark):
    for n in (1, 2, 3):
        df = spark.createDataFrame([(float(i),) for i in range(n)], "x double")
        got = exact_quantiles(df, ["x"], [0.25, 0.5]).orderBy("p").collect()
        assert [r["value"] for r in got] == pytest.approx([_pandas_q(range(n), 0.25), _pandas_q(range(n), 0.5)])


def test_exact_quantiles_empty_column(spark):
    df = spark.createDataFrame([(None,), (None,)], "x double")
    r = exact_quantiles(df, ["x"], [0.5]).first()
    assert r["value"] is None and r["n"] == 0


def test_median_of_four_is_interpolated(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,)], "x double")
    assert exact_quantiles(df, ["x"], [0.5]).first()["value"] == 2.5


def test_skew_kurt_corrected_and_guarded(spark):
    vals = [1.0, 2.0, 2.0, 3.0, 10.0, 11.0, 30.0]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    r = df.agg(sample_skew("x").alias("s"), sample_kurt("x").alias("k")).first()
    s = pd.Series(vals)
    assert r["s"] == pytest.approx(s.skew())
    assert r["k"] == pytest.approx(s.kurt())
    small = spark.createDataFrame([(1.0,), (2.0,)], "x double")
    r = small.agg(sample_skew("x").alias("s"), sample_kurt("x").alias("k")).first()
    assert r["s"] is None and r["k"] is None
    const = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (1.0, 4.0), (1.0, 5.0)], "a double, b double")
    r = const.agg(sample_skew("a").alias("s"), guarded_corr("a", "b").alias("r")).first()
    assert r["s"] is None and r["r"] is None


def test_sig_round(spark):
    df = spark.createDataFrame([(888650176.849449,), (-0.0,), (1.23456789012e-7,), (None,)], "x double")
    got = [r[0] for r in df.select(sig_round("x", 9)).collect()]
    assert got[0] == 888650177.0
    assert got[1] == 0.0 and math.copysign(1, got[1]) == 1
    assert got[2] == pytest.approx(1.23456789e-7, rel=1e-12)
    assert got[3] is None


def test_duplicate_rows_digest_matches_exact(spark):
    from tabreg.operators.profile import duplicate_rows
    rows = [("a", 1.0), ("a", 1.0), (None, 2.0), (None, 2.0), ("b", None), ("b", None), ("b", 3.0), ("a", 1.0)]
    df = spark.createDataFrame(rows, "t string, x double")
    exact = duplicate_rows(df).first()[0]
    digest = duplicate_rows(df, by_digest=True).first()[0]
    assert exact == digest == 4


def test_exact_quantiles_narrow_crowded_brackets(spark):
    import numpy as np
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=4000), np.full(2500, 0.25), np.full(50, -3.0)])
    df = spark.createDataFrame([(float(v), float(i % 7)) for i, v in enumerate(x)], "x double, y double").repartition(6)
    probs = [0.0, 0.01, 0.25, 0.5, 0.77, 0.999, 1.0]
    got = {(r["column"], r["p"]): r["value"] for r in exact_quantiles(df, ["x", "y"], probs, accuracy=20, bracket_rows=30).collect()}
    for c, v in (("x", x), ("y", np.arange(len(x)) % 7.0)):
        for p in probs:
            assert got[c, p] == pytest.approx(np.quantile(v, p), abs=1e-12), (c, p)


def test_correlations_of_many_columns_with_gaps(spark):
    import numpy as np
    from tabreg.operators.profile import corr_matrix, corr_target
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 60)) * 1e-3 + 1e6
    x[:, 1] = x[:, 0] * 2
    x[:, 2] = 5.0
    x[rng.random(x.shape) < .05] = np.nan
    df = spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in r) for r in x], ", ".join(f"c{i} double" for i in range(60)))
    got = {(r["column_a"], r["column_b"]): r["r"] for r in corr_matrix(df).collect()}
    assert len(got) == 60 * 59 // 2
    for i, j in ((0, 1), (3, 40), (58, 59), (2, 7)):
        both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
        a, b = x[both, i] - 1e6, x[both, j] - (2e6 if j == 1 else 1e6)
        want = None if i == 2 else np.corrcoef(a, b)[0, 1]
        assert got[f"c{i}", f"c{j}"] is None if want is None else got[f"c{i}", f"c{j}"] == pytest.approx(want, abs=1e-6)
    assert {r["column"]: r["r"] for r in corr_target(df, "c40").collect()}["c3"] == pytest.approx(got["c3", "c40"], abs=1e-9)


def test_dtype_of_integers_with_missing_values(spark):
    from tabreg.operators.profile import column_summary
    df = spark.createDataFrame([(1, 1, True, None), (2, None, None, None)], "a int, b int, c boolean, d decimal(5,2)")
    assert {r["column"]: r["data_type"] for r in column_summary(df).collect()} == {
        "a": "int64", "b": "float64", "c": "object", "d": "object"}


def _plain_lowess(x, y, grid, frac):
    out = []
    k = min(len(x), max(1, int(np.ceil(frac * len(x) - 1e-9))))
    for g in grid:
        d = np.abs(x - g)
        h = np.sort(d)[k - 1]
        if h == 0:
            out.append((h, y[d == 0].mean()))
            continue
        w = np.where(d < h, (1 - (d / h) ** 3) ** 3, 0.0)
        a = np.column_stack([np.ones(len(x)), x - g])
        coef = np.linalg.lstsq(a * np.sqrt(w)[:, None], y * np.sqrt(w), rcond=None)[0]
        out.append((h, coef[0]))
    return out


def test_lowess_is_the_plain_one(spark):
    from tabreg.operators.profile import lowess
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.exponential(3, 300), [2.0] * 40]) + 1000
    y = np.sin(x) * 5 + rng.normal(size=len(x))
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)] + [(None, 1.0), (float("nan"), 2.0), (3.0, None)], "x double, y double")
    for frac in (2 / 3, 0.2):
        got = lowess(df.repartition(4), "x", "y", 12, frac).orderBy("point").collect()
        want = _plain_lowess(x, y, [r["x"] for r in got], frac)
        assert np.allclose([r["bandwidth"] for r in got], [w[0] for w in want])
        assert np.allclose([r["trend"] for r in got], [w[1] for w in want], rtol=1e-7, atol=1e-7)


def test_lowess_of_little(spark):
    from tabreg.operators.profile import lowess
    flat = lowess(spark.createDataFrame([(2.0, 1.0), (2.0, 3.0)], "x double, y double"), "x", "y", 3).collect()
    assert [r["trend"] for r in flat] == [2.0] * 3
    assert lowess(spark.createDataFrame([], "x double, y double"), "x", "y").collect() == []
