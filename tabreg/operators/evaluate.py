"""Evaluation operators: metrics, residual tables, residual shape, identity line, Q-Q points.

All of them are single-pass aggregates (partial + final), so they hold a few numbers per group no
matter how many rows are scored.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabreg.functions.stats import inverse_normal, r2_expr, sample_kurt, sample_skew
from tabreg.operators.quantile import exact_quantiles


def regression_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction",
                       by: Sequence[str] = ()) -> DataFrame:
    """n, MAE, MSE, RMSE, R2 per group (R2 against the group's own mean, as scikit-learn)."""
    e = F.col(label) - F.col(prediction)
    aggs = [
        F.count(F.lit(1)).cast("bigint").alias("n"),
        F.avg(F.abs(e)).alias("mae"),
        F.avg(e * e).alias("mse"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        r2_expr(label, prediction).alias("r2"),
    ]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def train_test_metrics(scored: DataFrame, label: str = "label", prediction: str = "prediction",
                       split: str = "split", by: Sequence[str] = ()) -> DataFrame:
    """One row per group with train_* and test metrics plus the train-test R2 gap (one aggregation)."""
    e = F.col(label) - F.col(prediction)
    out = []
    for side, prefix in (("train", "train_"), ("test", "")):
        on = F.col(split) == side
        ys = F.when(on, F.col(label))
        es = F.when(on, e)
        n = F.count(es)
        sse = F.sum(es * es)
        sst = F.var_pop(ys) * F.count(ys)
        out += [
            F.avg(F.abs(es)).alias(f"{prefix}mae"),
            F.avg(es * es).alias(f"{prefix}mse"),
            F.sqrt(F.avg(es * es)).alias(f"{prefix}rmse"),
            (F.lit(1.0) - F.try_divide(sse, F.when(sst != 0, sst))).alias(f"{prefix}r2"),
            n.cast("bigint").alias(f"{prefix}n"),
        ]
    agg = scored.groupBy(*by).agg(*out) if by else scored.agg(*out)
    return agg.withColumn("r2_gap", F.col("train_r2") - F.col("r2"))


def wide_metrics(wide: DataFrame, predictions: Mapping[str, str], by: str, label: str = "label") -> DataFrame:
    """(model, by, n, mae, mse, rmse, r2): ``regression_metrics`` of several prediction columns from one aggregation
    of the rows as they are (no copy of a row per model)."""
    y = F.col(label)
    sums = [F.count(F.lit(1)).cast("bigint").alias("n"), (F.var_pop(y) * F.count(F.lit(1))).alias("sst")]
    for i, c in enumerate(predictions.values()):
        e = y - F.col(c)
        sums += [F.sum(F.abs(e)).alias(f"a{i}"), F.sum(e * e).alias(f"q{i}")]
    per = wide.groupBy(by).agg(*sums).select(by, "n", "sst", F.explode(F.array(*[
        F.struct(F.lit(m).alias("model"), F.col(f"a{i}").alias("a"), F.col(f"q{i}").alias("q")) for i, m in enumerate(predictions)])).alias("x"))
    mse = F.col("x.q") / F.col("n")
    return per.select("x.model", by, "n", (F.col("x.a") / F.col("n")).alias("mae"), mse.alias("mse"), F.sqrt(mse).alias("rmse"),
                      (F.lit(1.0) - F.try_divide(F.col("x.q"), F.when(F.col("sst") != 0, F.col("sst")))).alias("r2"))


def sides(metrics: DataFrame, split: str = "split") -> DataFrame:
    """``train_test_metrics`` per model from (model, split, n, mae, mse, rmse, r2), a row per model and side."""
    at = lambda side, c: F.max(F.when(F.col(split) == side, F.col(c)))
    out = metrics.groupBy("model").agg(*[at(side, c).alias(f"{prefix}{c}") for side, prefix in (("train", "train_"), ("test", ""))
                                         for c in ("mae", "mse", "rmse", "r2", "n")])
    return out.withColumn("r2_gap", F.col("train_r2") - F.col("r2"))


def residual_table(scored: DataFrame, key: str, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Per row: key, actual, predicted, residual, absolute and squared error (no shuffle)."""
    res = F.col(label) - F.col(prediction)
    return scored.select(
        F.col(key),
        F.col(label).alias("actual"),
        F.col(prediction).alias("predicted"),
        res.alias("residual"),
        F.abs(res).alias("absolute_error"),
        (res * res).alias("squared_error"),
    )


def residual_summary(scored: DataFrame, label: str = "label", prediction: str = "prediction",
                     by: Sequence[str] = ()) -> DataFrame:
    """Mean, sample std, bias-corrected skew and kurtosis of residuals, plus MAE and RMSE."""
    r = F.col("__res")
    df = scored.withColumn("__res", F.col(label) - F.col(prediction))
    aggs = [
        F.count(r).cast("bigint").alias("n"),
        F.avg(r).alias("mean_residual"),
        F.stddev_samp(r).alias("std_residual"),
        sample_skew(r).alias("skew_residual"),
        sample_kurt(r).alias("kurtosis_residual"),
        F.avg(F.abs(r)).alias("mae"),
        F.sqrt(F.avg(r * r)).alias("rmse"),
    ]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def identity_line(scored: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Range covering both actual and predicted values (end points of the y = x reference line)."""
    return scored.agg(
        F.least(F.min(label), F.min(prediction)).alias("line_min"),
        F.greatest(F.max(label), F.max(prediction)).alias("line_max"),
    )


def qq_points(scored: DataFrame, n_points: int = 99, label: str = "label", prediction: str = "prediction",
              accuracy: int | None = None) -> DataFrame:
    """Normal Q-Q points of the residuals on the grid p_i = i/(n_points+1).

    Sample quantiles come from the distributed exact quantile operator; theoretical quantiles from the
    inverse normal CDF expression. Output: i, p, theoretical, sample.
    """
    probs = [i / (n_points + 1) for i in range(1, n_points + 1)]
    res = scored.select((F.col(label) - F.col(prediction)).alias("residual"))
    q = exact_quantiles(res, ["residual"], probs, accuracy=accuracy)
    return q.select(
        (F.round(F.col("p") * (n_points + 1))).cast("int").alias("i"),
        F.col("p"),
        inverse_normal(F.col("p")).alias("theoretical"),
        F.col("value").alias("sample"),
    )




def learning_curve(candidate, train: DataFrame, numeric, categorical, interaction, label: str, key: str,
                   fractions: Sequence[float] = (0.2, 0.4, 0.6, 0.8, 1.0), folds: int = 5,
                   salt: str = "fold42", size_salt: str = "size42") -> DataFrame:
    """For each training fraction and fold: fit on that fraction of the other folds (nested hash subsets,
    so a larger size contains the smaller ones), score the subset (train R2) and the held-out fold
    (validation R2). Returns one row per fraction: n_train_mean, train/validation R2 mean and
    population std over folds."""
    from tabreg.functions.stats import hash_bucket
    from tabreg.operators.models import fit_candidate, run_concurrently, score
    if how := candidate.moments(None):
        from tabreg.operators.linear import curve_scores
        bucket = hash_bucket(F.col(key), size_salt, 1000)
        level = F.coalesce(*[F.when(bucket < int(round(x * 1000)), i) for i, x in enumerate(fractions)], F.lit(len(fractions)))
        scores = curve_scores(train.withColumn("__level", level), hash_bucket(F.col(key), salt, folds), folds, F.col("__level"),
                              len(fractions) + 1, numeric, categorical, interaction, label, *how)
        rows = [(float(fractions[top]), f, n, a, b) for top, f, n, a, b in scores if top < len(fractions)]
        return _curve(train.sparkSession, rows)
    data = (train.withColumn("__fold", hash_bucket(F.col(key), salt, folds))
            .withColumn("__size", hash_bucket(F.col(key), size_salt, 1000)).persist())

    def one(task):
        frac, f = task
        sub = data.where((F.col("__fold") != f) & (F.col("__size") < int(round(frac * 1000))))
        model, _ = fit_candidate(candidate, sub, numeric, categorical, interaction, label)
        tr = regression_metrics(score(model, sub), label=label).first()
        va = regression_metrics(score(model, data.where(F.col("__fold") == f)), label=label).first()
        return (float(frac), f, int(tr["n"]), float(tr["r2"]), float(va["r2"]))

    rows = run_concurrently(one, [(frac, f) for frac in fractions for f in range(folds)])
    data.unpersist()
    return _curve(train.sparkSession, rows)


def _curve(spark, rows: list[tuple]) -> DataFrame:
    per_fold = spark.createDataFrame(
        rows, "fraction double, fold int, n_train bigint, train_r2 double, validation_r2 double")
    return per_fold.groupBy("fraction").agg(
        F.avg("n_train").alias("n_train_mean"), F.avg("train_r2").alias("train_r2_mean"),
        F.stddev_pop("train_r2").alias("train_r2_std"), F.avg("validation_r2").alias("validation_r2_mean"),
        F.stddev_pop("validation_r2").alias("validation_r2_std"))
