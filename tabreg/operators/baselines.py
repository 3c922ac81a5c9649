"""SQL-expressible members of the model pool: train mean, identity, one-feature least squares.

Fitting is one global aggregation over the training rows (``regr_slope`` / ``regr_intercept`` /
``avg`` are merged partially on every executor); the fitted coefficients are a one-row DataFrame
that is cross-joined (broadcast, one row) to score any number of rows without a shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabreg.functions.stats import sig_round, sig_round_sql

# Fitted coefficients are published at this many significant digits, so that any engine scoring with
# them (Spark here, DuckDB in the oracle) computes bit-identical predictions.
COEF_DIGITS = 9

# The five SQL-expressible predictors of charge on line_charge.
#   p0 train mean; p1 l_extendedprice as is; p2 OLS on l_extendedprice;
#   p3 OLS on l_extendedprice * (1 - l_discount); p4 OLS on l_quantity.
def ols_inputs() -> dict[str, Column]:
    """Inputs of the one-feature least-squares predictors (built on call: needs an active session)."""
    return {
        "p2": F.col("l_extendedprice"),
        "p3": F.col("l_extendedprice") * (1 - F.col("l_discount")),
        "p4": F.col("l_quantity"),
    }


OLS_NAMES = ("p2", "p3", "p4")


def fit_simple_ols(train: DataFrame, label: str, inputs: Mapping[str, Column]) -> DataFrame:
    """One-row DataFrame: ``{name}_slope``, ``{name}_intercept`` per input, plus ``mean_label``.

    A constant input has no least-squares slope; the fit then falls back to the mean (slope 0).
    Coefficients are rounded to ``COEF_DIGITS`` significant digits.
    """
    y = F.col(label)
    aggs = [sig_round(F.avg(y), COEF_DIGITS).alias("mean_label")]
    for name, x in inputs.items():
        aggs.append(sig_round(F.coalesce(F.regr_slope(y, x), F.lit(0.0)), COEF_DIGITS).alias(f"{name}_slope"))
        aggs.append(sig_round(F.coalesce(F.regr_intercept(y, x), F.avg(y)), COEF_DIGITS)
                    .alias(f"{name}_intercept"))
    return train.agg(*aggs)


def score_simple(df: DataFrame, fit: DataFrame, inputs: Mapping[str, Column]) -> DataFrame:
    """Adds one prediction column per input (``pred_{name}``) and ``pred_p0``/``pred_p1``."""
    scored = df.crossJoin(F.broadcast(fit))
    cols = {"pred_p0": F.col("mean_label"), "pred_p1": F.col("l_extendedprice")}
    for name, x in inputs.items():
        cols[f"pred_{name}"] = F.col(f"{name}_intercept") + F.col(f"{name}_slope") * x
    return scored.withColumns(cols)


def baseline_wide(split_df: DataFrame, label: str = "charge") -> DataFrame:
    """The rows with one prediction column (``pred_<model>``) per baseline predictor."""
    inputs = ols_inputs()
    return score_simple(split_df, fit_simple_ols(split_df.where(F.col("split") == "train"), label, inputs), inputs)


def prediction_columns() -> dict[str, str]:
    return {m: f"pred_{m}" for m in ("p0", "p1", *ols_inputs())}


def baseline_metrics(split_df: DataFrame, label: str = "charge") -> DataFrame:
    """(model, split, n, mae, mse, rmse, r2) of all baseline predictors: one read to fit, one to score."""
    from tabreg.operators.evaluate import wide_metrics
    return wide_metrics(baseline_wide(split_df, label), prediction_columns(), "split", label)


def baseline_predictions(split_df: DataFrame, label: str = "charge", models: Sequence[str] | None = None) -> DataFrame:
    """Long table (model, split, key, label, prediction) for the wanted baseline predictors (all five if None)."""
    inputs = {k: v for k, v in ols_inputs().items() if models is None or k in models}
    fit = fit_simple_ols(split_df.where(F.col("split") == "train"), label, inputs)
    wide = score_simple(split_df, fit, inputs)
    models = [m for m in ("p0", "p1", *inputs) if models is None or m in models]
    if len(models) == 1:
        return wide.select(F.lit(models[0]).alias("model"), "split", "row_key", F.col(label).alias("label"),
                           F.col(f"pred_{models[0]}").alias("prediction"))
    return wide.select(
        "row_key", "split", F.col(label).alias("label"),
        F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(f"pred_{m}").alias("prediction"))
                            for m in models])).alias("mp"),
    ).select("mp.model", "split", "row_key", "label", "mp.prediction")


def _c(expr: str) -> str:
    return sig_round_sql(expr, COEF_DIGITS)


BASELINE_SQL = f"""
  fit as (
    select {_c('avg(charge)')} as mean_label,
           {_c('regr_slope(charge, l_extendedprice)')} as p2_slope,
           {_c('regr_intercept(charge, l_extendedprice)')} as p2_intercept,
           {_c('regr_slope(charge, l_extendedprice * (1 - l_discount))')} as p3_slope,
           {_c('regr_intercept(charge, l_extendedprice * (1 - l_discount))')} as p3_intercept,
           {_c('regr_slope(charge, l_quantity)')} as p4_slope, {_c('regr_intercept(charge, l_quantity)')} as p4_intercept
    from lc where split = 'train'),
  preds as (
    select 'p0' as model, split, row_key, charge as label, mean_label as prediction from lc, fit
    union all select 'p1', split, row_key, charge, l_extendedprice from lc, fit
    union all select 'p2', split, row_key, charge, p2_intercept + p2_slope * l_extendedprice from lc, fit
    union all select 'p3', split, row_key, charge, p3_intercept + p3_slope * (l_extendedprice * (1 - l_discount)) from lc, fit
    union all select 'p4', split, row_key, charge, p4_intercept + p4_slope * l_quantity from lc, fit)
"""


# Display names of the baseline predictors.
BASELINE_NAMES = {"p0": "Train Mean", "p1": "Extended Price", "p2": "OLS Price", "p3": "OLS Net Price",
                  "p4": "OLS Quantity"}


def _ols_from_sums(n, sx, sy, sxx, sxy):
    den = n * sxx - sx * sx
    slope = F.coalesce(F.try_divide(n * sxy - sx * sy, F.when(den != 0, den)), F.lit(0.0))
    return slope, (sy - slope * sx) / n


def baseline_cv_predictions(split_df: DataFrame, label: str = "charge", folds: int = 5,
                            salt: str = "fold42") -> DataFrame:
    """K-fold predictions of the baseline predictors on the train rows, all folds in one pass.

    Each fold's model is fitted on the other folds: per-fold sufficient statistics (n, sums of x, y,
    x*x, x*y) come from one ``groupBy(fold)``; the complement of fold f is total minus fold f, so no
    training row is read more than once for fitting. The k coefficient rows are broadcast (k is the
    fold count).
    """
    from tabreg.functions.stats import hash_bucket
    train = split_df.where(F.col("split") == "train").withColumn(
        "fold", hash_bucket(F.col("row_key"), salt, folds))
    return baseline_cv_on_folds(train, label)


def baseline_cv_on_folds(train: DataFrame, label: str = "charge") -> DataFrame:
    """K-fold predictions (a column per predictor) for rows that already carry a ``fold`` column (hash or contiguous folds)."""
    y = F.col(label).cast("double")
    sums = [F.count(F.lit(1)).cast("double").alias("n"), F.sum(y).alias("sy")]
    inputs = ols_inputs()
    for name, x in inputs.items():
        sums += [F.sum(x).alias(f"{name}_sx"), F.sum(x * x).alias(f"{name}_sxx"), F.sum(x * y).alias(f"{name}_sxy")]
    per_fold = train.groupBy("fold").agg(*sums)
    totals = per_fold.groupBy().agg(*[F.sum(c).alias(f"t_{c}") for c in per_fold.columns if c != "fold"])
    comp = per_fold.crossJoin(F.broadcast(totals))
    n = F.col("t_n") - F.col("n")
    sy = F.col("t_sy") - F.col("sy")
    coefs = [sig_round(sy / n, COEF_DIGITS).alias("mean_label")]
    for name in inputs:
        sx = F.col(f"t_{name}_sx") - F.col(f"{name}_sx")
        sxx = F.col(f"t_{name}_sxx") - F.col(f"{name}_sxx")
        sxy = F.col(f"t_{name}_sxy") - F.col(f"{name}_sxy")
        slope, icpt = _ols_from_sums(n, sx, sy, sxx, sxy)
        coefs += [sig_round(slope, COEF_DIGITS).alias(f"{name}_slope"),
                  sig_round(icpt, COEF_DIGITS).alias(f"{name}_intercept")]
    fit = comp.select("fold", *coefs)
    scored = train.join(F.broadcast(fit), "fold")
    cols = {"pred_p0": F.col("mean_label"), "pred_p1": F.col("l_extendedprice")}
    for name, x in inputs.items():
        cols[f"pred_{name}"] = F.col(f"{name}_intercept") + F.col(f"{name}_slope") * x
    return scored.withColumns(cols)


def cv_fold_metrics(scored: DataFrame, label: str = "charge") -> DataFrame:
    """R2, MAE, RMSE per (model, fold), from one aggregation of the scored rows."""
    from tabreg.operators.evaluate import wide_metrics
    return wide_metrics(scored, prediction_columns(), "fold", label)


def cv_summary(fold_metrics: DataFrame, by: str = "model") -> DataFrame:
    """Mean and population std of fold R2, mean MAE and RMSE per model."""
    return fold_metrics.groupBy(by).agg(
        F.avg("r2").alias("cv_r2_mean"), F.stddev_pop("r2").alias("cv_r2_std"),
        F.avg("mae").alias("cv_mae_mean"), F.avg("rmse").alias("cv_rmse_mean"))


def baseline_results(split_df: DataFrame, label: str = "charge") -> DataFrame:
    """Results table of the baseline pool: train/test metrics, gap and CV summary per algorithm."""
    from tabreg.operators.evaluate import sides
    tt = sides(baseline_metrics(split_df, label))
    cv = cv_summary(cv_fold_metrics(baseline_cv_predictions(split_df, label)))
    names = F.create_map(*[x for k, v in BASELINE_NAMES.items() for x in (F.lit(k), F.lit(v))])
    return tt.join(cv, "model").withColumn("algorithm", names[F.col("model")])


def _fold_fit_sql(salt: str = "fold42", folds: int = 5) -> str:
    from tabreg.sources.tables import bucket_sql
    return f"""
  tr as (select *, {bucket_sql('row_key', salt, folds)} as fold from lc where split = 'train'),
  fl as (select distinct fold as f from tr),
  cvfit as (
    select fl.f as fold, {_c('avg(charge)')} as mean_label,
           {_c('regr_slope(charge, l_extendedprice)')} as p2_slope,
           {_c('regr_intercept(charge, l_extendedprice)')} as p2_intercept,
           {_c('regr_slope(charge, l_extendedprice * (1 - l_discount))')} as p3_slope,
           {_c('regr_intercept(charge, l_extendedprice * (1 - l_discount))')} as p3_intercept,
           {_c('regr_slope(charge, l_quantity)')} as p4_slope, {_c('regr_intercept(charge, l_quantity)')} as p4_intercept
    from fl join tr on tr.fold <> fl.f group by fl.f),
  cvp as (
    select 'p0' as model, fold, charge as label, mean_label as prediction from tr join cvfit using (fold)
    union all select 'p1', fold, charge, l_extendedprice from tr join cvfit using (fold)
    union all select 'p2', fold, charge, p2_intercept + p2_slope * l_extendedprice from tr join cvfit using (fold)
    union all select 'p3', fold, charge, p3_intercept + p3_slope * (l_extendedprice * (1 - l_discount))
      from tr join cvfit using (fold)
    union all select 'p4', fold, charge, p4_intercept + p4_slope * l_quantity from tr join cvfit using (fold)),
  cvm as (
    select model, fold, cast(count(*) as bigint) as n, avg(abs(label - prediction)) as mae,
           avg((label - prediction) * (label - prediction)) as mse,
           sqrt(avg((label - prediction) * (label - prediction))) as rmse,
           1 - sum((label - prediction) * (label - prediction)) / nullif(var_pop(label) * count(*), 0) as r2
    from cvp group by model, fold),
  cvs as (
    select model, avg(r2) as cv_r2_mean, stddev_pop(r2) as cv_r2_std, avg(mae) as cv_mae_mean,
           avg(rmse) as cv_rmse_mean from cvm group by model)
"""


CV_SQL = _fold_fit_sql()

RESULTS_SQL = BASELINE_SQL + "," + CV_SQL + """,
  side as (
    select model,
      avg(abs(label - prediction)) filter (where split = 'train') as train_mae,
      avg((label - prediction) * (label - prediction)) filter (where split = 'train') as train_mse,
      1 - sum((label - prediction) * (label - prediction)) filter (where split = 'train')
        / nullif(var_pop(label) filter (where split = 'train') * count(*) filter (where split = 'train'), 0) as train_r2,
      cast(count(*) filter (where split = 'train') as bigint) as train_n,
      avg(abs(label - prediction)) filter (where split = 'test') as mae,
      avg((label - prediction) * (label - prediction)) filter (where split = 'test') as mse,
      1 - sum((label - prediction) * (label - prediction)) filter (where split = 'test')
        / nullif(var_pop(label) filter (where split = 'test') * count(*) filter (where split = 'test'), 0) as r2,
      cast(count(*) filter (where split = 'test') as bigint) as n
    from preds group by model),
  results as (
    select s.model, """ + "case " + " ".join(f"when s.model = '{k}' then '{v}'" for k, v in BASELINE_NAMES.items()) + """ end as algorithm,
      train_mae, train_mse, sqrt(train_mse) as train_rmse, train_r2, train_n, mae, mse, sqrt(mse) as rmse, r2, n,
      train_r2 - r2 as r2_gap, cv_r2_mean, cv_r2_std, cv_mae_mean, cv_rmse_mean
    from side s join cvs using (model))
"""


def baseline_learning_curve(split_df: DataFrame, label: str = "charge", model: str = "p3", folds: int = 5,
                            levels: int = 5, salt: str = "fold42", size_salt: str = "size42") -> DataFrame:
    """Learning curve of one least-squares baseline: for fraction L/levels (L = 1..levels) and fold f, fit
    on the training rows outside fold f whose size level is <= L, then R2 on that subset (train) and on
    fold f (validation); mean and population std over folds per fraction.

    All levels x folds fits come from one ``groupBy(fold, level)`` of sufficient statistics (cumulative
    over levels, complement over folds), and so do the R2 values: the errors of a line follow from the same
    centred sums, so the rows are read once for the means and once for the sums.
    """
    from tabreg.functions.stats import hash_bucket
    x = ols_inputs()[model]
    y = F.col(label).cast("double")
    tr = (split_df.where(F.col("split") == "train")
          .withColumn("fold", hash_bucket(F.col("row_key"), salt, folds))
          .withColumn("level", (F.floor(hash_bucket(F.col("row_key"), size_salt, 1000) * levels / 1000) + 1).cast("int"))
          .withColumn("__x", x).withColumn("__y", y))
    centre = tr.agg(F.avg("__x").alias("__cx"), F.avg("__y").alias("__cy"))  # one row; keeps the sums well conditioned
    tr = (tr.crossJoin(F.broadcast(centre)).withColumn("__x", F.col("__x") - F.col("__cx"))
          .withColumn("__y", F.col("__y") - F.col("__cy")))
    sums6 = ("n", "sx", "sy", "sxx", "sxy", "syy")
    cell = tr.groupBy("fold", "level").agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum("__x").alias("sx"), F.sum("__y").alias("sy"),
        F.sum(F.col("__x") * F.col("__x")).alias("sxx"), F.sum(F.col("__x") * F.col("__y")).alias("sxy"),
        F.sum(F.col("__y") * F.col("__y")).alias("syy"), F.first("__cx").alias("cx"), F.first("__cy").alias("cy"))
    spark = split_df.sparkSession
    grid = spark.createDataFrame([(f, lv) for f in range(folds) for lv in range(1, levels + 1)],
                                 "f int, L int")  # folds x levels rows
    joined = grid.crossJoin(cell)  # a grid of cells: folds x levels squared, whatever the table's size
    own = (F.col("fold") != F.col("f")) & (F.col("level") <= F.col("L"))
    held = F.col("fold") == F.col("f")
    both = joined.groupBy("f", "L").agg(
        *[F.sum(F.when(own, F.col(c))).alias(f"t_{c}") for c in sums6],
        *[F.sum(F.when(held, F.col(c))).alias(f"v_{c}") for c in sums6], F.first("cx").alias("cx"), F.first("cy").alias("cy"))
    slope, icpt = _ols_from_sums(*[F.col(f"t_{c}") for c in sums6[:5]])
    # published coefficients are those of the raw columns, rounded; back to the centred ones for the sums
    raw_icpt = icpt + F.col("cy") - slope * F.col("cx")
    both = both.withColumn("b", sig_round(slope, COEF_DIGITS)).withColumn("a", sig_round(raw_icpt, COEF_DIGITS))
    both = both.withColumn("a", F.col("a") - F.col("cy") + F.col("b") * F.col("cx"))

    def r2(side: str) -> Column:
        n, sx, sy, sxx, sxy, syy = (F.col(f"{side}_{c}") for c in sums6)
        a, b = F.col("a"), F.col("b")
        sse = syy + n * a * a + b * b * sxx - 2 * a * sy - 2 * b * sxy + 2 * a * b * sx
        sst = syy - sy * sy / n
        return F.when(sst > 0, 1 - sse / sst)

    per = both.select("L", "f", F.explode(F.array(
        F.struct(F.lit("train").alias("role"), r2("t").alias("r2"), F.col("t_n").alias("n")),
        F.struct(F.lit("validation").alias("role"), r2("v").alias("r2"), F.col("v_n").alias("n")))).alias("x")).select("L", "f", "x.*")
    return per.groupBy(F.col("L").alias("level")).agg(
        F.first(F.col("L") / F.lit(float(levels))).alias("fraction"),
        F.avg(F.when(F.col("role") == "train", F.col("n"))).alias("n_train_mean"),
        F.avg(F.when(F.col("role") == "train", F.col("r2"))).alias("train_r2_mean"),
        F.stddev_pop(F.when(F.col("role") == "train", F.col("r2"))).alias("train_r2_std"),
        F.avg(F.when(F.col("role") == "validation", F.col("r2"))).alias("validation_r2_mean"),
        F.stddev_pop(F.when(F.col("role") == "validation", F.col("r2"))).alias("validation_r2_std"))
