"""Registered queries: baseline predictors, metrics, residuals and ranking inputs on line_charge."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabreg.operators.baselines import BASELINE_SQL, baseline_metrics, baseline_predictions
from tabreg.operators.evaluate import identity_line, qq_points, residual_summary, residual_table, sides
from tabreg.plans.registry import query, r6, rounded
from tabreg.sources.tables import LINE_SPLIT_SQL, line_charge_split

LC_CTE = f"with lc as ({LINE_SPLIT_SQL}),"


def baseline_preds(spark, sf_dir, models=None):
    return baseline_predictions(line_charge_split(spark, sf_dir), models=models)


@query("regression_metrics", sql=LC_CTE + BASELINE_SQL + f"""
  select model, split, cast(count(*) as bigint) as n,
         {r6('avg(abs(label - prediction))')} as mae,
         {r6('avg((label - prediction) * (label - prediction))')} as mse,
         {r6('sqrt(avg((label - prediction) * (label - prediction)))')} as rmse,
         {r6('1 - sum((label - prediction) * (label - prediction)) / nullif(var_pop(label) * count(*), 0)')} as r2
  from preds group by model, split
""")
def q_regression_metrics(spark, sf_dir):
    """Five baseline predictors fitted on the hash-split train rows; MAE/MSE/RMSE/R2 per model and side."""
    return rounded(baseline_metrics(line_charge_split(spark, sf_dir)))


@query("train_test_metrics", sql=LC_CTE + BASELINE_SQL + """,
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
    from preds group by model)
  select model, """ + ", ".join([
    f"{r6('train_mae')} as train_mae", f"{r6('train_mse')} as train_mse", f"{r6('sqrt(train_mse)')} as train_rmse",
    f"{r6('train_r2')} as train_r2", "train_n", f"{r6('mae')} as mae", f"{r6('mse')} as mse",
    f"{r6('sqrt(mse)')} as rmse", f"{r6('r2')} as r2", "n", f"{r6('train_r2 - r2')} as r2_gap"]) + " from side")
def q_train_test_metrics(spark, sf_dir):
    """One wide row per baseline model: train and test metrics and the train-test R2 gap (results table)."""
    return rounded(sides(baseline_metrics(line_charge_split(spark, sf_dir))))


@query("residual_table", sql=LC_CTE + BASELINE_SQL + f"""
  select row_key, {r6('label')} as actual, {r6('prediction')} as predicted,
         {r6('label - prediction')} as residual, {r6('abs(label - prediction)')} as absolute_error,
         {r6('(label - prediction) * (label - prediction)')} as squared_error
  from preds where model = 'p3' and split = 'test'
""")
def q_residual_table(spark, sf_dir):
    """Residual table of the best baseline (p3) on the test rows."""
    p = baseline_preds(spark, sf_dir, ["p3"]).where(F.col("split") == "test")
    return rounded(residual_table(p, "row_key"))


@query("residual_summary", sql=LC_CTE + BASELINE_SQL + f"""
  select model, cast(count(*) as bigint) as n, {r6('avg(label - prediction)')} as mean_residual,
         {r6('stddev_samp(label - prediction)')} as std_residual,
         {r6('skewness(label - prediction)')} as skew_residual,
         {r6('kurtosis(label - prediction)')} as kurtosis_residual,
         {r6('avg(abs(label - prediction))')} as mae,
         {r6('sqrt(avg((label - prediction) * (label - prediction)))')} as rmse
  from preds where split = 'test' group by model
""")
def q_residual_summary(spark, sf_dir):
    """Residual shape per baseline model on test rows: mean, sample std, corrected skew and kurtosis."""
    p = baseline_preds(spark, sf_dir).where(F.col("split") == "test")
    return rounded(residual_summary(p, by=["model"]))


@query("identity_line", sql=LC_CTE + BASELINE_SQL + f"""
  select {r6('least(min(label), min(prediction))')} as line_min,
         {r6('greatest(max(label), max(prediction))')} as line_max
  from preds where model = 'p3' and split = 'test'
""")
def q_identity_line(spark, sf_dir):
    """End points of the actual-vs-predicted reference line for p3 on test rows."""
    p = baseline_preds(spark, sf_dir, ["p3"]).where(F.col("split") == "test")
    return rounded(identity_line(p))


def _qq_sql():
    from tabreg.functions.stats import inverse_normal_sql
    probs = ", ".join(repr(i / 21) for i in range(1, 21))
    return LC_CTE + BASELINE_SQL + f""",
  res as (select label - prediction as r from preds where model = 'p3' and split = 'test'),
  q as (select quantile_cont(r, [{probs}]) as qs from res),
  grid as (select i, i / 21.0 as p, qs[i] as s from range(1, 21) t(i), q)
  select cast(i as integer) as i, {r6('p')} as p, {r6(inverse_normal_sql('p'))} as theoretical,
         {r6('s')} as sample
  from grid
"""


@query("qq_points", sql=_qq_sql())
def q_qq_points(spark, sf_dir):
    """Normal Q-Q points (20 grid quantiles) of p3 test residuals, exact sample quantiles."""
    p = baseline_preds(spark, sf_dir, ["p3"]).where(F.col("split") == "test")
    return rounded(qq_points(p, n_points=20))
