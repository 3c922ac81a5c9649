"""Registered queries: results table of the baseline pool, CV, min-max scoring, rank, bands, tiers,
reshapes and top-k (SURVEY §2.4 cv_summary, §2.5, §2.6, §2.8, §2.10 cross_validate/select_winner)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabreg.functions.bands import (band_generalisation_sql, band_stability_sql, complexity_sql)
from tabreg.operators import rank as R
from tabreg.operators.baselines import (BASELINE_NAMES, CV_SQL, OLS_NAMES, RESULTS_SQL, baseline_cv_predictions,
                                        baseline_results, cv_fold_metrics, cv_summary, fit_simple_ols)
from tabreg.operators.reshape import melt, pivot_long
from tabreg.plans.registry import query, r6, rounded
from tabreg.sources.tables import LINE_SPLIT_SQL, line_charge_split

LC = f"with lc as ({LINE_SPLIT_SQL}),"
NUM_COLS = ["train_mae", "train_mse", "train_rmse", "train_r2", "mae", "mse", "rmse", "r2", "r2_gap",
            "cv_r2_mean", "cv_r2_std", "cv_mae_mean", "cv_rmse_mean"]
RES_R = LC + RESULTS_SQL + ", rr as (select model, algorithm, train_n, n, " + ", ".join(
    f"{r6(c)} as {c}" for c in NUM_COLS) + " from results)"


def results_r(spark, sf_dir):
    """Baseline results table with doubles at 9 significant digits (the ranking input)."""
    return rounded(baseline_results(line_charge_split(spark, sf_dir)))


def _norm_sql(col, benefit):
    span = f"(max({col}) over () - min({col}) over ())"
    scaled = f"(({col} - min({col}) over ()) / {span})"
    return f"(case when {span} = 0 then 1.0 else {scaled if benefit else '1.0 - ' + scaled} end)"


SCORE_SQL = RES_R + ", sc as (select *, 100.0 * (" + " + ".join(
    f"{w!r} * {_norm_sql('abs(r2_gap)' if m == 'abs_r2_gap' else m, kind == 'benefit')}"
    for m, (w, kind) in R.SCORE_WEIGHTS.items()) + ") as deployment_score from rr)"
RANK_SQL = SCORE_SQL + """, rk as (select *, cast(row_number() over (order by deployment_score desc, r2 desc, rmse asc,
                                              algorithm asc) as integer) as deployment_rank from sc)"""


def ranked(spark, sf_dir):
    return R.rank_models(results_r(spark, sf_dir))


@query("simple_ols_sql", sql=LC + """
  fit as (select """ + ", ".join(
    f"regr_slope(charge, {x}) as {m}_s, regr_intercept(charge, {x}) as {m}_i"
    for m, x in (("p2", "l_extendedprice"), ("p3", "l_extendedprice * (1 - l_discount)"),
                 ("p4", "l_quantity"))) + """, avg(charge) as mean_label from lc where split = 'train')
  select 'p2' as model, """ + r6("p2_s") + " as slope, " + r6("p2_i") + """ as intercept from fit
  union all select 'p3', """ + r6("p3_s") + ", " + r6("p3_i") + """ from fit
  union all select 'p4', """ + r6("p4_s") + ", " + r6("p4_i") + " from fit")
def q_simple_ols_sql(spark, sf_dir):
    """One-feature least squares fitted on train rows by regr_slope/regr_intercept (one aggregation)."""
    lc = line_charge_split(spark, sf_dir)
    from tabreg.operators.baselines import ols_inputs
    fit = fit_simple_ols(lc.where(F.col("split") == "train"), "charge", ols_inputs())
    return fit.select(F.explode(F.array(*[
        F.struct(F.lit(m).alias("model"), F.col(f"{m}_slope").alias("slope"), F.col(f"{m}_intercept").alias("intercept"))
        for m in OLS_NAMES])).alias("kv")).select("kv.*")


@query("kfold_assign", sql=LC + CV_SQL.split("fl as")[0].rstrip().rstrip(",") + """
  select cast(fold as integer) as fold, cast(count(*) as bigint) as n_rows from tr group by fold""")
def q_kfold_assign(spark, sf_dir):
    """Shuffled 5-fold assignment of train rows by key hash: rows per fold."""
    from tabreg.functions.stats import hash_bucket
    lc = line_charge_split(spark, sf_dir).where(F.col("split") == "train")
    return (lc.withColumn("fold", hash_bucket(F.col("row_key"), "fold42", 5)).groupBy("fold")
            .agg(F.count(F.lit(1)).cast("bigint").alias("n_rows")))


@query("cross_validate", sql=LC + CV_SQL.rstrip().rstrip(",") + """
  select model, cast(fold as integer) as fold, n, """ + ", ".join(
    f"{r6(c)} as {c}" for c in ("mae", "mse", "rmse", "r2")) + " from cvm")
def q_cross_validate(spark, sf_dir):
    """5-fold CV of the baseline pool on train rows: all folds fitted in one pass (complement sums)."""
    lc = line_charge_split(spark, sf_dir)
    return rounded(cv_fold_metrics(baseline_cv_predictions(lc)))


@query("cv_summary", sql=LC + CV_SQL.rstrip().rstrip(",") + """
  select model, """ + ", ".join(f"{r6(c)} as {c}" for c in ("cv_r2_mean", "cv_r2_std", "cv_mae_mean", "cv_rmse_mean"))
       + " from cvs")
def q_cv_summary(spark, sf_dir):
    """Mean and population std of fold R2, mean fold MAE and RMSE per baseline model."""
    lc = line_charge_split(spark, sf_dir)
    return rounded(cv_summary(cv_fold_metrics(baseline_cv_predictions(lc))))


@query("train_all", sql=RES_R + " select * from rr")
def q_train_all(spark, sf_dir):
    """Results table of the SQL-expressible pool: train/test metrics, gap, CV summary per algorithm."""
    return results_r(spark, sf_dir)


@query("minmax_benefit", sql=RES_R + f" select algorithm, r2, {r6(_norm_sql('r2', True))} as r2_norm from rr")
def q_minmax_benefit(spark, sf_dir):
    """Benefit min-max scaling of test R2 across the pool (1.0 when all equal)."""
    return rounded(R.minmax_scaled(results_r(spark, sf_dir), "r2", "r2_norm", True).select("algorithm", "r2", "r2_norm"))


@query("minmax_cost", sql=RES_R + f" select algorithm, rmse, {r6(_norm_sql('rmse', False))} as rmse_norm from rr")
def q_minmax_cost(spark, sf_dir):
    """Cost min-max scaling of test RMSE across the pool (1.0 when all equal)."""
    return rounded(R.minmax_scaled(results_r(spark, sf_dir), "rmse", "rmse_norm", False)
                   .select("algorithm", "rmse", "rmse_norm"))


@query("deployment_score", sql=SCORE_SQL + f" select algorithm, {r6('deployment_score')} as deployment_score from sc")
def q_deployment_score(spark, sf_dir):
    """Weighted min-max deployment score (0-100) of every algorithm in the pool."""
    return rounded(R.deployment_score(results_r(spark, sf_dir)).select("algorithm", "deployment_score"))


@query("deployment_rank", sql=RANK_SQL + f"""
  select deployment_rank, algorithm, {r6('deployment_score')} as deployment_score, r2, rmse,
         {band_generalisation_sql('r2_gap')} as generalisation, {band_stability_sql('cv_r2_std')} as stability,
         {complexity_sql('algorithm')} as complexity
  from rk""")
def q_deployment_rank(spark, sf_dir):
    """Rank 1..n by score, R2, RMSE, name; with generalisation, stability and complexity labels."""
    return rounded(ranked(spark, sf_dir).select("deployment_rank", "algorithm", "deployment_score", "r2", "rmse",
                                               "generalisation", "stability", "complexity"))


@query("band_generalisation", sql=RES_R + f" select algorithm, r2_gap, {band_generalisation_sql('r2_gap')} as generalisation from rr")
def q_band_generalisation(spark, sf_dir):
    """Generalisation band of the train-test R2 gap per algorithm."""
    from tabreg.functions.bands import band_generalisation
    return results_r(spark, sf_dir).select("algorithm", "r2_gap",
                                           band_generalisation(F.col("r2_gap")).alias("generalisation"))


@query("band_stability", sql=RES_R + f" select algorithm, cv_r2_std, {band_stability_sql('cv_r2_std')} as stability from rr")
def q_band_stability(spark, sf_dir):
    """Stability band of the CV R2 standard deviation per algorithm."""
    from tabreg.functions.bands import band_stability
    return results_r(spark, sf_dir).select("algorithm", "cv_r2_std", band_stability(F.col("cv_r2_std")).alias("stability"))


@query("evidence_tier", sql=SCORE_SQL + """
  select algorithm,
    case when r2 >= max(r2) over () - 0.001 then 'leader' when r2 >= 0.98 then 'strong' else 'lower' end as tier,
    (case when r2 >= max(r2) over () - 0.001 then 'Top-tier: ' when r2 >= 0.98 then 'Strong but below leaders: '
          else 'Lower fit: ' end)
    || printf('R²=%.4f, RMSE=%.4f, MAE=%.4f.', r2, rmse, mae) || printf(' Train-test gap=%.4f, ', abs(r2_gap))
    || (case when abs(r2_gap) > 0.02 then 'suggesting possible overfitting.' else 'indicating good generalisation.' end)
    || printf(' CV R²=%.4f.', cv_r2_mean) || printf(' Deployment score=%.2f/100.', deployment_score) as evidence
  from sc""")
def q_evidence_tier(spark, sf_dir):
    """Leader / strong / lower tier against the best R2, with the evidence sentence."""
    return R.evidence_tier(R.deployment_score(results_r(spark, sf_dir))).select("algorithm", "tier", "evidence")


_MELT = ("r2", "rmse", "mae")


@query("melt_metrics", sql=RES_R + " select * from (" + " union all ".join(
    f"select algorithm, '{m}' as metric, {m} as value from rr" for m in _MELT) + ")")
def q_melt_metrics(spark, sf_dir):
    """Results table unpivoted to (algorithm, metric, value) for R2, RMSE and MAE."""
    return melt(results_r(spark, sf_dir), ["algorithm"], list(_MELT))


@query("pivot_metrics", sql=RES_R + " select algorithm, mae, r2, rmse from rr")
def q_pivot_metrics(spark, sf_dir):
    """Long metrics pivoted back to one column per metric (known metric list, no extra pass)."""
    long = melt(results_r(spark, sf_dir), ["algorithm"], list(_MELT))
    return pivot_long(long, ["algorithm"], "metric", "value", list(_MELT))


@query("top_models", sql=RANK_SQL + f" select deployment_rank, algorithm, {r6('deployment_score')} as deployment_score "
       "from rk where deployment_rank <= 3")
def q_top_models(spark, sf_dir):
    """Best three algorithms by deployment rank (top-k)."""
    r = ranked(spark, sf_dir)
    return rounded(R.top_k(r, [F.col("deployment_rank")], 3).select("deployment_rank", "algorithm", "deployment_score"))


@query("sort_multi", sql=SCORE_SQL + f" select algorithm, {r6('deployment_score')} as deployment_score, r2, rmse from sc")
def q_sort_multi(spark, sf_dir):
    """Results ordered by score desc, R2 desc, RMSE asc (mixed directions, name last)."""
    s = R.deployment_score(results_r(spark, sf_dir))
    return rounded(s.orderBy(F.col("deployment_score").desc(), F.col("r2").desc(), F.col("rmse").asc(), "algorithm")
                   .select("algorithm", "deployment_score", "r2", "rmse"))


_ORDER_METRICS = ["r2", "rmse", "mae", "cv_r2_mean", "cv_r2_std", "abs_r2_gap"]


@query("metric_orders", sql=RES_R + " select * from (" + " union all ".join(
    f"select algorithm, '{m}' as metric, {r6('abs(r2_gap)') if m == 'abs_r2_gap' else m} as value, "
    f"cast(row_number() over (order by {'abs(r2_gap)' if m == 'abs_r2_gap' else m} "
    f"{'desc' if R.METRIC_DIRECTION[m] else 'asc'} nulls last, algorithm) as integer) as position from rr"
    for m in _ORDER_METRICS) + ")")
def q_metric_orders(spark, sf_dir):
    """Per-metric orderings of the pool (best first by each metric's direction)."""
    return rounded(R.metric_orders(results_r(spark, sf_dir), _ORDER_METRICS))


@query("select_winner", sql=RANK_SQL + f"""
  select algorithm, {r6('deployment_score')} as deployment_score, r2, rmse, mae, cv_r2_mean,
    printf('%s ranked first with deployment score %.2f/100 (test R2 %.4f, RMSE %.4f, CV R2 %.4f).',
           algorithm, deployment_score, r2, rmse, cv_r2_mean) as justification
  from rk where deployment_rank = 1""")
def q_select_winner(spark, sf_dir):
    """Winner row (rank 1) with its justification text."""
    from tabreg.operators.models import winner_row
    return rounded(winner_row(ranked(spark, sf_dir)))


@query("name_contains", sql=RANK_SQL + """
  select algorithm, deployment_rank from rk
  order by case when lower(algorithm) like '%ols%' then 1 else 0 end desc, deployment_rank limit 1""")
def q_name_contains(spark, sf_dir):
    """First ranked algorithm whose name contains 'ols' (case-insensitive), else the best one."""
    r = ranked(spark, sf_dir)
    return R.name_contains(r, "algorithm", "ols", [F.col("deployment_rank")]).select("algorithm", "deployment_rank")


@query("report_comparison", sql=RANK_SQL + """
  select deployment_rank, algorithm, replace(printf('%.4f', train_r2), '-0.0000', '0.0000') as train_r2, printf('%.4f', r2) as r2,
         printf('%.4f', rmse) as rmse, printf('%.4f', mae) as mae, printf('%.4f', cv_r2_mean) as cv_r2_mean,
         printf('%.4f', cv_r2_std) as cv_r2_std, replace(printf('%.4f', r2_gap), '-0.0000', '0.0000') as r2_gap,
         printf('%.2f', deployment_score) as deployment_score
  from rk""")
def q_report_comparison(spark, sf_dir):
    """Comparison report table: preferred visible columns, 4-dp metrics, 2-dp score."""
    from tabreg.operators.report import comparison_table
    return comparison_table(ranked(spark, sf_dir))


def _lc_sql():
    from tabreg.sources.tables import bucket_sql
    from tabreg.operators.baselines import _c
    x = "l_extendedprice * (1 - l_discount)"
    return LC + f"""
  tr as (select *, {bucket_sql('row_key', 'fold42', 5)} as fold,
                cast(floor({bucket_sql('row_key', 'size42', 1000)} * 5 / 1000) + 1 as integer) as level,
                {x} as x, charge as y from lc where split = 'train'),
  grid as (select f, l from range(5) a(f), range(1, 6) b(l)),
  co as (select g.f, g.l, {_c('regr_slope(y, x)')} as b, {_c('regr_intercept(y, x)')} as a
         from grid g join tr on tr.fold <> g.f and tr.level <= g.l group by g.f, g.l),
  sc as (select co.l, co.f, case when tr.fold = co.f then 'validation' else 'train' end as role, tr.y,
                co.a + co.b * tr.x as p
         from tr join co on tr.fold = co.f or (tr.fold <> co.f and tr.level <= co.l)),
  per as (select l, f, role, 1 - sum((y - p) * (y - p)) / nullif(var_pop(y) * count(*), 0) as r2, count(*) as n
          from sc group by l, f, role)
  select cast(l as integer) as level, {r6('l / 5.0')} as fraction,
    {r6("avg(n) filter (where role = 'train')")} as n_train_mean,
    {r6("avg(r2) filter (where role = 'train')")} as train_r2_mean,
    {r6("stddev_pop(r2) filter (where role = 'train')")} as train_r2_std,
    {r6("avg(r2) filter (where role = 'validation')")} as validation_r2_mean,
    {r6("stddev_pop(r2) filter (where role = 'validation')")} as validation_r2_std
  from per group by l"""


@query("learning_curve_sql", sql=_lc_sql())
def q_learning_curve_sql(spark, sf_dir):
    """Learning curve (20..100 % x 5 folds) of the least-squares member p3, all fits in one pass."""
    from tabreg.operators.baselines import baseline_learning_curve
    return rounded(baseline_learning_curve(line_charge_split(spark, sf_dir)))


@query("cross_validate_contiguous", sql=LC + """
  tr as (select *, cast(case when rk < (n % 5) * (n // 5 + 1) then rk // (n // 5 + 1)
                        else n % 5 + (rk - (n % 5) * (n // 5 + 1)) // (n // 5) end as integer) as fold
         from (select *, row_number() over (order by row_key) - 1 as rk, count(*) over () as n from lc)),
""" + CV_SQL.split("fl as", 1)[1].join(["  fl as", ""]).rstrip().rstrip(",") + """
  select model, cast(fold as integer) as fold, n, """ + ", ".join(
    f"{r6(c)} as {c}" for c in ("mae", "mse", "rmse", "r2")) + " from cvm")
def q_cross_validate_contiguous(spark, sf_dir):
    """Unshuffled 5-fold CV over ALL rows in key order (the evaluation-time CV mode), baseline pool."""
    from tabreg.operators.baselines import baseline_cv_on_folds
    from tabreg.operators.split import kfold_contiguous
    lc = kfold_contiguous(line_charge_split(spark, sf_dir), ["row_key"], 5)
    return rounded(cv_fold_metrics(baseline_cv_on_folds(lc)))
