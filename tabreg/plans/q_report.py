"""Registered queries: report tables composed from the operators, stat transposition,
threshold filters, importance shares and the value x weight explanation fallback."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabreg.functions.bands import band_target_shape_sql
from tabreg.operators import profile as P
from tabreg.operators import report as RP
from tabreg.operators.baselines import baseline_predictions
from tabreg.operators.evaluate import train_test_metrics
from tabreg.operators.explain import local_fallback
from tabreg.operators.rank import importance_share
from tabreg.operators.reshape import transpose
from tabreg.plans.q_profile import DOC_LABELS_SQL, doc_labels
from tabreg.plans.q_rank import RANK_SQL, ranked
from tabreg.plans.registry import query, r6, rounded
from tabreg.sources.tables import LINE_CHARGE_SQL, LINE_SPLIT_SQL, NUMERIC_FEATURES, line_charge, line_charge_split, load
from tabreg.operators.baselines import BASELINE_SQL

LC = f"({LINE_CHARGE_SQL})"
LC_ALL = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber", "l_returnflag", "l_linestatus",
          "charge"]


@query("report_data_understanding", sql=f"""
  with lc as {LC},
  d as (select coalesce(sum(c - 1), 0) as dups from (select count(*) as c from lc group by {', '.join(LC_ALL)}))
  select 'n_rows' as fact, cast((select count(*) from lc) as varchar) as value
  union all select 'n_columns', '9'
  union all select 'target', 'charge'
  union all select 'duplicate_rows', cast((select dups from d) as varchar)
  union all select 'missing_total', cast((select {' + '.join(f'count(*) - count({c})' for c in ['row_key', *LC_ALL])}
                                         from lc) as varchar)""")
def q_report_data_understanding(spark, sf_dir):
    """Overview facts of line_charge: rows, columns, target, duplicates (key excluded), total missing."""
    return RP.data_understanding(line_charge(spark, sf_dir), "charge", exclude_from_duplicates=["row_key"])


_LC_NUM = [*NUMERIC_FEATURES, "charge"]


def _understanding_sql():
    parts = []
    for c in ["row_key", *LC_ALL]:
        kind = "max('object')" if c in ("row_key", "l_returnflag", "l_linestatus") else (
            "case when count(*) > count(l_linenumber) then 'float64' else 'int64' end" if c == "l_linenumber" else "max('float64')")
        parts += [f"select '{c}' as column, 'data_type' as fact, {kind} as value from {LC}",
                  f"select '{c}', 'missing', cast(count(*) - count({c}) as varchar) from {LC}",
                  f"select '{c}', 'unique', cast(count(distinct {c}) as varchar) from {LC}",
                  f"select '{c}', 'unique_with_null', cast(count(distinct {c}) + max(case when {c} is null then 1 else 0 end) as varchar) from {LC}"]
    for c in _LC_NUM:
        parts.append(f"select '{c}', 'count', cast(count({c}) as varchar) from {LC}")
        for f, e in (("mean", "avg({c})"), ("std", "stddev_samp({c})"), ("min", "min({c})"), ("q25", "quantile_cont({c}, 0.25)"),
                     ("q50", "quantile_cont({c}, 0.5)"), ("q75", "quantile_cont({c}, 0.75)"), ("max", "max({c})")):
            parts.append(f"select '{c}', '{f}', printf('%.6f', ({e.format(c=c)})::double + 0.0) from {LC}")
    return " union all ".join(parts)


@query("report_columns", sql=_understanding_sql())
def q_report_columns(spark, sf_dir):
    """The per-column part of the data-understanding report: column summary and describe()."""
    lc = line_charge(spark, sf_dir)
    return RP.data_understanding_columns(lc, _LC_NUM)


def _eda_sql():
    parts = []
    for c in NUMERIC_FEATURES:
        parts.append(f"select 'correlation' as section, '{c}' as column, "
                     f"{r6(f'case when stddev_pop({c}) = 0 or stddev_pop(charge) = 0 then null else corr({c}, charge) end')}"
                     f" as value from {LC}")
    for c in _LC_NUM:
        parts.append(f"select 'skewness', '{c}', {r6(f'skewness({c})')} from {LC}")
        parts.append(f"""select 'outlier_count', '{c}', cast(count(*) filter (where {c} < q1 - 1.5 * (q3 - q1)
                         or {c} > q3 + 1.5 * (q3 - q1)) as double)
                         from {LC}, (select quantile_cont({c}, 0.25) as q1, quantile_cont({c}, 0.75) as q3 from {LC}) q""")
    return " union all ".join(parts)


@query("report_eda", sql=_eda_sql())
def q_report_eda(spark, sf_dir):
    """EDA summary: target correlations, skew and IQR outlier counts in one long table."""
    return rounded(RP.eda_summary(line_charge(spark, sf_dir), "charge", NUMERIC_FEATURES))


_EVAL = ["train_mae", "train_rmse", "train_r2", "mae", "mse", "rmse", "r2", "r2_gap"]


@query("report_evaluation", sql=f"with lc as ({LINE_SPLIT_SQL})," + BASELINE_SQL + """,
  m as (select
      avg(abs(label - prediction)) filter (where split = 'train') as train_mae,
      sqrt(avg((label - prediction) * (label - prediction)) filter (where split = 'train')) as train_rmse,
      1 - sum((label - prediction) * (label - prediction)) filter (where split = 'train')
        / (var_pop(label) filter (where split = 'train') * count(*) filter (where split = 'train')) as train_r2,
      avg(abs(label - prediction)) filter (where split = 'test') as mae,
      avg((label - prediction) * (label - prediction)) filter (where split = 'test') as mse,
      sqrt(avg((label - prediction) * (label - prediction)) filter (where split = 'test')) as rmse,
      1 - sum((label - prediction) * (label - prediction)) filter (where split = 'test')
        / (var_pop(label) filter (where split = 'test') * count(*) filter (where split = 'test')) as r2
    from preds where model = 'p3')
  select * from (""" + " union all ".join(
    f"select '{m}' as metric, printf('%.4f', {r6('train_r2 - r2' if m == 'r2_gap' else m)}) as value from m" for m in _EVAL)
    + ")")
def q_report_evaluation(spark, sf_dir):
    """Evaluation report of the selected baseline (p3): metric name and 4-dp value."""
    p = baseline_predictions(line_charge_split(spark, sf_dir), models=["p3"])
    m = rounded(train_test_metrics(p))
    return RP.evaluation_table(m, _EVAL)


@query("report_final", sql=RANK_SQL + f""",
  lc2 as {LC}
  select 'fact' as section, 'n_rows' as item, cast((select count(*) from lc2) as varchar) as value
  union all select 'fact', 'n_columns', '9'
  union all select 'fact', 'target', 'charge'
  union all select 'fact', 'duplicate_rows', cast((select coalesce(sum(c - 1), 0) from
            (select count(*) as c from lc2 group by {', '.join(LC_ALL)})) as varchar)
  union all select 'fact', 'missing_total', cast((select {' + '.join(f'count(*) - count({c})' for c in ['row_key', *LC_ALL])}
                                         from lc2) as varchar)
  union all select 'metric', 'r2', printf('%.4f', r2) from rk where deployment_rank = 1
  union all select 'metric', 'rmse', printf('%.4f', rmse) from rk where deployment_rank = 1
  union all select 'metric', 'mae', printf('%.4f', mae) from rk where deployment_rank = 1
  union all select 'metric', 'cv_r2_mean', printf('%.4f', cv_r2_mean) from rk where deployment_rank = 1
  union all select 'metric', 'cv_r2_std', printf('%.4f', cv_r2_std) from rk where deployment_rank = 1
  union all select 'top_model', cast(deployment_rank as varchar), algorithm from rk where deployment_rank <= 5
  union all select 'winner', algorithm, printf('%.2f', {r6('deployment_score')}) from rk where deployment_rank = 1""")
def q_report_final(spark, sf_dir):
    """Final report: table facts, winner's metrics, top five ranked algorithms, winner with score."""
    r = rounded(ranked(spark, sf_dir))
    facts = RP.final_facts(line_charge(spark, sf_dir), "charge", r.where(F.col("deployment_rank") == 1), ["row_key"])
    top = r.where(F.col("deployment_rank") <= 5).select(F.lit("top_model").alias("section"),
                                                        F.col("deployment_rank").cast("string").alias("item"),
                                                        F.col("algorithm").alias("value"))
    win = r.where(F.col("deployment_rank") == 1).select(F.lit("winner").alias("section"), F.col("algorithm").alias("item"),
                                                        F.format_string("%.2f", "deployment_score").alias("value"))
    return facts.unionByName(top).unionByName(win)


def _findings_sql():
    parts = []
    for c in NUMERIC_FEATURES:
        r = r6(f"case when stddev_pop({c}) = 0 or stddev_pop(charge) = 0 then null else corr({c}, charge) end")
        parts.append(f"""select case when {r} >= 0.6 then 'strong positive correlation'
                                    when {r} <= -0.6 then 'strong negative correlation'
                                    when abs({r}) >= 0.3 and abs({r}) < 0.6 then 'moderate correlation' end as finding,
                                '{c}' as subject, printf('%.4f', {r}) as value from {LC}""")
    for c in _LC_NUM:
        parts.append(f"""select 'outliers', '{c}', cast(count(*) filter (where {c} < q1 - 1.5 * (q3 - q1)
                         or {c} > q3 + 1.5 * (q3 - q1)) as varchar)
                         from {LC}, (select quantile_cont({c}, 0.25) as q1, quantile_cont({c}, 0.75) as q3 from {LC}) q
                         having count(*) filter (where {c} < q1 - 1.5 * (q3 - q1) or {c} > q3 + 1.5 * (q3 - q1)) > 0""")
        parts.append(f"select 'highly skewed', '{c}', printf('%.4f', {r6(f'skewness({c})')}) from {LC} "
                     f"having abs(skewness({c})) > 1.0")
    parts.append(f"select 'target shape', 'charge', {band_target_shape_sql(r6('skewness(charge)'))} from {LC}")
    return "select * from (" + " union all ".join(parts) + ") where finding is not null"


@query("report_findings", sql=_findings_sql())
def q_report_findings(spark, sf_dir):
    """Findings rows: correlation strength, outliers, high skew, target shape (no missing values here)."""
    lc = rounded(line_charge(spark, sf_dir).select(*_LC_NUM))
    return RP.findings(lc, "charge", NUMERIC_FEATURES)


_DL_NUM = ["doc_id", "n_chars", "quality", "toxic"]


def _threshold_sql():
    parts = []
    for c in _DL_NUM:
        parts.append(f"select 'missing > 0' as rule, '{c}' as column, cast(count(*) - count({c}) as double) as value "
                     f"from {DOC_LABELS_SQL} having count(*) - count({c}) > 0")
        parts.append(f"""select 'outliers > 0', '{c}', cast(count(*) filter (where {c} < q1 - 1.5 * (q3 - q1)
                         or {c} > q3 + 1.5 * (q3 - q1)) as double) from {DOC_LABELS_SQL},
                         (select quantile_cont({c}, 0.25) as q1, quantile_cont({c}, 0.75) as q3 from {DOC_LABELS_SQL}) q
                         having count(*) filter (where {c} < q1 - 1.5 * (q3 - q1) or {c} > q3 + 1.5 * (q3 - q1)) > 0""")
        parts.append(f"select 'abs skew > 1', '{c}', {r6(f'skewness({c})')} from {DOC_LABELS_SQL} "
                     f"having abs(skewness({c})) > 1.0")
    return " union all ".join(parts)


@query("threshold_filters", sql=_threshold_sql())
def q_threshold_filters(spark, sf_dir):
    """Columns of documents+labels with missing values, IQR outliers, or |skew| > 1."""
    return rounded(RP.threshold_filters(doc_labels(spark, sf_dir), _DL_NUM))


_EV = ["event_id", "user_id", "value"]
_STATS = ["count", "mean", "std", "min", "q25", "q50", "q75", "max"]


def _transpose_sql():
    def expr(stat, c):
        return {"count": f"count({c})", "mean": f"avg({c})", "std": f"stddev_samp({c})", "min": f"min({c})",
                "q25": f"quantile_cont({c}, 0.25)", "q50": f"quantile_cont({c}, 0.5)",
                "q75": f"quantile_cont({c}, 0.75)", "max": f"max({c})"}[stat]
    return " union all ".join(
        f"select '{s}' as stat, " + ", ".join(f"{r6(expr(s, c))} as {c}" for c in _EV) + " from events" for s in _STATS)


@query("transpose_stats", sql=_transpose_sql())
def q_transpose_stats(spark, sf_dir):
    """describe() of events transposed: one row per statistic, one column per numeric column."""
    d = P.describe_numeric(load(spark, sf_dir, "events"), _EV).withColumn("count", F.col("count").cast("double"))
    return rounded(transpose(d, "column", _EV, _STATS))


_W_SQL = " union all ".join(
    f"select '{c}' as feature, {r6(f'abs(case when stddev_pop({c}) = 0 or stddev_pop(charge) = 0 then null else corr({c}, charge) end)')}"
    f" as importance from ({LINE_SPLIT_SQL}) where split = 'train'" for c in NUMERIC_FEATURES)


@query("importance_share", sql=f"""
  select feature, importance, {r6('case when sum(importance) over () > 0 then importance / sum(importance) over () * 100 else 0.0 end')}
         as share from ({_W_SQL})""")
def q_importance_share(spark, sf_dir):
    """Percentage share of each feature's importance (|r| with the target on train rows)."""
    tr = line_charge_split(spark, sf_dir).where(F.col("split") == "train")
    ct = rounded(P.corr_target(tr, "charge", NUMERIC_FEATURES)).select(F.col("column").alias("feature"),
                                                                       F.col("abs_r").alias("importance"))
    return rounded(importance_share(ct, "importance"))


@query("local_fallback", sql=f"""
  with w as ({_W_SQL}),
  t as (select * from ({LINE_SPLIT_SQL}) where split = 'test'),
  l as (""" + " union all ".join(f"select row_key, '{c}' as feature, cast({c} as double) as value from t"
                                 for c in NUMERIC_FEATURES) + f"""),
  c as (select l.row_key, l.feature, l.value, l.value * coalesce(w.importance, 1.0) as contribution
        from l left join w on l.feature = w.feature)
  select row_key, feature, {r6('value')} as value, {r6('contribution')} as contribution,
         cast(row_number() over (partition by row_key order by abs(contribution) desc, feature) as integer) as position
  from c""")
def q_local_fallback(spark, sf_dir):
    """value x weight contributions per test row and feature (weights: |r| importances), ranked by size."""
    s = line_charge_split(spark, sf_dir)
    tr = s.where(F.col("split") == "train")
    w = rounded(P.corr_target(tr, "charge", NUMERIC_FEATURES)).select(F.col("column").alias("feature"),
                                                                      F.col("abs_r").alias("weight"))
    return rounded(local_fallback(s.where(F.col("split") == "test"), w, NUMERIC_FEATURES, "row_key"))
