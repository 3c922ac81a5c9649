"""Report tables composed from the profile, ranking and evaluation operators.

Reports are tables (written with the sinks in ``tabreg.sources.io``), not documents.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabreg.cluster import written

# Preferred visible columns of the comparison report, in display order.
COMPARISON_COLUMNS = ["deployment_rank", "algorithm", "train_r2", "r2", "rmse", "mae", "cv_r2_mean", "cv_r2_std", "r2_gap",
                      "training_seconds", "deployment_score"]
# Alias table between display names and the canonical snake_case metric names.
METRIC_ALIASES = {
    "Algorithm": "algorithm", "R2": "r2", "RMSE": "rmse", "MAE": "mae", "MSE": "mse",
    "Train R2": "train_r2", "Train RMSE": "train_rmse", "Train MAE": "train_mae", "Train MSE": "train_mse",
    "Train-Test R2 Gap": "r2_gap", "Overfit Gap": "r2_gap", "CV R2 Mean": "cv_r2_mean", "CV R2 Std": "cv_r2_std",
    "CV MAE Mean": "cv_mae_mean", "CV RMSE Mean": "cv_rmse_mean", "Training Time (s)": "training_seconds",
    "Deployment Score": "deployment_score", "Deployment Rank": "deployment_rank",
}


def visible_subset(df: DataFrame, preferred: Sequence[str]) -> DataFrame:
    """Keep the preferred columns that exist, in preferred order (schema only, no job)."""
    return df.select(*[c for c in preferred if c in df.columns])


def alias_columns(df: DataFrame, renames: Mapping[str, str]) -> DataFrame:
    """Rename source -> target only when the source exists and the target does not (schema only)."""
    taken = set(df.columns)
    plan: dict[str, str] = {}
    for s, t in renames.items():
        if s in df.columns and t not in taken:
            plan[s] = t
            taken.add(t)
    return df.withColumnsRenamed(plan)


def first_present(df: DataFrame, target: str, candidates: Sequence[str]) -> DataFrame:
    """Name the first present candidate column ``target`` (fallback names), unless it already exists."""
    if target in df.columns:
        return df
    for c in candidates:
        if c in df.columns:
            return df.withColumnRenamed(c, target)
    return df


def fmt(c: str, digits: int) -> Column:
    """Fixed-point text; 'Not available' when the value is missing or not numeric."""
    v = F.col(c).try_cast("double") if hasattr(F.col(c), "try_cast") else F.expr(f"try_cast({c} as double)")
    return F.coalesce(F.format_string(f"%.{digits}f", v), F.lit("Not available"))


def comparison_table(ranked: DataFrame) -> DataFrame:
    """Visible ranking columns with metrics at 4 dp and the score at 2 dp."""
    vis = visible_subset(ranked, COMPARISON_COLUMNS)
    plain, two = ("deployment_rank", "algorithm"), ("training_seconds", "deployment_score")
    return vis.select(*[F.col(c) if c in plain else F.replace(
        F.format_string("%.2f" if c in two else "%.4f", c), F.lit("-0.0000"), F.lit("0.0000")).alias(c) for c in vis.columns])


def _facts(pairs) -> Column:
    return F.explode(F.array(*[F.struct(F.lit(k).alias("fact"), v.cast("string").alias("value")) for k, v in pairs]))


def data_understanding(df: DataFrame, target: str, exclude_from_duplicates: Sequence[str] = ()) -> DataFrame:
    """Overview facts: rows, columns, target, duplicate rows, total missing values (fact, value)."""
    from tabreg.operators.profile import duplicate_rows, missing_by_column
    dup_cols = [c for c in df.columns if c not in set(exclude_from_duplicates)]
    dups = duplicate_rows(df, dup_cols)
    miss = missing_by_column(df).agg(F.sum("missing").cast("bigint").alias("missing_total"))
    rows = df.agg(F.count(F.lit(1)).cast("bigint").alias("n_rows"))
    one = rows.crossJoin(dups).crossJoin(miss)
    return one.select(_facts([("n_rows", F.col("n_rows")), ("n_columns", F.lit(len(df.columns))),
                              ("target", F.lit(target)), ("duplicate_rows", F.col("duplicate_rows")),
                              ("missing_total", F.col("missing_total"))]).alias("kv")).select("kv.*")


def data_understanding_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """The per-column part of the report: (column, fact, value) of the column summary, and of describe() for
    the numeric ``cols`` (6-dp text)."""
    from tabreg.operators.profile import column_summary, describe_numeric
    s = column_summary(df)
    facts = ("data_type", "missing", "unique_with_null", "unique")
    summary = s.select("column", F.explode(F.array(*[
        F.struct(F.lit(f).alias("fact"), F.col(f).cast("string").alias("value")) for f in facts])).alias("kv")).select("column", "kv.*")
    d = describe_numeric(df, cols)
    stats = [c for c in d.columns if c != "column"]
    described = d.select("column", F.explode(F.array(*[
        F.struct(F.lit(c).alias("fact"), (F.col(c).cast("string") if c == "count" else F.format_string("%.6f", F.col(c).cast("double") + F.lit(0.0)))
                 .alias("value")) for c in stats])).alias("kv")).select("column", "kv.*")
    return summary.unionByName(described)


def final_facts(df: DataFrame, target: str, winner: DataFrame, exclude_from_duplicates: Sequence[str] = ()) -> DataFrame:
    """(section, item, value): table facts (rows, columns, target, duplicates, missing) and the winner's test and
    cross-validation metrics (4-dp text)."""
    facts = data_understanding(df, target, exclude_from_duplicates).select(
        F.lit("fact").alias("section"), F.col("fact").alias("item"), "value")
    metrics = winner.select(F.explode(F.array(*[
        F.struct(F.lit(m).alias("item"), F.format_string("%.4f", F.col(m)).alias("value"))
        for m in ("r2", "rmse", "mae", "cv_r2_mean", "cv_r2_std")])).alias("kv")).select(F.lit("metric").alias("section"), "kv.*")
    return facts.unionByName(metrics)


def eda_summary(df: DataFrame, target: str, cols: Sequence[str]) -> DataFrame:
    """(section, column, value): target correlations, bias-corrected skew, IQR outlier counts."""
    from tabreg.operators.profile import corr_target, iqr_outlier_summary, moment_table
    corr = corr_target(df, target, cols).select(F.lit("correlation").alias("section"), "column", F.col("r").alias("value"))
    skew = moment_table(df, [*cols, target]).select(F.lit("skewness").alias("section"), "column",
                                                    F.col("skewness").alias("value"))
    out = iqr_outlier_summary(df, [*cols, target]).select(F.lit("outlier_count").alias("section"), "column",
                                                          F.col("outlier_count").cast("double").alias("value"))
    return corr.unionByName(skew).unionByName(out)


def evaluation_table(metrics_row: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """(metric, value) with 4-dp text from a one-row metrics table."""
    return metrics_row.select(F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.format_string("%.4f", F.col(m)).alias("value")) for m in metrics]))
        .alias("kv")).select("kv.*")


def findings(df: DataFrame, target: str, cols: Sequence[str]) -> DataFrame:
    """Data-driven findings (finding, subject, value): strong/moderate target correlations, columns with
    missing values, with IQR outliers, highly skewed columns, and the target's shape."""
    from tabreg.functions.bands import band_target_shape
    from tabreg.operators.profile import corr_target, iqr_outlier_summary, missing_by_column, moment_table
    df = written(df.select(*dict.fromkeys([*cols, target])), "findings-rows")  # read some eight times: what made it runs once
    ct = corr_target(df, target, cols)
    r = F.col("r")
    corr = ct.select(
        F.when(r >= 0.6, F.lit("strong positive correlation")).when(r <= -0.6, F.lit("strong negative correlation"))
        .when((F.abs(r) >= 0.3) & (F.abs(r) < 0.6), F.lit("moderate correlation")).alias("finding"),
        F.col("column").alias("subject"), F.format_string("%.4f", r).alias("value")).where(F.col("finding").isNotNull())
    miss = missing_by_column(df, [*cols, target]).where(F.col("missing") > 0).select(
        F.lit("missing values").alias("finding"), F.col("column").alias("subject"),
        F.col("missing").cast("string").alias("value"))
    outl = iqr_outlier_summary(df, [*cols, target]).where(F.col("outlier_count") > 0).select(
        F.lit("outliers").alias("finding"), F.col("column").alias("subject"),
        F.col("outlier_count").cast("string").alias("value"))
    mom = moment_table(df, [*cols, target])
    skew = mom.where(F.abs("skewness") > 1.0).select(
        F.lit("highly skewed").alias("finding"), F.col("column").alias("subject"),
        F.format_string("%.4f", "skewness").alias("value"))
    shape = mom.where(F.col("column") == target).select(
        F.lit("target shape").alias("finding"), F.col("column").alias("subject"),
        band_target_shape(F.col("skewness")).alias("value"))
    return corr.unionByName(miss).unionByName(outl).unionByName(skew).unionByName(shape)


def threshold_filters(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(rule, column, value) rows for missing > 0, outliers > 0 and |skew| > 1."""
    from tabreg.operators.profile import iqr_outlier_summary, missing_by_column, moment_table
    miss = missing_by_column(df, cols).where(F.col("missing") > 0).select(
        F.lit("missing > 0").alias("rule"), "column", F.col("missing").cast("double").alias("value"))
    outl = iqr_outlier_summary(df, cols).where(F.col("outlier_count") > 0).select(
        F.lit("outliers > 0").alias("rule"), "column", F.col("outlier_count").cast("double").alias("value"))
    skew = moment_table(df, cols).where(F.abs("skewness") > 1.0).select(
        F.lit("abs skew > 1").alias("rule"), "column", F.col("skewness").alias("value"))
    return miss.unionByName(outl).unionByName(skew)
