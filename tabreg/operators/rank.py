"""Model ranking operators: min-max normalisation, weighted deployment score, rank, bands, evidence
tiers, importance shares, per-metric orders and top-k.

Every operator takes an optional ``partition_by`` so one call ranks many independent model pools
(for example one per segment). The input is a results table: one row per candidate model per pool, so
a pool holds a handful of rows. Pool statistics (min, max, sum) are window aggregates over the pool:
one shuffle by pool key, no self-join, and the upstream plan that produced the results runs once.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabreg.functions.bands import band_generalisation, band_stability, complexity

# Deployment score weights (higher-is-better metrics use benefit scaling, the others cost).
SCORE_WEIGHTS: dict[str, tuple[float, str]] = {
    "r2": (0.40, "benefit"),
    "rmse": (0.15, "cost"),
    "mae": (0.10, "cost"),
    "cv_r2_mean": (0.20, "benefit"),
    "cv_r2_std": (0.075, "cost"),
    "abs_r2_gap": (0.075, "cost"),
}
# Evidence tiers (within 0.001 of the best R2: top tier; R2 >= 0.98: strong) and the
# gap above which the evidence text mentions possible overfitting.
LEADER_MARGIN = 0.001
STRONG_R2 = 0.98
EVIDENCE_GAP = 0.02


def _pool(partition_by: Sequence[str]) -> Window:
    return Window.partitionBy(*partition_by)


def minmax_expr(x: Column, benefit: bool, partition_by: Sequence[str] = ()) -> Column:
    """(x-min)/(max-min) (benefit) or 1-(x-min)/(max-min) (cost) over the pool; 1.0 when the span is 0."""
    w = _pool(partition_by)
    mn, mx = F.min(x).over(w), F.max(x).over(w)
    span = mx - mn
    scaled = (x - mn) / span
    return F.when(span == 0, F.lit(1.0)).otherwise(scaled if benefit else F.lit(1.0) - scaled)


def minmax_scaled(df: DataFrame, col: str, out: str, benefit: bool = True,
                  partition_by: Sequence[str] = ()) -> DataFrame:
    """Adds ``out`` = min-max scaled ``col`` within each pool."""
    return df.withColumn(out, minmax_expr(F.col(col), benefit, partition_by))


def deployment_score(results: DataFrame, weights: Mapping[str, tuple[float, str]] | None = None,
                     partition_by: Sequence[str] = ()) -> DataFrame:
    """Adds ``deployment_score`` = 100 * sum(weight * normalised metric) within each pool."""
    weights = dict(weights or SCORE_WEIGHTS)
    total: Column | None = None
    for metric, (w, kind) in weights.items():
        x = F.abs(F.col("r2_gap")) if metric == "abs_r2_gap" else F.col(metric)
        term = F.lit(w) * minmax_expr(x, kind == "benefit", partition_by)
        total = term if total is None else total + term
    return results.withColumn("deployment_score", F.lit(100.0) * total)


def deployment_rank(scored: DataFrame, partition_by: Sequence[str] = (), name: str = "algorithm") -> DataFrame:
    """1..n by score desc, R2 desc, RMSE asc, then name (ties never depend on input order)."""
    w = Window.partitionBy(*partition_by).orderBy(F.col("deployment_score").desc(), F.col("r2").desc(),
                                                 F.col("rmse").asc(), F.col(name).asc())
    return scored.withColumn("deployment_rank", F.row_number().over(w))


def add_bands(results: DataFrame, name: str = "algorithm") -> DataFrame:
    """generalisation (from the R2 gap), stability (from CV R2 std) and complexity (by name) labels."""
    return results.withColumns({
        "generalisation": band_generalisation(F.col("r2_gap")),
        "stability": band_stability(F.col("cv_r2_std")),
        "complexity": complexity(F.col(name)),
    })


def rank_models(results: DataFrame, partition_by: Sequence[str] = (), name: str = "algorithm") -> DataFrame:
    """Score, bands and rank in one plan (the trainer's ranking step)."""
    return deployment_rank(add_bands(deployment_score(results, partition_by=partition_by), name),
                           partition_by, name)


# Openings by tier, and endings by whether the gap is large.
TIER_TEXT = {"leader": "Top-tier: ", "strong": "Strong but below leaders: ", "lower": "Lower fit: "}
GAP_TEXT = {True: "suggesting possible overfitting.", False: "indicating good generalisation."}


def evidence_tier(results: DataFrame, partition_by: Sequence[str] = ()) -> DataFrame:
    """tier (leader / strong / lower) against the pool's best R2 and the evidence sentence."""
    df = results.withColumn("__best", F.max("r2").over(_pool(partition_by)))
    tier = (F.when(F.col("r2") >= F.col("__best") - LEADER_MARGIN, F.lit("leader"))
            .when(F.col("r2") >= STRONG_R2, F.lit("strong")).otherwise(F.lit("lower")))
    df = df.withColumn("tier", tier)
    head = F.element_at(F.create_map(*[F.lit(x) for kv in TIER_TEXT.items() for x in kv]), F.col("tier"))
    gap = F.abs("r2_gap")
    text = F.concat(
        head, F.format_string("R²=%.4f, RMSE=%.4f, MAE=%.4f.", "r2", "rmse", "mae"),
        F.format_string(" Train-test gap=%.4f, ", gap),
        F.when(gap > EVIDENCE_GAP, F.lit(GAP_TEXT[True])).otherwise(F.lit(GAP_TEXT[False])),
        F.format_string(" CV R²=%.4f.", "cv_r2_mean"))
    if "deployment_score" in results.columns:
        text = F.concat(text, F.format_string(" Deployment score=%.2f/100.", "deployment_score"))
    return df.withColumn("evidence", text).drop("__best")


def importance_share(df: DataFrame, value: str = "importance", percent: bool = True,
                     partition_by: Sequence[str] = ()) -> DataFrame:
    """value / total within the pool (x100 when ``percent``); 0 when the total is not positive."""
    tot = F.sum(value).over(_pool(partition_by))
    share = F.col(value) / tot * (100.0 if percent else 1.0)
    return df.withColumn("share", F.when(tot > 0, share).otherwise(F.lit(0.0)))


def corr_strength(ct: DataFrame, r: str = "r") -> DataFrame:
    """Keep strong (|r| >= .6, by sign) or moderate (.3 <= |r| < .6) correlations with a strength label."""
    x = F.col(r)
    strength = (F.when(x >= 0.6, F.lit("strong positive")).when(x <= -0.6, F.lit("strong negative"))
                .when((F.abs(x) >= 0.3) & (F.abs(x) < 0.6), F.lit("moderate")))
    return ct.withColumn("strength", strength).where(F.col("strength").isNotNull())


def top_k(df: DataFrame, order: Sequence[Column], k: int, partition_by: Sequence[str] = ()) -> DataFrame:
    """First k rows by ``order``; per pool with ``partition_by`` (window group limit), else a
    TakeOrderedAndProject (each task keeps only k rows)."""
    if partition_by:
        w = Window.partitionBy(*partition_by).orderBy(*order)
        return df.withColumn("__rk", F.row_number().over(w)).where(F.col("__rk") <= k).drop("__rk")
    return df.orderBy(*order).limit(k)


# Direction of each metric (True = higher is better) for per-metric orders.
METRIC_DIRECTION = {"r2": True, "rmse": False, "mae": False, "cv_r2_mean": True, "cv_r2_std": False,
                    "abs_r2_gap": False, "training_seconds": False, "deployment_score": True}


def metric_orders(results: DataFrame, metrics: Sequence[str], name: str = "algorithm",
                  partition_by: Sequence[str] = ()) -> DataFrame:
    """Long table (metric, algorithm, value, position): each metric ordered best first, name breaks ties."""
    df = results.withColumn("abs_r2_gap", F.abs("r2_gap")) if "abs_r2_gap" in metrics else results
    long = df.select(*partition_by, name, F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"),
                 (F.col(m) * (-1.0 if METRIC_DIRECTION.get(m, True) else 1.0)).cast("double").alias("key"))
        for m in metrics])).alias("kv")).select(*partition_by, name, "kv.metric", "kv.value", "kv.key")
    w = Window.partitionBy(*partition_by, "metric").orderBy(F.col("key").asc_nulls_last(), F.col(name))
    return long.withColumn("position", F.row_number().over(w)).drop("key")


def name_contains(df: DataFrame, name_col: str, needle: str, fallback_order: Sequence[Column]) -> DataFrame:
    """First row whose name contains ``needle`` (case-insensitive); else the first row by ``fallback_order``.

    Both candidates come from one ``TakeOrderedAndProject`` (ordering: matching rows first).
    """
    hit = F.lower(F.col(name_col)).contains(needle.lower())
    return (df.withColumn("__hit", hit.cast("int"))
            .orderBy(F.col("__hit").desc(), *fallback_order).limit(1).drop("__hit"))
