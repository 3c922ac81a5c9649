"""Column expressions for statistics whose Spark built-ins differ from the pandas/scikit-learn definitions.

Everything here returns a ``Column`` so it stays inside whole-stage codegen and works in any
``agg`` / ``select`` (grouped or global, partial + final aggregation).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c



def sample_skew(c) -> Column:
    """Bias-corrected (adjusted Fisher-Pearson) skewness as pandas/DuckDB; NULL for n < 3 or constant."""
    col = _c(c)
    n = F.count(col).cast("double")
    g1 = F.skewness(col)
    return F.when(n >= 3, F.sqrt(n * (n - 1)) / (n - 2) * g1)


def sample_kurt(c) -> Column:
    """Bias-corrected excess kurtosis as pandas/DuckDB; NULL for n < 4 or constant."""
    col = _c(c)
    n = F.count(col).cast("double")
    g2 = F.kurtosis(col)
    return F.when(n >= 4, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6))


def guarded_corr(x, y) -> Column:
    """Pearson r that is NULL (never an error) when either side is constant."""
    cx, cy = _c(x), _c(y)
    return F.try_divide(F.covar_pop(cx, cy), F.stddev_pop(cx) * F.stddev_pop(cy))


def r2_expr(y, pred) -> Column:
    """Coefficient of determination 1 - SSE/SST over the group; NULL when y is constant."""
    cy, cp = _c(y), _c(pred)
    sse = F.sum((cy - cp) * (cy - cp))
    sst = F.var_pop(cy) * F.count(cy)
    return F.lit(1.0) - F.try_divide(sse, F.when(sst != 0, sst))


def hash_bucket(key: Column, salt: str, modulo: int) -> Column:
    """Deterministic bucket in [0, modulo) from the first 32 bits of md5(key-salt).

    Independent of partitioning and row order, so the same rows fall in the same bucket on any cluster
    size; an engine with md5 and hex parsing (DuckDB: ``('0x'||substr(md5(..),1,8))::ubigint``) gets the
    same rows.
    """
    hexed = F.substring(F.md5(F.concat_ws("-", key, F.lit(salt))), 1, 8)
    return (F.conv(hexed, 16, 10).cast("bigint") % F.lit(modulo)).cast("int")



# Coefficients of Acklam's rational approximation of the inverse normal CDF
# (published algorithm, relative error below 1.15e-9), and its tail switch point.
ACKLAM_A = [-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02,
            1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00]
ACKLAM_B = [-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02,
            6.680131188771972e01, -1.328068155288572e01]
ACKLAM_C = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00,
            -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00]
ACKLAM_D = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00,
            3.754408661907416e00]
ACKLAM_P_LOW = 0.02425


def _horner(coeffs, x: Column) -> Column:
    acc = F.lit(coeffs[0])
    for k in coeffs[1:]:
        acc = acc * x + F.lit(k)
    return acc


def inverse_normal(p) -> Column:
    """Standard normal quantile for 0 < p < 1 as one CASE expression (no Python in the hot path)."""
    cp = _c(p)
    q_low = F.sqrt(-2 * F.log(cp))
    q_high = F.sqrt(-2 * F.log(1 - cp))
    q = cp - 0.5
    r = q * q
    low = _horner(ACKLAM_C, q_low) / (_horner(ACKLAM_D, q_low) * q_low + 1)
    high = -_horner(ACKLAM_C, q_high) / (_horner(ACKLAM_D, q_high) * q_high + 1)
    mid = _horner(ACKLAM_A, r) * q / (_horner(ACKLAM_B, r) * r + 1)
    return (F.when(cp < ACKLAM_P_LOW, low)
            .when(cp > 1 - ACKLAM_P_LOW, high)
            .otherwise(mid))


def inverse_normal_sql(p: str) -> str:
    """The same approximation as SQL text (used by the DuckDB oracle)."""
    def horner(coeffs, x):
        s = f"({coeffs[0]!r})"
        for k in coeffs[1:]:
            s = f"({s} * {x} + ({k!r}))"
        return s
    ql = f"sqrt(-2 * ln({p}))"
    qh = f"sqrt(-2 * ln(1 - {p}))"
    q = f"({p} - 0.5)"
    r = f"({q} * {q})"
    low = f"{horner(ACKLAM_C, ql)} / ({horner(ACKLAM_D, ql)} * {ql} + 1)"
    high = f"-{horner(ACKLAM_C, qh)} / ({horner(ACKLAM_D, qh)} * {qh} + 1)"
    mid = f"{horner(ACKLAM_A, r)} * {q} / ({horner(ACKLAM_B, r)} * {r} + 1)"
    return (f"(case when {p} < {ACKLAM_P_LOW!r} then {low} "
            f"when {p} > {1 - ACKLAM_P_LOW!r} then {high} else {mid} end)")


def sig_round(c, digits: int = 9) -> Column:
    """Round to ``digits`` significant digits (-0.0 folded into 0.0); NULL/NaN/0 pass through.

    Written with floor/log10/pow/round only, and scaling only by exact powers of ten (multiply when
    the scale is positive, divide when negative), so another engine evaluating the same text gets the
    same double (used to compare results whose last bits depend on summation order).
    """
    col = _c(c).cast("double")
    k = F.lit(digits - 1) - F.floor(F.log10(F.abs(col)))

    def half_away(y):  # round half away from zero with plain double arithmetic (no BigDecimal)
        return F.signum(y) * F.floor(F.abs(y) + F.lit(0.5)).cast("double")

    up = half_away(col * F.pow(F.lit(10.0), k)) / F.pow(F.lit(10.0), k)
    down = half_away(col / F.pow(F.lit(10.0), -k)) * F.pow(F.lit(10.0), -k)
    scaled = F.when(k >= 0, up).otherwise(down)
    return F.when(F.isnan(col) | (col == 0) | F.isnull(col), col).otherwise(scaled) + F.lit(0.0)


def sig_round_sql(expr: str, digits: int = 9) -> str:
    """SQL text twin of ``sig_round``."""
    x = f"cast({expr} as double)"
    k = f"({digits - 1} - floor(log10(abs({x}))))"
    def half_away(y):
        return f"(cast(sign({y}) as double) * cast(floor(abs({y}) + 0.5) as double))"
    return (f"(case when {x} is null or isnan({x}) or {x} = 0 then {x} "
            f"when {k} >= 0 then {half_away(f'{x} * pow(10.0, {k})')} / pow(10.0, {k}) "
            f"else {half_away(f'{x} / pow(10.0, -{k})')} * pow(10.0, -{k}) end + 0.0)")
