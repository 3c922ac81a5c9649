"""Banding expressions (CASE chains) with their SQL twins.

Fixed values: thresholds and label texts below are the reference's, stated as is.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Generalisation band on |train R2 - test R2| (right-closed edges).
GENERALISATION = [(0.01, "Strong"), (0.03, "Good"), (0.07, "Moderate")]
GENERALISATION_ELSE = "Possible overfitting"
# Stability band on |CV R2 std| (right-closed edges).
STABILITY = [(0.005, "Very stable"), (0.015, "Stable"), (0.035, "Moderate")]
STABILITY_ELSE = "Variable"
# Skew interpretation, cut (-inf, 0.5], (0.5, 1.0], (1.0, inf).
SKEW = [(0.5, "Approximately symmetric"), (1.0, "Moderately skewed")]
SKEW_ELSE = "Highly skewed"
# Target shape text, left-closed: < 0.5, < 1.0, else.
TARGET_SHAPE = [(0.5, "approximately symmetric"), (1.0, "moderately skewed")]
TARGET_SHAPE_ELSE = "highly skewed"
# Demand band on a predicted value (< 15, < 30, < 40, else) with its text.
DEMAND = [
    (15, "Low heating demand", "The estimated heating demand is relatively low."),
    (30, "Moderate heating demand", "The estimated heating demand is in the middle range."),
    (40, "Elevated heating demand", "The building may require more heating energy."),
]
DEMAND_ELSE = ("High heating demand", "The estimated heating demand is comparatively high.")
# Simple gap status (|gap| <= 0.03).
GAP_SIMPLE = (0.03, "Low generalisation gap", "Review possible overfitting")
# Distinct-count rule for possible type.
POSSIBLE_TYPE = ("Discrete / categorical-like", "Continuous")
# Driver direction of a contribution.
DIRECTION = ("Increases", "Reduces")
# Model complexity labels by algorithm name, default "Unknown".
COMPLEXITY = {
    "Linear Regression": "Low", "Ridge Regression": "Low", "Lasso Regression": "Low",
    "Decision Tree": "Medium", "Random Forest": "High", "Gradient Boosting": "High", "SVR": "Medium",
    "XGBoost": "High", "Extra Trees": "High", "AdaBoost": "Medium", "CatBoost": "High", "LightGBM": "High",
    "gbt_subsampled": "High", "forest_subspace": "High", "gbt_deep": "High", "gbt_wide": "High",
}


def _le_chain(x: Column, edges, default: str) -> Column:
    out = None
    for edge, label in edges:
        out = (F.when(x <= edge, F.lit(label)) if out is None else out.when(x <= edge, F.lit(label)))
    return out.otherwise(F.lit(default))


def _lt_chain(x: Column, edges, default: str) -> Column:
    out = None
    for edge, label in edges:
        out = (F.when(x < edge, F.lit(label)) if out is None else out.when(x < edge, F.lit(label)))
    return out.otherwise(F.lit(default))


def _sql_chain(x: str, edges, default: str, op: str) -> str:
    parts = " ".join(f"when {x} {op} {edge!r} then '{label}'" for edge, label in edges)
    return f"(case when {x} is null then null {parts} else '{default}' end)"


def band_generalisation(gap: Column) -> Column:
    g = F.abs(gap)
    return F.when(g.isNotNull(), _le_chain(g, GENERALISATION, GENERALISATION_ELSE))


def band_generalisation_sql(gap: str) -> str:
    return _sql_chain(f"abs({gap})", GENERALISATION, GENERALISATION_ELSE, "<=")


def band_stability(std: Column) -> Column:
    s = F.abs(std)
    return F.when(s.isNotNull(), _le_chain(s, STABILITY, STABILITY_ELSE))


def band_stability_sql(std: str) -> str:
    return _sql_chain(f"abs({std})", STABILITY, STABILITY_ELSE, "<=")


def band_skew(abs_skew: Column) -> Column:
    return F.when(abs_skew.isNotNull(), _le_chain(abs_skew, SKEW, SKEW_ELSE))


def band_skew_sql(abs_skew: str) -> str:
    return _sql_chain(abs_skew, SKEW, SKEW_ELSE, "<=")


def band_target_shape(skew: Column) -> Column:
    s = F.abs(skew)
    return F.when(s.isNotNull(), _lt_chain(s, TARGET_SHAPE, TARGET_SHAPE_ELSE))


def band_target_shape_sql(skew: str) -> str:
    return _sql_chain(f"abs({skew})", TARGET_SHAPE, TARGET_SHAPE_ELSE, "<")


def band_demand(value: Column) -> tuple[Column, Column]:
    """(label, text) for a predicted value."""
    label = _lt_chain(value, [(e, l) for e, l, _ in DEMAND], DEMAND_ELSE[0])
    text = _lt_chain(value, [(e, t) for e, _, t in DEMAND], DEMAND_ELSE[1])
    return F.when(value.isNotNull(), label), F.when(value.isNotNull(), text)


def band_demand_sql(value: str) -> tuple[str, str]:
    return (_sql_chain(value, [(e, l) for e, l, _ in DEMAND], DEMAND_ELSE[0], "<"),
            _sql_chain(value, [(e, t) for e, _, t in DEMAND], DEMAND_ELSE[1], "<"))


def band_gap_simple(gap: Column) -> Column:
    edge, low, review = GAP_SIMPLE
    return F.when(gap.isNotNull(), F.when(F.abs(gap) <= edge, F.lit(low)).otherwise(F.lit(review)))


def band_gap_simple_sql(gap: str) -> str:
    edge, low, review = GAP_SIMPLE
    return f"(case when {gap} is null then null when abs({gap}) <= {edge!r} then '{low}' else '{review}' end)"


def possible_type(unique: Column, limit: int = 10) -> Column:
    return F.when(unique <= limit, F.lit(POSSIBLE_TYPE[0])).otherwise(F.lit(POSSIBLE_TYPE[1]))


def possible_type_sql(unique: str, limit: int = 10) -> str:
    return f"(case when {unique} <= {limit} then '{POSSIBLE_TYPE[0]}' else '{POSSIBLE_TYPE[1]}' end)"


def driver_direction(contribution: Column) -> Column:
    return F.when(contribution >= 0, F.lit(DIRECTION[0])).otherwise(F.lit(DIRECTION[1]))


def driver_direction_sql(contribution: str) -> str:
    return f"(case when {contribution} >= 0 then '{DIRECTION[0]}' else '{DIRECTION[1]}' end)"


def relationship_sign(r: Column) -> Column:
    """'positive' / 'negative' wording of a correlation's direction (NULL stays NULL)."""
    return F.when(r > 0, F.lit("positive")).when(r < 0, F.lit("negative")).when(r == 0, F.lit("none"))


def relationship_sign_sql(r: str) -> str:
    return f"(case when {r} > 0 then 'positive' when {r} < 0 then 'negative' when {r} = 0 then 'none' end)"


def complexity(algorithm: Column) -> Column:
    m = F.create_map(*[x for k, v in COMPLEXITY.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(m[algorithm], F.lit("Unknown"))


def complexity_sql(algorithm: str) -> str:
    parts = " ".join(f"when {algorithm} = '{k}' then '{v}'" for k, v in COMPLEXITY.items())
    return f"(case {parts} else 'Unknown' end)"
