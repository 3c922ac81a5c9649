"""Registered queries: projections and predicates (§2.2), scalar functions and bands (§2.9), sorts and
top-k (§2.6), set checks and the split (§2.7, §2.10 split_train_test)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tabreg.functions import bands as B
from tabreg.functions.stats import sample_skew
from tabreg.functions.text import display_name, format_number, safe_file_name, slug
from tabreg.operators import columns as C
from tabreg.operators import profile as P
from tabreg.operators.report import alias_columns, first_present, visible_subset
from tabreg.operators.split import split_cover, split_overlap
from tabreg.plans.q_profile import _CORR_TARGET_SQL, _corr_sql
from tabreg.plans.q_rank import RES_R, results_r
from tabreg.operators.baselines import BASELINE_SQL
from tabreg.plans.registry import query, r6, rounded
from tabreg.sources.tables import (LINE_CHARGE_SQL, LINE_SPLIT_SQL, NUMERIC_FEATURES, line_charge, line_charge_split,
                                   load)

LC = f"({LINE_CHARGE_SQL})"


@query("cast_numeric", sql="""
  select 'k_text' as column, cast(count(k_text) as bigint) as n_values,
         cast(count(*) filter (where k_text is not null and try_cast(k_text as double) is null) as bigint) as n_invalid
  from (select json_extract_string(props, '$.k') as k_text, event_type from events)
  union all
  select 'event_type', cast(count(event_type) as bigint),
         cast(count(*) filter (where event_type is not null and try_cast(event_type as double) is null) as bigint)
  from events""")
def q_cast_numeric(spark, sf_dir):
    """Quarantining numeric cast: non-numeric values per text column (JSON field k, event_type)."""
    e = load(spark, sf_dir, "events").select(F.get_json_object("props", "$.k").alias("k_text"), "event_type")
    return C.invalid_numeric_counts(e, ["k_text", "event_type"])


@query("interaction_feature", sql=f"select row_key, {r6('l_extendedprice * l_discount')} as price_discount from {LC}")
def q_interaction_feature(spark, sf_dir):
    """price_discount = l_extendedprice * l_discount per row (inputs unchanged)."""
    lc = C.add_interaction(line_charge(spark, sf_dir), "price_discount", "l_extendedprice", "l_discount")
    return rounded(lc.select("row_key", "price_discount"))


_ORDER = ["row_key", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber", "l_returnflag",
          "l_linestatus"]


@query("select_ordered", sql=f"select {', '.join(_ORDER)} from {LC}")
def q_select_ordered(spark, sf_dir):
    """Key and the seven features in the fixed model order."""
    return C.select_ordered(line_charge(spark, sf_dir), _ORDER)


@query("drop_if_exists", sql=f"select row_key, l_quantity, l_extendedprice, l_discount, l_tax, l_linenumber, "
       f"l_returnflag, l_linestatus from {LC}")
def q_drop_if_exists(spark, sf_dir):
    """Drop the target and an absent column (absent names ignored)."""
    return C.drop_if_exists(line_charge(spark, sf_dir), ["charge", "Cooling_Load"])


@query("select_numeric", sql="select l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, "
       "l_discount, l_tax from lineitem")
def q_select_numeric(spark, sf_dir):
    """Numeric columns of lineitem only (schema filter, pruned scan)."""
    return C.select_numeric(load(spark, sf_dir, "lineitem"))


@query("alias_columns", sql="select l_orderkey, l_quantity as quantity, l_tax as tax, l_discount from lineitem")
def q_alias_columns(spark, sf_dir):
    """Rename present sources whose target is absent; skip absent sources and taken targets."""
    li = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_tax", "l_discount")
    out = alias_columns(li, {"l_quantity": "quantity", "l_tax": "tax", "not_there": "x", "l_discount": "quantity"})
    return first_present(out, "tax", ["l_tax", "tax_rate"])


@query("visible_subset", sql=RES_R + " select algorithm, r2, rmse, mae, cv_r2_mean from rr")
def q_visible_subset(spark, sf_dir):
    """Preferred report columns that exist, in preferred order."""
    return visible_subset(results_r(spark, sf_dir), ["algorithm", "r2", "rmse", "mae", "cv_r2_mean", "training_seconds"])


def _domain_sql():
    parts = []
    for col, rule in C.LINE_DOMAIN.items():
        if isinstance(rule, tuple):
            pred, text = f"{col} between {rule[0]!r} and {rule[1]!r}", f"between {rule[0]} and {rule[1]}"
        else:
            vals = sorted(rule)
            pred = f"{col} in ({', '.join(repr(v) for v in vals)})"
            text = "in {" + ", ".join(str(v) for v in vals) + "}"
        parts.append(f"select '{col}' as column, '{text}' as rule, cast(count({col}) as bigint) as n_checked, "
                     f"cast(count(*) filter (where {col} is not null and not ({pred})) as bigint) as n_violations from {LC}")
    return " union all ".join(parts)


@query("domain_check", sql=_domain_sql())
def q_domain_check(spark, sf_dir):
    """Allowed-range and allowed-set rules of each feature: rows checked and violations."""
    return C.domain_check(line_charge(spark, sf_dir), C.LINE_DOMAIN)


@query("preview", sql=f"select * from {LC} order by row_key limit 10")
def q_preview(spark, sf_dir):
    """First 10 rows by key (a deterministic head)."""
    return line_charge(spark, sf_dir).orderBy("row_key").limit(10)


_LC_NUM = [*NUMERIC_FEATURES, "charge"]


@query("sort_by_abs", sql="select column_a, column_b, r, cast(row_number() over (order by abs(r) desc, column_a, column_b) "
       "as integer) as position from (" + " union all ".join(
           f"select '{a}' as column_a, '{b}' as column_b, {r6(_corr_sql(a, b))} as r from {LC}"
           for i, a in enumerate(_LC_NUM) for b in _LC_NUM[i + 1:]) + ")")
def q_sort_by_abs(spark, sf_dir):
    """Correlation pairs ordered by absolute value (position column makes the order checkable)."""
    cm = rounded(P.corr_matrix(line_charge(spark, sf_dir), _LC_NUM))
    w = Window.orderBy(F.abs("r").desc(), "column_a", "column_b")  # k*(k-1)/2 rows
    return cm.withColumn("position", F.row_number().over(w))


@query("top_features", sql=f"select \"column\", r, position from (select *, cast(row_number() over "
       f"(order by abs_r desc, \"column\") as integer) as position from ({_CORR_TARGET_SQL})) where position <= 3")
def q_top_features(spark, sf_dir):
    """Top 3 features by absolute correlation with the target."""
    ct = rounded(P.corr_target(line_charge(spark, sf_dir), "charge", NUMERIC_FEATURES))
    w = Window.orderBy(F.col("abs_r").desc(), "column")  # one row per feature
    return ct.withColumn("position", F.row_number().over(w)).where("position <= 3").select("column", "r", "position")


@query("relationship_sign", sql=f"select \"column\", r, {B.relationship_sign_sql('r')} as direction from ({_CORR_TARGET_SQL})")
def q_relationship_sign(spark, sf_dir):
    """Positive / negative wording of each feature's correlation with the target."""
    ct = rounded(P.corr_target(line_charge(spark, sf_dir), "charge", NUMERIC_FEATURES))
    return ct.select("column", "r", B.relationship_sign(F.col("r")).alias("direction"))


@query("round_format", sql="""
  select event_id, round(value, 2) as value_2dp, printf('%.4f', value) as value_text,
         case when try_cast(event_type as double) is null then 'Not available'
              else printf('%.4f', try_cast(event_type as double)) end as type_text
  from events""")
def q_round_format(spark, sf_dir):
    """round(2), 4-dp text, and 'Not available' for values that are not numbers."""
    e = load(spark, sf_dir, "events")
    return e.select("event_id", F.round("value", 2).alias("value_2dp"), F.format_string("%.4f", "value").alias("value_text"),
                    format_number(F.col("event_type")).alias("type_text"))


@query("string_norm", sql="""
  select p_partkey,
    regexp_replace(regexp_replace(p_name, '[^A-Za-z0-9._-]+', '_', 'g'), '^_+|_+$', '', 'g') as safe_name,
    regexp_replace(replace(lower(p_name), ' ', '_'), '[()]', '', 'g') as slug,
    case when length(replace(p_name, '_', ' ')) <= 24 then replace(p_name, '_', ' ')
         else substr(replace(p_name, '_', ' '), 1, 22) || '…' end as display_name
  from part""")
def q_string_norm(spark, sf_dir):
    """Safe file name, slug and truncated display name of part names."""
    p = load(spark, sf_dir, "part")
    return p.select("p_partkey", safe_file_name(F.col("p_name")).alias("safe_name"), slug(F.col("p_name")).alias("slug"),
                    display_name(F.col("p_name")).alias("display_name"))


@query("math_sqrt_abs", sql=f"""
  select row_key, {r6('sqrt(l_extendedprice)')} as sqrt_price, {r6('abs(l_discount - 0.05)')} as abs_dev,
         {r6('pow(l_quantity, 2)')} as quantity_sq from {LC}""")
def q_math_sqrt_abs(spark, sf_dir):
    """sqrt, abs and square column functions."""
    lc = line_charge(spark, sf_dir)
    return rounded(lc.select("row_key", F.sqrt("l_extendedprice").alias("sqrt_price"),
                             F.abs(F.col("l_discount") - 0.05).alias("abs_dev"),
                             F.pow("l_quantity", 2).alias("quantity_sq")))


@query("band_skew", sql=f"""
  select user_id, {r6('skewness(value)')} as skewness, {B.band_skew_sql('abs(skewness(value))')} as interpretation
  from events group by user_id""")
def q_band_skew(spark, sf_dir):
    """Skew interpretation band of each user's prediction distribution."""
    e = load(spark, sf_dir, "events")
    s = e.groupBy("user_id").agg(sample_skew("value").alias("skewness"))
    return rounded(s.select("user_id", "skewness", B.band_skew(F.abs("skewness")).alias("interpretation")))


@query("band_target_shape", sql=f"""
  select event_type, {r6('skewness(value)')} as skewness, {B.band_target_shape_sql('skewness(value)')} as shape
  from events group by event_type""")
def q_band_target_shape(spark, sf_dir):
    """Target-shape wording (left-closed edges) of the value skew per event type."""
    e = load(spark, sf_dir, "events")
    s = e.groupBy("event_type").agg(sample_skew("value").alias("skewness"))
    return rounded(s.select("event_type", "skewness", B.band_target_shape(F.col("skewness")).alias("shape")))


_DL, _DT = B.band_demand_sql("value")


@query("band_demand", sql=f"select event_id, value, {_DL} as demand_band, {_DT} as demand_text from events")
def q_band_demand(spark, sf_dir):
    """Demand band and its sentence for every recorded prediction."""
    e = load(spark, sf_dir, "events")
    label, text = B.band_demand(F.col("value"))
    return e.select("event_id", "value", label.alias("demand_band"), text.alias("demand_text"))


@query("band_gap_simple", sql=RES_R + f" select algorithm, r2_gap, {B.band_gap_simple_sql('r2_gap')} as gap_status from rr")
def q_band_gap_simple(spark, sf_dir):
    """Two-level gap status (|gap| <= 0.03) per algorithm."""
    r = results_r(spark, sf_dir)
    return r.select("algorithm", "r2_gap", B.band_gap_simple(F.col("r2_gap")).alias("gap_status"))


@query("split_train_test", sql=f"select row_key, split from ({LINE_SPLIT_SQL})")
def q_split_train_test(spark, sf_dir):
    """Deterministic 80/20 hash split of line_charge rows."""
    return line_charge_split(spark, sf_dir).select("row_key", "split")


@query("split_disjoint", sql=f"""
  select cast(count(*) as bigint) as overlapping_keys from (
    select row_key from ({LINE_SPLIT_SQL}) where split = 'train'
    intersect select row_key from ({LINE_SPLIT_SQL}) where split = 'test')""")
def q_split_disjoint(spark, sf_dir):
    """Keys shared by train and test (0 for a valid split)."""
    s = line_charge_split(spark, sf_dir)
    ov = split_overlap(s.where("split = 'train'"), s.where("split = 'test'"), "row_key")
    return ov.agg(F.count(F.lit(1)).cast("bigint").alias("overlapping_keys"))


_SPLIT_COLS = "row_key, l_quantity, l_extendedprice, l_discount, l_tax, l_linenumber, l_returnflag, l_linestatus, charge"


@query("split_cover", sql=f"""
  with s as ({LINE_SPLIT_SQL}),
  both_sides as (select {_SPLIT_COLS} from s where split = 'train' union all select {_SPLIT_COLS} from s where split = 'test'),
  full_table as (select {_SPLIT_COLS} from s)
  select (select cast(count(*) as bigint) from (select * from full_table except all select * from both_sides)) as missing_rows,
         (select cast(count(*) as bigint) from (select * from both_sides except all select * from full_table)) as extra_rows""")
def q_split_cover(spark, sf_dir):
    """Rows lost or invented by the split, with multiplicity (train + test must equal the table)."""
    s = line_charge_split(spark, sf_dir)
    full = s.drop("split")
    return split_cover(full, s.where("split = 'train'").drop("split"), s.where("split = 'test'").drop("split"))


@query("kfold_contiguous", sql=f"""
  with r as (select row_key, row_number() over (order by row_key) - 1 as rk, count(*) over () as n from {LC})
  select row_key, cast(rk as bigint) as rank,
         cast(case when rk < (n % 5) * (n // 5 + 1) then rk // (n // 5 + 1)
                   else n % 5 + (rk - (n % 5) * (n // 5 + 1)) // (n // 5) end as integer) as fold
  from r""")
def q_kfold_contiguous(spark, sf_dir):
    """Unshuffled 5 folds over the key order (distributed global rank, scikit-learn fold sizes)."""
    from tabreg.operators.split import kfold_contiguous
    return kfold_contiguous(line_charge(spark, sf_dir).select("row_key"), ["row_key"], 5).select(
        "row_key", "rank", "fold")


@query("attach_actuals", sql=f"""
  with lc as ({LINE_SPLIT_SQL}),""" + BASELINE_SQL + f"""
  select p.row_key, {r6('a.charge')} as actual, {r6('p.prediction')} as predicted
  from (select row_key, prediction from preds where model = 'p3' and split = 'test') p
  join (select row_key, charge from lc) a on p.row_key = a.row_key""")
def q_attach_actuals(spark, sf_dir):
    """Test predictions (p3) aligned to actual values by key (inner join on the row key)."""
    from tabreg.operators.baselines import baseline_predictions
    s = line_charge_split(spark, sf_dir)
    preds = baseline_predictions(s, models=["p3"]).where("split = 'test'").select("row_key", "prediction")
    actual = line_charge(spark, sf_dir).select("row_key", "charge")
    return rounded(preds.join(actual, "row_key").select("row_key", F.col("charge").alias("actual"),
                                                         F.col("prediction").alias("predicted")))


@query("scan_batch", sql="""
  select cast(l_quantity as double) as l_quantity, cast(l_tax as double) as l_tax, l_returnflag, cast(l_orderkey as varchar) as note
  from lineitem""")
def q_scan_batch(spark, sf_dir):
    """A batch as CSV text, read by its declared (text) schema, required inputs cast strictly, the rest kept."""
    from tabreg.sources import io
    li = load(spark, sf_dir, "lineitem")
    lines = li.select(F.to_csv(F.struct(F.col("l_quantity").cast("double"), F.col("l_tax").cast("double"), "l_returnflag",
                                        F.col("l_orderkey"))).alias("line"))
    rows = io.parse_csv(lines, "line", "`l_quantity ` string, l_tax string, l_returnflag string, note string")
    return io.checked_batch(rows, ["l_quantity", "l_tax"])


@query("scan_json", sql="select event_id, event_type, value from events")
def q_scan_json(spark, sf_dir):
    """Event records as JSON text, read back by their declared schema."""
    from tabreg.sources import io
    e = load(spark, sf_dir, "events")
    lines = e.select(F.to_json(F.struct("event_id", "event_type", "value")).alias("line"))
    return io.parse_json(lines, "line", "event_id bigint, event_type string, value double")


@query("require_columns", sql=f"select row_key, {', '.join(NUMERIC_FEATURES)} from ({LINE_CHARGE_SQL}) lc")
def q_require_columns(spark, sf_dir):
    """The inputs of a table that has them all (a table without is an error that names them, see the tests)."""
    from tabreg.operators.columns import require_columns
    lc = line_charge(spark, sf_dir)
    require_columns(lc, NUMERIC_FEATURES)
    return lc.select("row_key", *NUMERIC_FEATURES)
