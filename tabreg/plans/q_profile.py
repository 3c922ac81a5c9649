"""Registered queries: table profiling."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabreg.functions.bands import band_skew_sql, possible_type_sql
from tabreg.functions.stats import hash_bucket
from tabreg.operators import profile as P
from tabreg.plans.registry import query, r6, rounded
from tabreg.sources.tables import (LINE_CHARGE_SQL, LINE_SPLIT_SQL, NUMERIC_FEATURES, bucket_sql, line_charge,
                                   line_charge_split, load)

LC_NUM = [*NUMERIC_FEATURES, "charge"]
EV_NUM = ["event_id", "user_id", "value"]
DOC_COLS = ["doc_id", "lang", "source", "n_chars", "quality", "toxic"]


def doc_labels(spark, sf_dir):
    """documents left-joined to their labels (labels cover only some documents: real missing values)."""
    d = load(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    lab = load(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    return d.join(lab, "doc_id", "left").select(*DOC_COLS)


DOC_LABELS_SQL = ("(select d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic "
                  "from documents d left join labels l on d.doc_id = l.doc_id)")


def _union(parts):
    return " union all ".join(parts)


@query("table_shape", sql="""
  select cast(count(*) as bigint) as n_rows, cast(9 as bigint) as n_columns, cast(7 as bigint) as n_features,
         'charge' as target from lineitem""")
def q_table_shape(spark, sf_dir):
    """Rows, columns, feature count and target of the line_charge regression table."""
    return P.table_shape(line_charge(spark, sf_dir), target="charge", n_features=7)


@query("missing_by_column", sql="select * from (" + _union([
    f"select '{c}' as column, cast(count(*) - count({c}) as bigint) as missing from {DOC_LABELS_SQL}"
    for c in DOC_COLS]) + ")")
def q_missing_by_column(spark, sf_dir):
    """Missing values per column of documents left-joined to labels."""
    return P.missing_by_column(doc_labels(spark, sf_dir))


@query("duplicate_rows", sql="""
  select cast(coalesce(sum(c - 1), 0) as bigint) as duplicate_rows
  from (select count(*) as c from documents group by text, lang, source, n_chars)""")
def q_duplicate_rows(spark, sf_dir):
    """Rows of documents (all columns but the id) equal to an earlier row; rows are grouped by digest so
    long texts are not shuffled."""
    return P.duplicate_rows(load(spark, sf_dir, "documents").drop("doc_id"), by_digest=True)


@query("distinct_with_null", sql="select * from (" + _union([
    f"select '{c}' as column, cast(count(distinct {c}) + max(case when {c} is null then 1 else 0 end) as bigint) "
    f"as unique from {DOC_LABELS_SQL}" for c in DOC_COLS]) + ")")
def q_distinct_with_null(spark, sf_dir):
    """Distinct values per column counting missing as one value (pandas nunique(dropna=False))."""
    return P.distinct_counts(doc_labels(spark, sf_dir), dropna=False)


@query("distinct_no_null", sql="select * from (" + _union([
    f"select '{c}' as column, cast(count(distinct {c}) as bigint) as unique from {DOC_LABELS_SQL}"
    for c in DOC_COLS]) + ")")
def q_distinct_no_null(spark, sf_dir):
    """Distinct non-missing values per column (pandas nunique())."""
    return P.distinct_counts(doc_labels(spark, sf_dir), dropna=True)


def _doc_type(c: str) -> str:
    """SQL text: the dtype, derived from the column's kind and whether it has missing values."""
    if c in ("lang", "source"):
        return "'object'"
    return f"case when count(*) > count({c}) then 'float64' else 'int64' end"


@query("column_summary", sql="select * from (" + _union([
    f"select '{c}' as column, {_doc_type(c)} as data_type, cast(count(*) - count({c}) as bigint) as missing, "
    f"cast(count(distinct {c}) + max(case when {c} is null then 1 else 0 end) as bigint) as unique_with_null, "
    f"cast(count(distinct {c}) as bigint) as unique, {i} as position from {DOC_LABELS_SQL}"
    for i, c in enumerate(DOC_COLS)]) + ")")
def q_column_summary(spark, sf_dir):
    """Column, dtype, missing, distinct with and without missing: one stacked frequency pass."""
    return P.column_summary(doc_labels(spark, sf_dir))


@query("profile_join", sql="select * from (" + _union([
    f"select '{c}' as column, {_doc_type(c)} as data_type, cast(count(*) - count({c}) as bigint) as missing, "
    f"cast(count(distinct {c}) + max(case when {c} is null then 1 else 0 end) as bigint) as unique_values "
    f"from {DOC_LABELS_SQL}" for c in DOC_COLS]) + ")")
def q_profile_join(spark, sf_dir):
    """dtype table left-joined to missing counts and distinct counts on column name."""
    return P.profile_join(doc_labels(spark, sf_dir))


def _describe_sql(cols, source):
    parts = []
    for c in cols:
        parts.append(
            f"select '{c}' as column, cast(count({c}) as bigint) as count, {r6(f'avg({c})')} as mean, "
            f"{r6(f'stddev_samp({c})')} as std, {r6(f'min({c})')} as min, "
            f"{r6(f'quantile_cont({c}, 0.25)')} as q25, {r6(f'quantile_cont({c}, 0.5)')} as q50, "
            f"{r6(f'quantile_cont({c}, 0.75)')} as q75, {r6(f'max({c})')} as max from {source}")
    return "select * from (" + _union(parts) + ")"


@query("describe_numeric", sql=_describe_sql(LC_NUM, f"({LINE_CHARGE_SQL})"))
def q_describe_numeric(spark, sf_dir):
    """describe() of the line_charge numeric columns with exact linear quartiles."""
    return rounded(P.describe_numeric(line_charge(spark, sf_dir), LC_NUM))


@query("describe_all", sql="""
  with f as (select 'lang' as column, lang as value, count(*) as n from documents group by lang
             union all select 'source', source, count(*) from documents group by source),
  t as (select "column", value, n, row_number() over (partition by "column" order by n desc, value) as rk from f)
  select "column", cast(sum(n) as bigint) as count, cast(count(*) as bigint) as unique,
         max(case when rk = 1 then value end) as top, cast(max(case when rk = 1 then n end) as bigint) as freq
  from t group by 1""")
def q_describe_all(spark, sf_dir):
    """describe(include='all') text part (count, unique, top, freq) for the document categoricals."""
    return P.describe_text(load(spark, sf_dir, "documents"), ["lang", "source"])


@query("target_summary", sql=f"""
  with lc as ({LINE_CHARGE_SQL}),
  s as (select avg(charge) as mean, quantile_cont(charge, 0.5) as median, stddev_samp(charge) as std,
               min(charge) as min, max(charge) as max, skewness(charge) as skew from lc)
  select 'mean' as stat, {r6('mean')} as value from s union all select 'median', {r6('median')} from s
  union all select 'std', {r6('std')} from s union all select 'min', {r6('min')} from s
  union all select 'max', {r6('max')} from s union all select 'skew', {r6('skew')} from s""")
def q_target_summary(spark, sf_dir):
    """Mean, median, std, min, max and bias-corrected skew of the target (charge)."""
    return rounded(P.target_summary(line_charge(spark, sf_dir), "charge"))


@query("skewness_table", sql="select * from (" + _union([
    f"select '{c}' as column, {r6(f'skewness({c})')} as skewness, {r6(f'abs(skewness({c}))')} as abs_skewness, "
    f"{band_skew_sql(f'abs(skewness({c}))')} as interpretation from ({LINE_CHARGE_SQL})" for c in LC_NUM]) + ")")
def q_skewness_table(spark, sf_dir):
    """Bias-corrected skew per numeric column, its absolute value and interpretation band."""
    return rounded(P.skewness_table(line_charge(spark, sf_dir), LC_NUM))


@query("kurtosis_sample", sql="select * from (" + _union([
    f"select '{c}' as column, cast(count({c}) as bigint) as n, {r6(f'skewness({c})')} as skewness, "
    f"{r6(f'kurtosis({c})')} as kurtosis from events" for c in EV_NUM]) + ")")
def q_kurtosis_sample(spark, sf_dir):
    """Bias-corrected skew and excess kurtosis per events numeric column."""
    return rounded(P.moment_table(load(spark, sf_dir, "events"), EV_NUM))


_QP = [0.1, 0.25, 0.5, 0.75, 0.9]


@query("quantiles", sql="select * from (" + _union([
    f"select '{c}' as column, cast({p!r} as double) as p, cast(count({c}) as bigint) as n, {r6(f'quantile_cont({c}, {p!r})')} as value "
    f"from events" for c in ("value", "user_id") for p in _QP]) + ")")
def q_quantiles(spark, sf_dir):
    """Exact linear-interpolated deciles/quartiles of events.value and events.user_id (distributed)."""
    from tabreg.operators.quantile import exact_quantiles
    return rounded(exact_quantiles(load(spark, sf_dir, "events"), ["value", "user_id"], _QP))


def _iqr_sql(cols, source):
    parts = []
    for c in cols:
        parts.append(f"""select '{c}' as column,
          cast(count(*) filter (where {c} < q1 - 1.5 * (q3 - q1) or {c} > q3 + 1.5 * (q3 - q1)) as bigint) as outlier_count,
          {r6(f'round(count(*) filter (where {c} < q1 - 1.5 * (q3 - q1) or {c} > q3 + 1.5 * (q3 - q1)) / count(*) * 100, 2)')} as outlier_pct,
          {r6('round(any_value(q1) - 1.5 * (any_value(q3) - any_value(q1)), 4)')} as lower_bound,
          {r6('round(any_value(q3) + 1.5 * (any_value(q3) - any_value(q1)), 4)')} as upper_bound
          from {source}, (select quantile_cont({c}, 0.25) as q1, quantile_cont({c}, 0.75) as q3 from {source}) q""")
    return "select * from (" + _union(parts) + ")"


@query("iqr_outlier_summary", sql=_iqr_sql(EV_NUM, "events"))
def q_iqr_outlier_summary(spark, sf_dir):
    """IQR outliers per events numeric column: count, percent (2 dp), fences (4 dp)."""
    return rounded(P.iqr_outlier_summary(load(spark, sf_dir, "events"), EV_NUM))


@query("outlier_rows", sql="""
  select e.* from events e,
    (select quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.75) as q3 from events) q
  where e.value < q1 - 1.5 * (q3 - q1) or e.value > q3 + 1.5 * (q3 - q1)""")
def q_outlier_rows(spark, sf_dir):
    """events rows whose value lies strictly outside the 1.5 IQR fences."""
    return P.outlier_rows(load(spark, sf_dir, "events"), "value")


def _corr_sql(x, y):
    return (f"case when stddev_pop({x}) = 0 or stddev_pop({y}) = 0 then null "
            f"else corr({x}, {y}) end")


@query("corr_matrix", sql="select * from (" + _union([
    f"select '{a}' as column_a, '{b}' as column_b, {r6(_corr_sql(a, b))} as r from ({LINE_CHARGE_SQL})"
    for i, a in enumerate(LC_NUM) for b in LC_NUM[i + 1:]]) + ")")
def q_corr_matrix(spark, sf_dir):
    """Lower triangle of the Pearson matrix of line_charge numeric columns, one aggregation."""
    return rounded(P.corr_matrix(line_charge(spark, sf_dir), LC_NUM))


_CORR_TARGET_SQL = "select * from (" + _union([
    f"select '{c}' as column, {r6(_corr_sql(c, 'charge'))} as r, {r6('abs(' + _corr_sql(c, 'charge') + ')')} as abs_r "
    f"from ({LINE_CHARGE_SQL})" for c in NUMERIC_FEATURES]) + ")"


@query("corr_target", sql=_CORR_TARGET_SQL)
def q_corr_target(spark, sf_dir):
    """Correlation of each feature with the target, ordered by absolute value."""
    return rounded(P.corr_target(line_charge(spark, sf_dir), "charge", NUMERIC_FEATURES))


@query("corr_strength_filter", sql=f"""
  select "column", r, case when r >= 0.6 then 'strong positive' when r <= -0.6 then 'strong negative'
                         else 'moderate' end as strength
  from ({_CORR_TARGET_SQL}) where r >= 0.6 or r <= -0.6 or (abs(r) >= 0.3 and abs(r) < 0.6)""")
def q_corr_strength_filter(spark, sf_dir):
    """Features whose target correlation is strong (|r| >= .6) or moderate (.3 <= |r| < .6)."""
    from tabreg.operators.rank import corr_strength
    ct = rounded(P.corr_target(line_charge(spark, sf_dir), "charge", NUMERIC_FEATURES))
    return corr_strength(ct).select("column", "r", "strength")


@query("category_summary", sql="""
  select 'lang' as column, cast(count(distinct lang) as bigint) as unique_count,
         array_to_string(list_sort(list(distinct lang)), ',') as categories from documents
  union all select 'source', cast(count(distinct source) as bigint),
         array_to_string(list_sort(list(distinct source)), ',') from documents""")
def q_category_summary(spark, sf_dir):
    """Sorted distinct levels and level count of the document categoricals."""
    return P.category_summary(load(spark, sf_dir, "documents"), ["lang", "source"], max_levels=1000)


@query("histogram", sql=f"""
  with x as (select value as x from events where value is not null and not isnan(value)),
  r as (select min(x) as lo_all, max(x) as hi_all from x),
  b as (select cast(case when hi_all - lo_all = 0 then 0
                    else least(floor((x - lo_all) / ((hi_all - lo_all) / 30)), 29) end as integer) as bin,
               count(*) as c from x, r group by 1)
  select cast(g.bin as integer) as bin, {r6('lo_all + g.bin * ((hi_all - lo_all) / 30)')} as lo,
         {r6('lo_all + (g.bin + 1) * ((hi_all - lo_all) / 30)')} as hi, cast(coalesce(c, 0) as bigint) as count
  from range(30) g(bin) cross join r left join b on b.bin = g.bin""")
def q_histogram(spark, sf_dir):
    """30-bin equal-width histogram of events.value."""
    return rounded(P.histogram(load(spark, sf_dir, "events"), "value", 30))


@query("box_stats", sql="select * from (" + _union([f"""
  select '{c}' as column, {r6(f'min({c})')} as min, {r6('any_value(q1)')} as q1, {r6('any_value(med)')} as median,
         {r6('any_value(q3)')} as q3, {r6(f'max({c})')} as max,
         {r6(f'min({c}) filter (where {c} >= q1 - 1.5 * (q3 - q1))')} as lower_whisker,
         {r6(f'max({c}) filter (where {c} <= q3 + 1.5 * (q3 - q1))')} as upper_whisker
  from events, (select quantile_cont({c}, 0.25) as q1, quantile_cont({c}, 0.5) as med,
                       quantile_cont({c}, 0.75) as q3 from events) q""" for c in ("value", "user_id")]) + ")")
def q_box_stats(spark, sf_dir):
    """Five-number summary and 1.5 IQR whiskers of events.value and events.user_id."""
    return rounded(P.box_stats(load(spark, sf_dir, "events"), ["value", "user_id"]))


@query("density_curve", sql=f"""
  with x as (select value as x from events where value is not null and not isnan(value)),
  st as (select min(x) as lo, max(x) as hi, count(*) as n, stddev_samp(x) as sd from x),
  c as (select cast(case when (hi - lo) / 256 = 0 then 0 else least(floor((x - lo) / ((hi - lo) / 256)), 255) end
                    as integer) as b, count(*) as c from x, st group by 1),
  g as (select cast(range as integer) as g from range(64))
  select g.g as point, {r6('any_value(lo + g.g * (hi - lo) / 63)')} as x,
    {r6('''sum(c.c * exp(-0.5 * ((lo + g.g * (hi - lo) / 63) - (lo + (c.b + 0.5) * ((hi - lo) / 256))) / (sd * pow(n, -0.2))
                      * ((lo + g.g * (hi - lo) / 63) - (lo + (c.b + 0.5) * ((hi - lo) / 256))) / (sd * pow(n, -0.2))))
       / (any_value(n) * any_value(sd * pow(n, -0.2)) * sqrt(6.283185307179586))''')} as density
  from g cross join st cross join c group by g.g""")
def q_density_curve(spark, sf_dir):
    """Binned Gaussian KDE (Scott bandwidth) of events.value on a 64-point grid."""
    return rounded(P.density_curve(load(spark, sf_dir, "events"), "value", 64, 256))


@query("binned_trend", sql=f"""
  with lc as ({LINE_CHARGE_SQL}),
  r as (select min(l_extendedprice) as lo, max(l_extendedprice) as hi from lc)
  select cast(case when (hi - lo) / 20 = 0 then 0 else least(floor((l_extendedprice - lo) / ((hi - lo) / 20)), 19) end
              as integer) as bin,
         {r6('avg(l_extendedprice)')} as x_mean, {r6('avg(charge)')} as y_mean, cast(count(*) as bigint) as count
  from lc, r group by 1""")
def q_binned_trend(spark, sf_dir):
    """Trend of charge on l_extendedprice: 20 equal-width bins with mean x, mean y and count."""
    return rounded(P.binned_trend(line_charge(spark, sf_dir), "l_extendedprice", "charge", 20))


@query("lowess_trend", sql=f"""
  with lc as (select l_extendedprice as x, charge as y from ({LINE_CHARGE_SQL})),
  st as (select min(x) as lo, max(x) as hi, cast(ceil(2 * count(*) / 3.0 - 1e-9) as bigint) as k from lc),
  g as (select cast(range as integer) as point from range(25)),
  d as (select g.point, lo + g.point * (hi - lo) / 24 as xg, x - (lo + g.point * (hi - lo) / 24) as d, y, k,
               row_number() over (partition by g.point order by abs(x - (lo + g.point * (hi - lo) / 24))) as rn
        from lc cross join st cross join g),
  h as (select point, max(abs(d)) as h from d where rn = k group by point),
  w as (select d.point, xg, h, d / h as u, y, pow(1 - pow(abs(d / h), 3), 3) as w from d join h using (point) where abs(d) < h),
  s as (select point, any_value(xg) as xg, any_value(h) as h, sum(w) as s0, sum(w * u) as s1, sum(w * u * u) as s2, sum(w * y) as y0,
               sum(w * u * y) as y1 from w group by point)
  select point, {r6('xg')} as x, {r6('h')} as bandwidth, {r6('round((s2 * y0 - s1 * y1) / (s0 * s2 - s1 * s1), 2)')} as trend from s""")
def q_lowess_trend(spark, sf_dir):
    """Locally weighted trend of charge on l_extendedprice at 25 points, windows of two thirds of the rows."""
    out = P.lowess(line_charge(spark, sf_dir), "l_extendedprice", "charge")
    return rounded(out.withColumn("trend", F.round("trend", 2)))  # cents: the table's own precision


@query("pair_sample", sql=f"""
  select row_key, l_extendedprice, l_discount, l_quantity, l_tax, l_linenumber, charge
  from ({LINE_CHARGE_SQL}) where {bucket_sql('row_key', 'pair42', 100)} < 5""")
def q_pair_sample(spark, sf_dir):
    """Deterministic 5 % hash sample of the key features and target (scatter-matrix input)."""
    lc = line_charge(spark, sf_dir)
    return (lc.where(hash_bucket(F.col("row_key"), "pair42", 100) < 5)
            .select("row_key", "l_extendedprice", "l_discount", "l_quantity", "l_tax", "l_linenumber", "charge"))


@query("possible_type", sql="select * from (" + _union([
    f"select '{c}' as column, cast(count(distinct {c}) as bigint) as unique, "
    f"{possible_type_sql(f'count(distinct {c})')} as possible_type from ({LINE_CHARGE_SQL})"
    for c in [*NUMERIC_FEATURES, "l_returnflag", "l_linestatus"]]) + ")")
def q_possible_type(spark, sf_dir):
    """Distinct count per feature and discrete/continuous label (<= 10 distinct = discrete)."""
    return P.unique_value_types(line_charge(spark, sf_dir), [*NUMERIC_FEATURES, "l_returnflag", "l_linestatus"])


@query("dataset_size_counts", sql=f"""
  select split, cast(count(*) as bigint) as n_rows from ({LINE_SPLIT_SQL}) group by split""")
def q_dataset_size_counts(spark, sf_dir):
    """Train and test row counts of the hash split."""
    return line_charge_split(spark, sf_dir).groupBy("split").agg(F.count(F.lit(1)).cast("bigint").alias("n_rows"))
