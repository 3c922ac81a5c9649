"""Table profiling operators: counts, missing and distinct values, describe, skew, kurtosis,
correlations, IQR outliers, histograms, box statistics, density and binned trends.

Design rules (for tables far larger than memory):
- per-column statistics are computed in ONE aggregation with k aggregate expressions (partial
  aggregation on every executor, a single small final merge); no ``count(distinct)`` fan-out;
- distinct counts and frequency tables come from ``groupBy(column, value)`` on a stacked (column,
  value) view, whose partial aggregation collapses repeated (hot) values before the shuffle;
- quantiles come from the distributed exact quantile operator, never from a single-task percentile;
- small per-column result tables (k rows) are joined back with ``broadcast`` (k is the number of
  profiled columns, a bound fixed by the caller).
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import (BooleanType, DateType, DecimalType, DoubleType, FloatType, NumericType,
                               TimestampNTZType, TimestampType)

from tabreg.cluster import arrow
from tabreg.functions.bands import band_skew, possible_type
from tabreg.functions.stats import sample_kurt, sample_skew
from tabreg.operators.quantile import exact_quantiles, long_values


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, NumericType) and f.name not in set(exclude)]


def pandas_dtype(dt, missing: bool = False) -> str:
    """Name of the pandas dtype a column of this Spark type would load as; integers with missing values load as
    floats, booleans with missing values and decimals as objects."""
    if isinstance(dt, (DoubleType, FloatType)):
        return "float64"
    if isinstance(dt, DecimalType):
        return "object"
    if isinstance(dt, NumericType):
        return "float64" if missing else "int64"
    if isinstance(dt, BooleanType):
        return "object" if missing else "bool"
    if isinstance(dt, (TimestampType, TimestampNTZType, DateType)):
        return "datetime64[ns]"
    return "object"


def _dtypes(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, full, holed, position): the dtype without and with missing values, one row per column."""
    return df.sparkSession.createDataFrame(
        [(c, pandas_dtype(df.schema[c].dataType), pandas_dtype(df.schema[c].dataType, True), i)
         for i, c in enumerate(cols)], "column string, full string, holed string, position int")


def _dtype() -> Column:
    return F.when(F.col("missing") > 0, F.col("holed")).otherwise(F.col("full")).alias("data_type")


def is_missing(df: DataFrame, c: str) -> Column:
    """NULL, or NaN for float columns (pandas ``isna``)."""
    dt = df.schema[c].dataType
    if isinstance(dt, (DoubleType, FloatType)):
        return F.col(c).isNull() | F.isnan(c)
    return F.col(c).isNull()


def _stack(pairs: Sequence[tuple[str, Column]], names=("column", "value")) -> Column:
    return F.explode(F.array(*[F.struct(F.lit(k).alias(names[0]), v.alias(names[1])) for k, v in pairs]))


def _per_column(df: DataFrame, cols: Sequence[str], stats: Mapping[str, Callable[[Column], Column]]) -> DataFrame:
    """(column, one field per statistic) of the non-missing values as doubles: one aggregation over the wide rows."""
    cols = list(dict.fromkeys(cols))
    value = lambda c: F.when(~F.isnan(c), F.col(c).cast("double"))
    wide = df.select(*[value(c).alias(f"v{i}") for i, c in enumerate(cols)]).agg(
        *[f(F.col(f"v{i}")).alias(f"{s}{i}") for i in range(len(cols)) for s, f in stats.items()])
    return wide.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), *[F.col(f"{s}{i}").alias(s) for s in stats]) for i, c in enumerate(cols)])).alias("kv")).select("kv.*")


def table_shape(df: DataFrame, target: str | None = None, n_features: int | None = None) -> DataFrame:
    """Rows, columns, feature count and target name as one row."""
    n_cols = len(df.columns)
    feats = n_features if n_features is not None else n_cols - (1 if target else 0)
    return df.agg(F.count(F.lit(1)).cast("bigint").alias("n_rows")).select(
        "n_rows", F.lit(n_cols).cast("bigint").alias("n_columns"),
        F.lit(feats).cast("bigint").alias("n_features"), F.lit(target).cast("string").alias("target"))


def missing_by_column(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(column, missing) for every column: one aggregation with one conditional count per column."""
    cols = list(cols or df.columns)
    wide = df.agg(*[F.count_if(is_missing(df, c)).cast("bigint").alias(f"m{i}") for i, c in enumerate(cols)])
    return wide.select(_stack([(c, F.col(f"m{i}")) for i, c in enumerate(cols)],
                              ("column", "missing")).alias("kv")).select("kv.column", "kv.missing")


def row_digest(cols: Sequence[str]) -> list[Column]:
    """Two independent digests of a row's canonical JSON serialisation (NULL fields kept by name)."""
    canon = F.to_json(F.struct(*[F.col(c) for c in cols]), {"ignoreNullFields": "false"})
    return [F.xxhash64(canon).alias("__h64"), F.sha2(canon, 256).alias("__h256")]


def duplicate_rows(df: DataFrame, cols: Sequence[str] | None = None, by_digest: bool = False) -> DataFrame:
    """Rows equal to an earlier row over ``cols`` (NULLs compare equal), as one count.

    ``by_digest=True`` groups on a 64-bit + 256-bit digest of each row instead of the row itself, so
    wide rows (long texts) are not shuffled; a false match would need both digests to collide.
    """
    cols = list(cols or df.columns)
    if by_digest:
        keyed = df.select(*row_digest(cols))
        groups = keyed.groupBy("__h64", "__h256").agg(F.count(F.lit(1)).alias("c"))
    else:
        groups = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("c"))
    return groups.agg(F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).cast("bigint").alias("duplicate_rows"))


def _typed_slots(df: DataFrame, c: str) -> tuple[Column, Column, Column]:
    """(integral, floating, text) slots of a value; exactly one is set, NULL in all = missing.

    Grouping on typed slots avoids formatting every double as text (and keeps 64-bit ids exact); NaN is
    missing and -0.0 is folded into 0.0 as pandas does.
    """
    dt = df.schema[c].dataType
    none_l, none_d, none_s = F.lit(None).cast("bigint"), F.lit(None).cast("double"), F.lit(None).cast("string")
    if isinstance(dt, (DoubleType, FloatType)):
        return none_l, F.when(~F.isnan(c), F.col(c).cast("double") + F.lit(0.0)), none_s
    if isinstance(dt, NumericType) and not isinstance(dt, DecimalType):
        return F.col(c).cast("bigint"), none_d, none_s
    return none_l, none_d, F.col(c).cast("string")


def value_frequencies(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(column, value, n) frequency table over all columns; NULL value = missing.

    Values are grouped in typed slots; only the distinct values are turned into text at the end.
    """
    cols = list(cols or df.columns)
    structs = []
    for c in cols:
        li, db, tx = _typed_slots(df, c)
        structs.append(F.struct(F.lit(c).alias("column"), li.alias("l"), db.alias("d"), tx.alias("s")))
    stacked = df.select(F.explode(F.array(*structs)).alias("kv")).select("kv.*")
    freq = stacked.groupBy("column", "l", "d", "s").agg(F.count(F.lit(1)).alias("n"))
    text = F.coalesce(F.col("l").cast("string"), F.col("d").cast("string"), F.col("s"))
    return freq.select("column", text.alias("value"), "n")


def _distinct_values(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, there, n): a row per distinct value and one for the missing ones, with its rows.

    Columns of one kind (integral, floating, text) are grouped together on their number and one slot: keys of numbers
    have a fixed width, and no value is turned into text.
    """
    kinds: dict[int, list] = {}
    for i, c in enumerate(cols):
        slots = _typed_slots(df, c)
        dt = df.schema[c].dataType
        kind = 1 if isinstance(dt, (DoubleType, FloatType)) else 0 if isinstance(dt, NumericType) and not isinstance(dt, DecimalType) else 2
        kinds.setdefault(kind, []).append((i, slots[kind]))
    counted = []
    for pairs in kinds.values():
        stacked = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), v.alias("v")) for i, v in pairs])).alias("kv")).select("kv.*")
        counted.append(stacked.groupBy("i", "v").agg(F.count(F.lit(1)).alias("n"))
                       .select(F.element_at(F.array(*[F.lit(c) for c in cols]), F.col("i") + 1).alias("column"), F.col("v").isNotNull().alias("there"), "n"))
    return functools.reduce(DataFrame.unionByName, counted)


def column_summary(df: DataFrame, cols: Sequence[str] | None = None, approximate: bool = False) -> DataFrame:
    """column, data_type, missing, unique_with_null, unique (pandas ``nunique`` with/without NaN).

    ``approximate=True`` uses HyperLogLog distinct counts in one pass (no value shuffle).
    """
    cols = list(cols or df.columns)
    types = _dtypes(df, cols)
    if approximate:
        wide = df.agg(*[F.approx_count_distinct(F.coalesce(*_typed_slots(df, c))).alias(f"u{i}")
                        for i, c in enumerate(cols)])
        uniq = wide.select(_stack([(c, F.col(f"u{i}")) for i, c in enumerate(cols)], ("column", "unique"))
                           .alias("kv")).select("kv.column", F.col("kv.unique").cast("bigint").alias("unique"))
        miss = missing_by_column(df, cols)
        stats = uniq.join(miss, "column").withColumn(
            "unique_with_null", F.col("unique") + (F.col("missing") > 0).cast("bigint"))
    else:
        stats = _distinct_values(df, cols).groupBy("column").agg(
            F.count_if("there").cast("bigint").alias("unique"),
            F.coalesce(F.sum(F.when(~F.col("there"), F.col("n"))), F.lit(0)).cast("bigint").alias("missing"),
        ).withColumn("unique_with_null", F.col("unique") + (F.col("missing") > 0).cast("bigint"))
    return (F.broadcast(types).join(stats, "column", "left")
            .select("column", _dtype(), "missing", "unique_with_null", "unique", "position"))


def profile_join(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Column / dtype table left-joined to the missing table and the distinct (with NULL) table."""
    cols = list(cols or df.columns)
    types = _dtypes(df, cols)
    miss = missing_by_column(df, cols)
    uniq = distinct_counts(df, cols, dropna=False)
    return (F.broadcast(types).join(miss, "column", "left").join(uniq, "column", "left")
            .select("column", _dtype(), "missing", F.col("unique").alias("unique_values")))


def distinct_counts(df: DataFrame, cols: Sequence[str] | None = None, dropna: bool = True) -> DataFrame:
    """(column, unique): pandas ``nunique()`` (dropna=True) or ``nunique(dropna=False)``."""
    freq = value_frequencies(df, cols)
    uniq = F.count("value") if dropna else F.count(F.lit(1))
    return freq.groupBy("column").agg(uniq.cast("bigint").alias("unique"))


def unique_value_types(df: DataFrame, cols: Sequence[str] | None = None, limit: int = 10) -> DataFrame:
    """(column, unique, possible_type): discrete when at most ``limit`` distinct values."""
    return distinct_counts(df, cols).withColumn("possible_type", possible_type(F.col("unique"), limit))


def describe_numeric(df: DataFrame, cols: Sequence[str] | None = None, accuracy: int | None = None) -> DataFrame:
    """pandas ``describe()`` transposed: column, count, mean, std, min, q25, q50, q75, max (exact quartiles)."""
    cols = list(cols or numeric_columns(df))
    moments = _per_column(df, cols, {
        "count": lambda v: F.count(v).cast("bigint"), "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max})
    q = exact_quantiles(df, cols, [0.25, 0.5, 0.75], accuracy).groupBy("column").agg(
        *[F.max(F.when(F.col("p") == p, F.col("value"))).alias(n)
          for p, n in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75"))])
    names = df.sparkSession.createDataFrame([(c,) for c in cols], "column string")
    return (F.broadcast(names).join(moments, "column", "left").join(q, "column", "left")
            .fillna(0, ["count"])
            .select("column", "count", "mean", "std", "min", "q25", "q50", "q75", "max"))


def describe_text(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``describe(include='all')`` part for text columns: column, count, unique, top, freq.

    ``top`` is the most frequent value; ties go to the smallest value (pandas leaves ties to hash
    order). Found with ``min(struct(-n, value))`` in the same aggregation as count and unique, so no task
    ever holds all distinct values of a column.
    """
    freq = value_frequencies(df, cols).where(F.col("value").isNotNull())
    agg = freq.groupBy("column").agg(
        F.sum("n").cast("bigint").alias("count"), F.count(F.lit(1)).cast("bigint").alias("unique"),
        F.min(F.struct((-F.col("n")).alias("neg_n"), F.col("value").alias("v"))).alias("best"))
    return agg.select("column", "count", "unique", F.col("best.v").alias("top"),
                      (-F.col("best.neg_n")).cast("bigint").alias("freq"))


def target_summary(df: DataFrame, target: str, accuracy: int | None = None) -> DataFrame:
    """(stat, value) rows: mean, median, std, min, max, skew of the target."""
    y = F.when(~F.isnan(target), F.col(target).cast("double"))
    one = df.agg(F.avg(y).alias("mean"), F.stddev_samp(y).alias("std"), F.min(y).alias("min"),
                 F.max(y).alias("max"), sample_skew(y).alias("skew"))
    med = exact_quantiles(df, [target], [0.5], accuracy).select(F.col("value").alias("median"))
    wide = one.crossJoin(med)
    stats = ["mean", "median", "std", "min", "max", "skew"]
    return wide.select(_stack([(s, F.col(s)) for s in stats], ("stat", "value")).alias("kv")).select(
        "kv.stat", "kv.value")


def moment_table(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(column, n, skewness, kurtosis) with bias-corrected skew and excess kurtosis; one pass."""
    cols = list(cols or numeric_columns(df))
    return _per_column(df, cols, {"n": lambda v: F.count(v).cast("bigint"), "skewness": sample_skew,
                                  "kurtosis": sample_kurt}).where(F.col("n") > 0)


def skewness_table(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """column, skewness, abs_skewness, interpretation; ordered by abs_skewness desc then column."""
    m = moment_table(df, cols)
    return (m.select("column", "skewness", F.abs("skewness").alias("abs_skewness"))
            .withColumn("interpretation", band_skew(F.col("abs_skewness")))
            .orderBy(F.col("abs_skewness").desc_nulls_last(), "column"))


def iqr_bounds(df: DataFrame, cols: Sequence[str], threshold: float = 1.5,
               accuracy: int | None = None) -> DataFrame:
    """(column, q1, q3, iqr, lower, upper) with exact linear quartiles."""
    q = exact_quantiles(df, cols, [0.25, 0.75], accuracy).groupBy("column").agg(
        F.max(F.when(F.col("p") == 0.25, F.col("value"))).alias("q1"),
        F.max(F.when(F.col("p") == 0.75, F.col("value"))).alias("q3"))
    iqr = F.col("q3") - F.col("q1")
    return q.select("column", "q1", "q3", iqr.alias("iqr"), (F.col("q1") - threshold * iqr).alias("lower"),
                    (F.col("q3") + threshold * iqr).alias("upper"))


def outlier_rows(df: DataFrame, column: str, threshold: float = 1.5, accuracy: int | None = None) -> DataFrame:
    """Rows of ``df`` with value strictly outside [q1 - t*iqr, q3 + t*iqr] (one-row bounds broadcast)."""
    b = iqr_bounds(df, [column], threshold, accuracy).select("lower", "upper")
    return (df.crossJoin(F.broadcast(b))
            .where((F.col(column) < F.col("lower")) | (F.col(column) > F.col("upper")))
            .drop("lower", "upper"))


def iqr_outlier_summary(df: DataFrame, cols: Sequence[str] | None = None, threshold: float = 1.5,
                        accuracy: int | None = None) -> DataFrame:
    """column, outlier_count, outlier_pct (2 dp, of all rows), lower and upper bound (4 dp)."""
    cols = list(cols or numeric_columns(df))
    b = iqr_bounds(df, cols, threshold, accuracy)
    own = list(dict.fromkeys(cols))
    pick = lambda c, name: F.max(F.when(F.col("column") == c, F.col(name)))
    bounds = b.agg(*[pick(c, name).alias(f"__{name}{i}") for i, c in enumerate(own) for name in ("lower", "upper")])  # one row
    outside = lambda i, c: (F.col(c).cast("double") < F.col(f"__lower{i}")) | (F.col(c).cast("double") > F.col(f"__upper{i}"))
    wide = df.select(*own).crossJoin(F.broadcast(bounds)).agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(outside(i, c)).cast("bigint").alias(f"o{i}") for i, c in enumerate(own)]).where("n > 0")
    counts = wide.select("n", _stack([(c, F.col(f"o{i}")) for i, c in enumerate(own)], ("column", "outlier_count")).alias("kv")).select("kv.*", "n")
    return (counts.join(b, "column")
            .select("column", "outlier_count",
                    F.round(F.col("outlier_count") / F.col("n") * 100, 2).alias("outlier_pct"),
                    F.round("lower", 4).alias("lower_bound"), F.round("upper", 4).alias("upper_bound"))
            .orderBy(F.col("outlier_count").desc(), "column"))


PAIR_SUMS = "a int, b int, n double, sa double, sb double, saa double, sbb double, sab double"


def _gram(centres: list[float]):
    """Per task, the sums of every column pair over rows where both values are present: matrix products of the
    centred values and the presence masks, one row per pair."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        k, acc = len(centres), None
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns])
            there = ~np.isnan(x)
            x, m = np.where(there, x - np.array(centres), 0.0), there.astype(float)
            part = np.stack([m.T @ m, x.T @ m, (x * x).T @ m, x.T @ x])
            acc = part if acc is None else acc + part
        if acc is not None:
            a, b = np.triu_indices(k, 1)
            n, s, q, p = acc
            yield pa.RecordBatch.from_arrays(
                [pa.array(a, pa.int32()), pa.array(b, pa.int32()), *(pa.array(v) for v in (
                    n[a, b], s[a, b], s[b, a], q[a, b], q[b, a], p[a, b]))], ["a", "b", "n", "sa", "sb", "saa", "sbb", "sab"])
    return run


def _pair_corr(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(a, b, r) for every column pair a < b (positions in ``cols``): Pearson r over pairwise complete rows, NULL
    for a constant side.

    One aggregation gives the means as centring constants (a number per column), one pass over Arrow batches the
    sums of all pairs: work is a few matrix products per batch at any width, and a task sends one row per pair.
    """
    x = [F.when(~F.isnan(c), F.col(c).cast("double")) for c in cols]
    means = df.agg(*[F.avg(v).alias(f"m{i}") for i, v in enumerate(x)]).first()
    sums = (df.select(*[v.alias(f"x{i}") for i, v in enumerate(x)]).mapInArrow(_gram([float(m or 0.0) for m in means]), PAIR_SUMS)
            .groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in ("n", "sa", "sb", "saa", "sbb", "sab")]))
    n = F.col("n")
    vaa, vbb = n * F.col("saa") - F.col("sa") * F.col("sa"), n * F.col("sbb") - F.col("sb") * F.col("sb")
    cov = n * F.col("sab") - F.col("sa") * F.col("sb")
    return sums.select("a", "b", F.when((vaa > 0) & (vbb > 0), cov / F.sqrt(vaa * vbb)).alias("r"))


def _named(position: str, cols: Sequence[str]) -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in cols]), F.col(position) + 1)


def corr_matrix(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Lower triangle of the Pearson matrix: (column_a, column_b, r) for a before b."""
    cols = list(cols or numeric_columns(df))
    return _pair_corr(df, cols).select(_named("a", cols).alias("column_a"), _named("b", cols).alias("column_b"), "r")


def corr_target(df: DataFrame, target: str, cols: Sequence[str] | None = None) -> DataFrame:
    """column, r, abs_r against the target, ordered by abs_r desc then column: one aggregation, a column each."""
    cols = [c for c in (cols or numeric_columns(df)) if c != target]
    value = lambda c: F.when(~F.isnan(c), F.col(c).cast("double"))
    y = value(target)
    means = df.agg(F.avg(y).alias("y"), *[F.avg(value(c)).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    aggs = []
    for i, c in enumerate(cols):
        a, b = value(c) - F.lit(float(means[f"m{i}"] or 0.0)), y - F.lit(float(means["y"] or 0.0))
        a, b = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
        aggs += [F.count(a).cast("double").alias(f"n{i}"), F.sum(a).alias(f"sa{i}"), F.sum(b).alias(f"sb{i}"),
                 F.sum(a * a).alias(f"saa{i}"), F.sum(b * b).alias(f"sbb{i}"), F.sum(a * b).alias(f"sab{i}")]

    def r(i: int) -> Column:
        n, sa, sb, saa, sbb, sab = (F.col(f"{k}{i}") for k in ("n", "sa", "sb", "saa", "sbb", "sab"))
        vaa, vbb = n * saa - sa * sa, n * sbb - sb * sb
        return F.when((vaa > 0) & (vbb > 0), (n * sab - sa * sb) / F.sqrt(vaa * vbb))

    return (df.agg(*aggs).select(_stack([(c, r(i)) for i, c in enumerate(cols)], ("column", "r")).alias("kv"))
            .select("kv.column", "kv.r").withColumn("abs_r", F.abs("r"))
            .orderBy(F.col("abs_r").desc_nulls_last(), "column"))


def category_levels(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, level, n): one row per distinct non-missing value; no bound on their number."""
    return (value_frequencies(df, cols).where(F.col("value").isNotNull())
            .select("column", F.col("value").alias("level"), F.col("n").cast("bigint").alias("n")))


def category_summary(df: DataFrame, cols: Sequence[str], max_levels: int) -> DataFrame:
    """column, unique_count, categories (sorted distinct values joined by ','); missing excluded.

    The caller states the most levels that one row may list; a column with more raises when the row is made
    (``category_levels`` lists any number).
    """
    freq = value_frequencies(df, cols).where(F.col("value").isNotNull())
    counted = freq.groupBy("column").agg(F.count(F.lit(1)).alias("unique_count"))
    bounded = freq.join(F.broadcast(counted), "column").withColumn("value", F.when(  # one row per column
        F.col("unique_count") <= max_levels, F.col("value")).otherwise(F.raise_error(F.concat(
            F.lit("column "), "column", F.lit(f" has more than {max_levels} levels")))))
    numeric = {c for c in cols if isinstance(df.schema[c].dataType, NumericType)}
    sort_key = F.when(F.col("column").isin(*numeric) if numeric else F.lit(False),
                      F.col("value").cast("double"))
    levels = bounded.groupBy("column").agg(
        F.sort_array(F.collect_list(F.struct(sort_key.alias("k"), F.col("value").alias("v")))).alias("lv"))
    return levels.select("column", F.size("lv").cast("bigint").alias("unique_count"),
                         F.array_join(F.transform("lv", lambda s: s["v"]), ",").alias("categories"))


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """Equal-width histogram over [min, max]: bin, lo, hi, count (last bin closed; numpy rule)."""
    x = F.when(~F.isnan(column), F.col(column).cast("double"))
    base = df.select(x.alias("x")).where(F.col("x").isNotNull())
    rng = base.agg(F.min("x").alias("lo_all"), F.max("x").alias("hi_all"))
    width = (F.col("hi_all") - F.col("lo_all")) / bins
    binned = base.crossJoin(F.broadcast(rng)).withColumn(
        "bin", F.when(width == 0, F.lit(0)).otherwise(
            F.least(F.floor((F.col("x") - F.col("lo_all")) / width), F.lit(bins - 1))).cast("int"))
    counts = binned.groupBy("bin").agg(F.count(F.lit(1)).cast("bigint").alias("count"))
    grid = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return (grid.crossJoin(F.broadcast(rng)).join(counts, "bin", "left").fillna(0, ["count"])
            .select("bin", (F.col("lo_all") + F.col("bin") * width).alias("lo"),
                    (F.col("lo_all") + (F.col("bin") + 1) * width).alias("hi"), "count"))


def box_stats(df: DataFrame, cols: Sequence[str], whisker: float = 1.5, accuracy: int | None = None) -> DataFrame:
    """column, min, q1, median, q3, max, lower_whisker, upper_whisker (whiskers: furthest points inside fences)."""
    q = exact_quantiles(df, cols, [0.25, 0.5, 0.75], accuracy).groupBy("column").agg(
        *[F.max(F.when(F.col("p") == p, F.col("value"))).alias(n)
          for p, n in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))])
    iqr = F.col("q3") - F.col("q1")
    fences = q.select("column", "q1", "median", "q3", (F.col("q1") - whisker * iqr).alias("lf"),
                      (F.col("q3") + whisker * iqr).alias("uf"))
    long = long_values(df, cols)
    agg = (long.join(F.broadcast(fences.select("column", "lf", "uf")), "column").groupBy("column").agg(
        F.min("value").alias("min"), F.max("value").alias("max"),
        F.min(F.when(F.col("value") >= F.col("lf"), F.col("value"))).alias("lower_whisker"),
        F.max(F.when(F.col("value") <= F.col("uf"), F.col("value"))).alias("upper_whisker")))
    return fences.join(agg, "column").select("column", "min", "q1", "median", "q3", "max",
                                             "lower_whisker", "upper_whisker")


def density_curve(df: DataFrame, column: str, grid_points: int = 64, bins: int = 256) -> DataFrame:
    """Gaussian kernel density on an even grid over [min, max], Scott bandwidth (n^-1/5 * sample std).

    Binned KDE: the data are first reduced to ``bins`` equal-width bin centres with counts (one
    distributed aggregation), then the grid (``grid_points`` rows) is evaluated against the bin
    centres: grid_points * bins work, independent of the row count.
    """
    x = F.when(~F.isnan(column), F.col(column).cast("double"))
    base = df.select(x.alias("x")).where(F.col("x").isNotNull())
    st = base.agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count(F.lit(1)).alias("n"),
                  F.stddev_samp("x").alias("sd"))
    width = (F.col("hi") - F.col("lo")) / bins
    centres = (base.crossJoin(F.broadcast(st))
               .withColumn("b", F.when(width == 0, F.lit(0)).otherwise(
                   F.least(F.floor((F.col("x") - F.col("lo")) / width), F.lit(bins - 1))).cast("int"))
               .groupBy("b").agg(F.count(F.lit(1)).alias("c")))
    spark = df.sparkSession
    grid = spark.range(grid_points).select(F.col("id").cast("int").alias("g"))
    h = F.col("sd") * F.pow(F.col("n").cast("double"), F.lit(-0.2))
    gx = F.col("lo") + F.col("g") * (F.col("hi") - F.col("lo")) / (grid_points - 1)
    cx = F.col("lo") + (F.col("b") + 0.5) * width
    joined = grid.crossJoin(F.broadcast(st)).crossJoin(F.broadcast(centres))
    z = (gx - cx) / h
    return (joined.groupBy("g").agg(
        F.first(gx).alias("x"),
        (F.sum(F.col("c") * F.exp(-0.5 * z * z)) / (F.first(F.col("n")) * F.first(h) * F.sqrt(F.lit(2 * 3.141592653589793))))
        .alias("density"))
        .select(F.col("g").alias("point"), "x", "density"))


def binned_trend(df: DataFrame, x: str, y: str, bins: int = 20) -> DataFrame:
    """Equal-width bins of x with avg(y) and count per bin: a distributed stand-in for a smoother."""
    xv = F.col(x).cast("double")
    base = df.select(xv.alias("x"), F.col(y).cast("double").alias("y")).where(
        F.col("x").isNotNull() & ~F.isnan("x") & F.col("y").isNotNull())
    rng = base.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    return (base.crossJoin(F.broadcast(rng))
            .withColumn("bin", F.when(width == 0, F.lit(0)).otherwise(
                F.least(F.floor((F.col("x") - F.col("lo")) / width), F.lit(bins - 1))).cast("int"))
            .groupBy("bin").agg(F.avg("x").alias("x_mean"), F.avg("y").alias("y_mean"),
                                F.count(F.lit(1)).cast("bigint").alias("count")))


LOWESS_POWERS = 12  # |d|^9 of the weights times d^2


def _cell_powers(breaks: np.ndarray):
    """Per cell of x: sums of t^k and y t^k, t the place in the cell from -1 to 1."""
    def run(batches):
        total = np.zeros((2, LOWESS_POWERS, len(breaks) + 1))
        for batch in batches:
            x, y = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            cell = np.searchsorted(breaks, x)
            mid, half = _cells(breaks)
            t, p = (x - mid[cell]) / half[cell], np.ones(len(x))
            for k in range(LOWESS_POWERS):
                total[0, k] += np.bincount(cell, p, len(breaks) + 1)
                total[1, k] += np.bincount(cell, p * y, len(breaks) + 1)
                p = p * t
        k, cell = np.nonzero(total.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(k, pa.int32()), pa.array(total[0, k, cell]),
                                          pa.array(total[1, k, cell])], ["cell", "k", "s", "sy"])
    return run


def _cells(breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.concatenate([breaks[:1], breaks, breaks[-1:]])
    half = (edges[1:] - edges[:-1]) / 2
    return (edges[1:] + edges[:-1]) / 2, np.where(half > 0, half, 1.0)


def lowess(df: DataFrame, x: str, y: str, points: int = 25, frac: float = 2 / 3) -> DataFrame:
    """Locally weighted line of y on x at an even grid over [min, max]: (point, x, bandwidth, trend).

    The window of a grid point holds the nearest ceil(frac n) rows (bandwidth: distance to the last of them, exact),
    with tricube weights and no robustness rounds. On either side of the point the weights are a polynomial in the distance,
    so all sums come from power sums per cell, the cells being cut at the points and the ends of their windows: one
    read for the bandwidths' quantiles, one for the power sums, no pairs of rows. A window of one x value gives its mean.
    """
    clean = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    base = df.select(clean(x).alias("x"), clean(y).alias("y")).where("x is not null and y is not null")
    st = base.agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("n")).first()
    schema = "point int, x double, bandwidth double, trend double"
    if not st["n"]:
        return df.sparkSession.createDataFrame([], schema)
    grid = st["lo"] + np.arange(points) * (st["hi"] - st["lo"]) / max(points - 1, 1)
    n = st["n"]
    k = min(n, max(1, math.ceil(frac * n - 1e-9)))
    away = base.select(*[F.abs(F.col("x") - F.lit(float(g))).alias(f"d{i}") for i, g in enumerate(grid)])
    p = (k - 1) / (n - 1) if n > 1 else 0.0
    width = {r["column"]: r["value"] for r in exact_quantiles(away, away.columns, [p]).collect()}  # a row per point
    h = np.array([width[f"d{i}"] for i in range(points)])
    breaks = np.unique(np.concatenate([grid, grid - h, grid + h]))
    rows = (base.transform(arrow, _cell_powers(breaks), "cell int, k int, s double, sy double").groupBy("cell", "k")
            .agg(F.sum("s").alias("s"), F.sum("sy").alias("sy")).collect())  # cells x powers
    sums = np.zeros((2, LOWESS_POWERS, len(breaks) + 1))
    for r in rows:
        sums[0, r["k"], r["cell"]], sums[1, r["k"], r["cell"]] = r["s"], r["sy"]
    mid, half = _cells(breaks)
    out = []
    for i, g in enumerate(grid.tolist()):
        trend = _local_line(g, h[i], breaks, mid, half, sums) if h[i] > 0 else None
        if trend is None:
            trend = base.where(F.col("x") == F.lit(g)).agg(F.avg("y")).first()[0]
        out.append((i, g, float(h[i]), None if trend is None else float(trend)))
    return df.sparkSession.createDataFrame(out, schema)


def _local_line(g: float, h: float, breaks: np.ndarray, mid: np.ndarray, half: np.ndarray, sums: np.ndarray) -> float | None:
    """Value at ``g`` of the line fitted with tricube weights of bandwidth ``h``."""
    w = np.zeros((2, 3))  # weighted sums of u^j and y u^j, u = (x - g) / h
    first, last = np.searchsorted(breaks, g - h), np.searchsorted(breaks, g + h)
    for cell in range(first + 1, last + 1):  # cells between the window's ends (searchsorted: a cell holds its upper end)
        a, b = (mid[cell] - g) / h, half[cell] / h
        side = -1.0 if breaks[cell] <= g else 1.0
        u = np.zeros((2, LOWESS_POWERS))
        for p in range(LOWESS_POWERS):
            for q in range(p + 1):
                u[:, p] += math.comb(p, q) * a ** (p - q) * b ** q * sums[:, q, cell]
        for i in range(4):
            w += math.comb(3, i) * (-1) ** i * side ** i * u[:, 3 * i:3 * i + 3]
    (s0, s1, s2), (y0, y1, _) = w
    if not s0 > 0:
        return None
    det = s0 * s2 - s1 * s1
    return (s2 * y0 - s1 * y1) / det if det > 1e-12 * s0 * s0 else y0 / s0
