"""Reshape operators: melt (unpivot), pivot with a known key list, transpose of small stat tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def melt(df: DataFrame, ids: Sequence[str], values: Sequence[str], var: str = "metric", value: str = "value",
         relabel: Mapping[str, str] | None = None) -> DataFrame:
    """Wide -> long (ids..., var, value); optional relabelling of the variable names. Narrow (no shuffle)."""
    cast = df.select(*ids, *[F.col(v).cast("double").alias(v) for v in values])
    out = cast.unpivot(list(ids), list(values), var, value)
    if relabel:
        m = F.create_map(*[x for k, v in relabel.items() for x in (F.lit(k), F.lit(v))])
        out = out.withColumn(var, F.coalesce(m[F.col(var)], F.col(var)))
    return out


def pivot_long(long: DataFrame, ids: Sequence[str], key: str, value: str, keys: Sequence[str]) -> DataFrame:
    """Long -> wide with one column per known key (passing the keys avoids a distinct-values job)."""
    return long.groupBy(*ids).pivot(key, list(keys)).agg(F.first(value))


def transpose(df: DataFrame, id_col: str, ids: Sequence[str], value_cols: Sequence[str],
              stat_col: str = "stat") -> DataFrame:
    """Rows <-> columns for a small table: one row per value column, one column per id."""
    long = melt(df, [id_col], value_cols, stat_col, "__v")
    return pivot_long(long, [stat_col], id_col, "__v", ids)
