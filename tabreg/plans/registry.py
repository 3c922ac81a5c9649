"""Query registry: each registered query is a Spark plan over the given tables plus (when the result
is expressible in SQL) the DuckDB text that must return the same rows.

Doubles are rounded to 9 significant digits on both sides (``rounded`` / ``r6``) so sums taken in
different orders agree.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from tabreg.functions.stats import sig_round, sig_round_sql

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    fn: QueryFn
    sql: str | None
    doc: str


REGISTRY: dict[str, Query] = {}
FUSED = 2  # rounded columns of one whole-stage method


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name`` with its oracle SQL (or None)."""
    def deco(fn: QueryFn) -> QueryFn:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, fn, sql, (fn.__doc__ or "").strip())
        return fn
    return deco


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    """Round every float/double column to significant digits (and fold -0.0) for comparison.

    With more than ``FUSED`` such columns the first is handed on by a lambda and rounded after the others: Spark does not
    fuse a projection with a lambda into its whole-stage method, which would be too long for the JVM to compile.
    """
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, (DoubleType, FloatType))]
    late = names[:1] if len(names) > FUSED else []
    first = df.select(*[F.transform(F.array(c), lambda x: x).alias(c) if c in late
                        else sig_round(F.col(c), digits).alias(c) if c in names else F.col(c) for c in df.columns])
    return first.withColumns({c: sig_round(F.get(c, F.lit(0)), digits) for c in late}) if late else first


def r6(expr: str) -> str:
    """SQL twin of ``rounded`` for one expression (9 significant digits)."""
    return sig_round_sql(expr, 9)
