"""Column-level operators: required columns, strict / quarantining numeric casts, ordered selection,
numeric selection, drop-if-exists, domain rules. Schema-only operators run no job."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType


class MissingColumnsError(ValueError):
    pass


def require_columns(df: DataFrame, cols: Sequence[str], what: str = "input") -> None:
    """Raise naming every missing column (schema check only)."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise MissingColumnsError(f"{what} is missing required columns: {', '.join(missing)}")



def cast_numeric(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Strict cast to double: under ANSI mode a non-numeric value fails the job, naming the value."""
    return df.withColumns({c: F.col(c).cast("double") for c in cols})


def invalid_numeric_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Quarantine view of the cast: (column, n_values, n_invalid) in one aggregation."""
    aggs = []
    for i, c in enumerate(cols):
        aggs += [F.count(c).cast("bigint").alias(f"n{i}"),
                 F.count_if(F.col(c).isNotNull() & F.col(c).try_cast("double").isNull()).cast("bigint").alias(f"b{i}")]
    wide = df.agg(*aggs)
    return wide.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("n_values"), F.col(f"b{i}").alias("n_invalid"))
        for i, c in enumerate(cols)])).alias("kv")).select("kv.*")



def select_ordered(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    require_columns(df, cols)
    return df.select(*cols)


def drop_if_exists(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.drop(*[c for c in cols if c in df.columns])


def select_numeric(df: DataFrame) -> DataFrame:
    return df.select(*[f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)])


def add_interaction(df: DataFrame, name: str, a: str, b: str) -> DataFrame:
    """name = a * b (the input columns are kept unchanged)."""
    return df.withColumn(name, F.col(a) * F.col(b))


def rule_predicate(col: str, rule) -> Column:
    """A rule is (lo, hi) for an inclusive range or a set/list of allowed values."""
    c = F.col(col)
    if isinstance(rule, tuple):
        return c.between(rule[0], rule[1])
    return c.isin(*list(rule))


def domain_check(df: DataFrame, rules: Mapping[str, object]) -> DataFrame:
    """(column, rule, n_checked, n_violations) for every rule, one aggregation over the table."""
    aggs, names = [], []
    for i, (col, rule) in enumerate(rules.items()):
        aggs += [F.count(col).cast("bigint").alias(f"n{i}"),
                 F.count_if(F.col(col).isNotNull() & ~rule_predicate(col, rule)).cast("bigint").alias(f"v{i}")]
        text = f"between {rule[0]} and {rule[1]}" if isinstance(rule, tuple) else \
            "in {" + ", ".join(str(v) for v in sorted(rule)) + "}"
        names.append((col, text))
    wide = df.agg(*aggs)
    return wide.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(t).alias("rule"), F.col(f"n{i}").alias("n_checked"),
                 F.col(f"v{i}").alias("n_violations")) for i, (c, t) in enumerate(names)])).alias("kv")).select("kv.*")


# Domain of the line_charge stand-in features (TPC-H value ranges).
LINE_DOMAIN = {
    "l_quantity": (1.0, 50.0),
    "l_discount": (0.0, 0.10),
    "l_tax": (0.0, 0.08),
    "l_linenumber": (1, 7),
    "l_returnflag": {"A", "N", "R"},
    "l_linestatus": {"F", "O"},
}
