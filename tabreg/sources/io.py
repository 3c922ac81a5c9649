"""Readers and writers: CSV / JSON / parquet scans with declared schemas, CSV / JSON sinks with checks.

Reads are lazy and distributed (``spark.read``); writes are distributed (one file per partition).
Nothing here collects data to the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, StructType

from tabreg.operators.columns import require_columns


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.globStatus(p)) and len(fs.globStatus(p)) > 0


def first_existing(spark: SparkSession, candidates: Sequence[str]) -> str:
    for c in candidates:
        if _exists(spark, c):
            return c
    raise FileNotFoundError("none of these paths exists: " + ", ".join(candidates))


def strip_names(df: DataFrame) -> DataFrame:
    """Trim surrounding whitespace from column names (schema only)."""
    return df.withColumnsRenamed({c: c.strip() for c in df.columns if c != c.strip()})


def scan_csv(spark: SparkSession, candidates: Sequence[str] | str, schema: StructType | None = None,
             check_non_empty: bool = True) -> DataFrame:
    """First existing of several paths, header row, declared schema (no inference pass), names trimmed,
    error if the table has no rows."""
    path = first_existing(spark, [candidates] if isinstance(candidates, str) else list(candidates))
    reader = spark.read.option("header", True)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", False)
    df = strip_names(reader.csv(path))
    if check_non_empty and df.isEmpty():
        raise ValueError(f"{path} has no rows")
    return df


def scan_batch(spark: SparkSession, path: str, required: Sequence[str]) -> DataFrame:
    """Uploaded batch to score: required columns must exist and are cast strictly to double; extra
    columns are kept as they are."""
    return checked_batch(spark.read.option("header", True).csv(path), required)


def checked_batch(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """A batch of text columns: names trimmed, required columns there and cast strictly to double, others kept."""
    df = strip_names(df)
    require_columns(df, required, "batch")
    return df.withColumns({c: F.col(f"`{c}`").cast("double") for c in required})


def parse_csv(lines: DataFrame, column: str, schema: str) -> DataFrame:
    """Rows of CSV text in ``column``, by a declared schema."""
    return lines.select(F.from_csv(column, schema).alias("__row")).select("__row.*")


def parse_json(lines: DataFrame, column: str, schema: str) -> DataFrame:
    """Rows of JSON text in ``column``, by a declared schema."""
    return lines.select(F.from_json(column, schema).alias("__row")).select("__row.*")


def scan_json(spark: SparkSession, path: str, schema: StructType | None = None,
              required: bool = True) -> DataFrame | None:
    """Multi-line JSON document(s); a missing optional file gives None, a missing required one a clear error."""
    if not _exists(spark, path):
        if required:
            raise FileNotFoundError(f"required JSON file not found: {path}")
        return None
    reader = spark.read.option("multiLine", True)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.json(path)


def sink_csv(df: DataFrame, path: str) -> None:
    """Header CSV, one file per partition, overwriting the folder."""
    df.write.mode("overwrite").option("header", True).csv(path)


def sink_json(df: DataFrame, path: str) -> None:
    """JSON lines. Every row is checked as it is written (one pass): a NaN or infinite value fails the write,
    names its column, and commits nothing."""
    def checked(f) -> Column:
        c = F.col(f"`{f.name}`")
        if not isinstance(f.dataType, (DoubleType, FloatType)):
            return c
        bad = F.isnan(c) | (F.abs(c) == float("inf"))
        return F.when(bad, F.raise_error(F.lit(f"non-finite values in: {f.name}")).cast(f.dataType)).otherwise(c).alias(f.name)

    try:
        df.select(*[checked(f) for f in df.schema.fields]).write.mode("overwrite").json(path)
    except Exception as exc:
        if "non-finite values in" in str(exc):
            name = str(exc).split("non-finite values in: ", 1)[1].split()[0]
            raise ValueError(f"non-finite values in: {name}") from exc
        raise
