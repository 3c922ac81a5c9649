"""Table loading and the derived feature tables used as stand-ins for the regression source table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabreg.functions.stats import hash_bucket

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

# Feature layout of the line_charge stand-in table.
LINE_KEY_PARTS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity_int")
NUMERIC_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]
CATEGORICAL_FEATURES = ["l_returnflag", "l_linestatus"]
INTERACTION = ("price_discount", "l_extendedprice", "l_discount")
TARGET = "charge"
SPLIT_SALT = "split42"
FOLD_SALT = "fold42"
TEST_PERCENT = 20


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def row_key_expr() -> F.Column:
    """Five-part key, unique on lineitem (order, part, supplier, line number, whole quantity)."""
    return F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                       F.floor("l_quantity").cast("bigint"))


def line_charge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as a regression table: 7 raw features, target ``charge``, one key column."""
    li = load(spark, sf_dir, "lineitem")
    return li.select(
        row_key_expr().alias("row_key"),
        *[F.col(c).cast("double") if c != "l_linenumber" else F.col(c) for c in NUMERIC_FEATURES],
        *CATEGORICAL_FEATURES,
        (F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))).alias(TARGET),
    )


def with_split(df: DataFrame, key: str = "row_key", salt: str = SPLIT_SALT,
               test_percent: int = TEST_PERCENT) -> DataFrame:
    """Adds ``split`` = 'test' / 'train' from a hash of the key (no shuffle, no dependence on partitioning)."""
    return df.withColumn(
        "split",
        F.when(hash_bucket(F.col(key), salt, 100) < test_percent, F.lit("test")).otherwise(F.lit("train")),
    )


def line_charge_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_split(line_charge(spark, sf_dir))


# SQL twins for the oracle (DuckDB dialect).
LINE_KEY_SQL = ("concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber, "
                "cast(floor(l_quantity) as bigint))")


def bucket_sql(key_sql: str, salt: str, modulo: int) -> str:
    return (f"cast(cast(('0x' || substr(md5(concat_ws('-', {key_sql}, '{salt}')), 1, 8)) as ubigint) "
            f"% {modulo} as integer)")


LINE_CHARGE_SQL = f"""
  select {LINE_KEY_SQL} as row_key,
         cast(l_quantity as double) as l_quantity, cast(l_extendedprice as double) as l_extendedprice,
         cast(l_discount as double) as l_discount, cast(l_tax as double) as l_tax, l_linenumber,
         l_returnflag, l_linestatus,
         l_extendedprice * (1 - l_discount) * (1 + l_tax) as charge
  from lineitem
"""

LINE_SPLIT_SQL = f"""
  select *, case when {bucket_sql('row_key', SPLIT_SALT, 100)} < {TEST_PERCENT} then 'test' else 'train' end as split
  from ({LINE_CHARGE_SQL}) lc
"""
