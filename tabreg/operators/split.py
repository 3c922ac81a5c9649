"""Deterministic train/test split and fold assignment by key hash, plus split integrity checks.

A hash of the key decides each row, so the split does not depend on partitioning, row order or cluster
size, needs no shuffle, and a re-run (or another engine) selects the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabreg.functions.stats import hash_bucket


def hash_split(df: DataFrame, key: str, test_percent: int = 20, salt: str = "split42") -> DataFrame:
    return df.withColumn("split", F.when(hash_bucket(F.col(key), salt, 100) < test_percent, F.lit("test"))
                         .otherwise(F.lit("train")))


def kfold_hash(df: DataFrame, key: str, k: int = 5, salt: str = "fold42") -> DataFrame:
    """Shuffled folds: fold = hash(key, salt) mod k."""
    return df.withColumn("fold", hash_bucket(F.col(key), salt, k))


def global_rank(df: DataFrame, order_cols: list[str] | tuple[str, ...]) -> DataFrame:
    """Adds ``rank`` = 0-based position of each row in ``order_cols`` order (NULLs first, ties in any order).

    Distributed: whole rows are range-partitioned (sampled bounds, balanced partitions), sorted inside each
    partition and numbered locally (``monotonically_increasing_id`` keeps the partition id in its upper bits).
    That numbering is materialised once with a reliable ``checkpoint()`` (range bounds come from sampling, so
    two evaluations could partition differently); per-partition counts (one row per partition, broadcast) give
    each partition's offset. Every row is kept once, whatever its key, and no task holds more than one range
    partition; rows that share a key are spread by a hash of the row.
    """
    from tabreg.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(df.sparkSession)
    keys = list(order_cols)
    n_parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = df.withColumn("__tie", F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]))
    ids = (spread.repartitionByRange(n_parts, *keys, "__tie").sortWithinPartitions(*keys, "__tie")
           .withColumn("__pid", F.spark_partition_id())
           .withColumn("__mid", F.monotonically_increasing_id())
           .checkpoint(eager=True))
    local = F.col("__mid") - F.shiftleft(F.col("__pid").cast("bigint"), 33)
    counts = ids.groupBy("__pid").agg(F.count(F.lit(1)).alias("__c"))
    before = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = counts.select("__pid", F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__off"))
    return (ids.join(F.broadcast(offsets), "__pid").withColumn("rank", F.col("__off") + local)
            .select(*df.columns, "rank"))


def kfold_contiguous(df: DataFrame, order_cols: list[str] | tuple[str, ...], k: int = 5) -> DataFrame:
    """Unshuffled k folds over the key order with scikit-learn's sizes: the first n % k folds get
    n // k + 1 rows, the rest n // k. Adds ``fold`` (and keeps ``rank``)."""
    ranked = global_rank(df, order_cols)
    n = df.agg(F.count(F.lit(1)).alias("__n"))
    size, extra = F.floor(F.col("__n") / k), F.col("__n") % k
    big = extra * (size + 1)  # rows covered by the larger folds
    fold = F.when(F.col("rank") < big, F.floor(F.col("rank") / (size + 1))).otherwise(
        extra + F.floor((F.col("rank") - big) / size))
    return ranked.crossJoin(F.broadcast(n)).withColumn("fold", fold.cast("int")).drop("__n")


def split_overlap(train: DataFrame, test: DataFrame, key: str) -> DataFrame:
    """Keys present on both sides (must be empty)."""
    return train.select(key).intersect(test.select(key))


def split_cover(full: DataFrame, train: DataFrame, test: DataFrame) -> DataFrame:
    """(missing_rows, extra_rows): rows of the table not in train+test, and rows in train+test not in
    the table, with multiplicity (both must be 0)."""
    both = train.unionByName(test)
    missing = full.exceptAll(both).agg(F.count(F.lit(1)).cast("bigint").alias("missing_rows"))
    extra = both.exceptAll(full).agg(F.count(F.lit(1)).cast("bigint").alias("extra_rows"))
    return missing.crossJoin(extra)
