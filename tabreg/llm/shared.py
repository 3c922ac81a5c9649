"""Helpers shared by the operators: written tables in the shared folder, row identity, components."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabreg.session import ensure_checkpoint_dir


SALTS = 8
_shipped: set[str] = set()
_shipping = threading.Lock()


def ship(spark: SparkSession) -> None:
    """Hand this package to the executors once per application (``addPyFile``: Spark's own distribution)."""
    app = spark.sparkContext.applicationId
    with _shipping:  # fits run side by side; Spark refuses the same file name from another folder
        if app in _shipped:
            return
        root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        path = os.path.join(tempfile.mkdtemp(prefix="tabreg-code-"), "tabreg_code.zip")
        with zipfile.ZipFile(path, "w") as z:
            for folder, _, files in os.walk(root):
                for name in files:
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        z.write(full, os.path.join("tabreg", os.path.relpath(full, root)))
        spark.sparkContext.addPyFile(path)
        _shipped.add(app)


def arrow(df: DataFrame, function, schema) -> DataFrame:
    """``mapInArrow`` with this package at hand on the executors; use with ``DataFrame.transform``."""
    ship(df.sparkSession)
    return df.mapInArrow(function, schema)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the folder of ``spark.checkpoint.dir`` and read it back (cuts lineage)."""
    return read_back(df.sparkSession, *write_table(df, name))


def write_table(df: DataFrame, name: str) -> tuple[str, object]:
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/tabreg-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path, df.schema


def read_back(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def drop_table(spark: SparkSession, path: str) -> None:
    """Delete a table that ``write_table`` made."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def least_rows(df: DataFrame, by: str, order: str, n: int) -> DataFrame:
    """The ``n`` rows of each value of ``by`` with the least ``order``, a uniform 64-bit hash (ties in any order).

    Values are counted first (a row per value is broadcast, so ``by`` must be few). Then only rows under the share
    1.5 n / count of the hash space are kept, wider where that proves too few, and these few are ranked.
    """
    counts = written(df.groupBy(by).agg(F.count("*").alias("__all")), "values")
    wide = 1.5
    while True:
        share = F.lit(wide * n) / F.col("__all")
        kept = written(df.join(F.broadcast(counts), by).where((F.col(order).cast("double") / F.lit(2.0 ** 64) + 0.5) <= share), "least")
        missing = counts.join(kept.groupBy(by).agg(F.count("*").alias("__kept")), by, "left").where(
            (F.coalesce("__kept", F.lit(0)) < F.least(F.lit(n), F.col("__all"))) & (F.lit(wide * n) < F.col("__all")))
        if missing.isEmpty():
            break
        wide *= 8
    last = Window.partitionBy(by).orderBy(order)
    return kept.drop("__all").withColumn("__r", F.row_number().over(last)).where(F.col("__r") <= n).drop("__r")


def row_key(id_col: str, text_col: str) -> Column:
    """Identity of a row by content: rows share it only if id and text agree, and then any result that rests on these alone."""
    return F.xxhash64(F.col(id_col), F.col(text_col), F.lit(7)).alias("row_key")


def components(edges: DataFrame, u: str = "u", v: str = "v", max_rounds: int = 60) -> DataFrame:
    """Connected components of an edge list by alternating large-star and small-star rounds.

    Returns (node, root) for every node of a non-loop edge, root the smallest node of its component.
    Each round is two aggregations and two joins; its result is written to the shared folder, so a lost
    executor costs one round at most. Minima are pre-aggregated, and the edges of a node with many are dealt out
    by a salt of ``SALTS`` before they meet them.
    Null ends and loops are dropped. Raises if the rounds do not settle in ``max_rounds``.
    """
    spark = edges.sparkSession
    cur = (edges.where(f"{u} <> {v}").select(F.greatest(u, v).alias("c"), F.least(u, v).alias("p")).distinct())
    path, schema = write_table(cur, "cc")
    cur, seen = read_back(spark, path, schema), None
    for _ in range(max_rounds):
        both = cur.unionByName(cur.select(F.col("p").alias("c"), F.col("c").alias("p")))
        low = (both.groupBy("c").agg(F.min("p").alias("low"))
               .select("c", F.least("c", "low").alias("low"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("s")))
        salted = both.withColumn("s", F.pmod(F.xxhash64("p"), F.lit(SALTS)).cast("int"))
        large = salted.join(low, ["c", "s"]).where("p > c").select(F.col("p").alias("c"), F.col("low").alias("p")).distinct()
        low2 = large.groupBy("c").agg(F.min("p").alias("low"))
        paired = large.join(low2, "c")
        new = (paired.select(F.explode(F.array(F.struct("c", F.col("low").alias("p")),
                                               F.struct(F.col("p").alias("c"), F.col("low").alias("p")))).alias("e"))
               .select("e.*").where("c > p").distinct())
        new_path, _ = write_table(new, "cc")
        new = read_back(spark, new_path, schema)
        now = new.agg(F.count("*").alias("n"), F.sum(F.xxhash64("c", "p").cast("decimal(38,0)")).alias("h")).first()
        drop_table(spark, path)
        cur, path = new, new_path
        if now == seen:
            roots = cur.select(F.col("p").alias("c"), "p").distinct()
            return cur.unionByName(roots).select(F.col("c").alias("node"), F.col("p").alias("root"))
        seen = now
    raise RuntimeError("components did not settle")


def hot_join(left: DataFrame, right: DataFrame, key: str, n: str, total: int, hot_keys: int = 2048) -> DataFrame:
    """Inner join on ``key``, unique in ``right``, whose column ``n`` counts the rows of ``left`` (``total`` in all).

    Keys with more than ``total`` / ``hot_keys`` rows (fewer than ``hot_keys`` of them, so a bounded table) meet
    theirs by a broadcast; the rest, none of which is hot, by a shuffle or as the planner chooses.
    """
    limit = total // hot_keys
    hot = F.broadcast(right.where(F.col(n) > limit))
    rest = left.join(hot.select(key), key, "left_anti").join(right.where(F.col(n) <= limit), key)
    return left.join(hot, key).unionByName(rest)
