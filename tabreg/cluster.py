"""Helpers for work inside tasks: the package on the executors, tables in the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

from tabreg.session import ensure_checkpoint_dir

_shipped: set[str] = set()
_shipping = threading.Lock()


def ship(spark: SparkSession) -> None:
    """Hand this package to the executors, once per application (``addPyFile``)."""
    app = spark.sparkContext.applicationId
    with _shipping:  # fits run side by side; Spark refuses the same file name from another folder
        if app in _shipped:
            return
        root = os.path.dirname(os.path.abspath(__file__))
        path = os.path.join(tempfile.mkdtemp(prefix="tabreg-code-"), "tabreg_package.zip")
        with zipfile.ZipFile(path, "w") as z:
            for folder, _, files in os.walk(root):
                for name in files:
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        z.write(full, os.path.join("tabreg", os.path.relpath(full, root)))
        spark.sparkContext.addPyFile(path)
        _shipped.add(app)


def arrow(df: DataFrame, function, schema: str) -> DataFrame:
    """``mapInArrow`` with this package at hand on the executors; use with ``DataFrame.transform``."""
    ship(df.sparkSession)
    return df.mapInArrow(function, schema)


def table_path(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/tabreg-{name}-{uuid.uuid4().hex}"


# Rows that are blocks of many: a reader holds a whole row group of them in each task, and a writer by default looks
# at its size every 100 rows only.
BLOCK_TABLE = {"parquet.block.size": str(8 << 20), "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "16"}


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and read it back (cuts lineage)."""
    path = table_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
