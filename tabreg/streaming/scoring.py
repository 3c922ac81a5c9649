"""Scoring a stream with a fitted pipeline and appending the predictions to the history table.

The reference has no streaming logic; batch scoring is a stateless ``transform``, so the same fitted
``PipelineModel`` applies to a ``readStream`` DataFrame unchanged. The file sink with a checkpoint gives
exactly-once appends of the history rows, partitioned by date like the batch ``history_append``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tabreg.operators.forest import UnlimitedForestModel


def score_stream(model: PipelineModel, stream: DataFrame, prediction_col: str = "prediction") -> DataFrame:
    """Stateless scoring of a streaming DataFrame; input columns are kept. Forests, whose model is a table, write
    between their steps and go by ``score_batches``."""
    if stream.isStreaming and any(isinstance(s, UnlimitedForestModel) for s in model.stages):
        raise ValueError("a forest scores streams by batches: use score_batches")
    out = model.transform(stream)
    return out.withColumnRenamed("prediction", prediction_col) if prediction_col != "prediction" else out


def history_stream(scored: DataFrame, id_col: str, user_col: str, ts_col: str, inputs: Sequence[str],
                   model_name: str, prediction_col: str = "prediction") -> DataFrame:
    return scored.select(
        F.col(id_col).cast("bigint").alias("id"), F.col(user_col).cast("bigint").alias("user_id"),
        F.col(ts_col).alias("created_at"), F.col(prediction_col).cast("double").alias("prediction"),
        F.lit(model_name).alias("model_name"), F.to_json(F.struct(*inputs)).alias("inputs_json"),
        F.to_date(ts_col).alias("created_date"))


def append_history_stream(history_rows: DataFrame, path: str, checkpoint: str,
                          trigger_once: bool = True) -> StreamingQuery:
    """Exactly-once parquet file sink, partitioned by creation date."""
    w = (history_rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
         .partitionBy("created_date").outputMode("append"))
    w = w.trigger(availableNow=True) if trigger_once else w
    return w.start()


def score_batches(model: PipelineModel, stream: DataFrame, path: str, checkpoint: str,
                  rows: Callable[[DataFrame], DataFrame] = lambda scored: scored) -> StreamingQuery:
    """Score a stream batch by batch with any model and keep each batch's ``rows`` under ``path/batch_id=<id>``; a batch
    that runs again replaces its own folder, so its rows are there once."""
    def one(batch: DataFrame, batch_id: int) -> None:
        rows(model.transform(batch)).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
