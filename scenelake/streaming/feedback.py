"""Analyst feedback as a stream.

Sinks write one folder per micro-batch and replace it on a retry, so a batch
that runs twice after a lost executor leaves the log unchanged. Every decision
is logged, however late it arrives; repeats are told by their id when the log
is read. Current state is a view over the log.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from scenelake.operators.feedback import latest_feedback


def _log_batch(batch: DataFrame, batch_id: int, path: str) -> None:
    batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def run_feedback_log(feedback: DataFrame, path: str, checkpoint: str, unique: tuple[str, ...] = ("event_id",)
                     ) -> StreamingQuery:
    """Log every decision of a feedback stream, once per batch."""
    return (feedback.writeStream.foreachBatch(lambda b, i: _log_batch(b.dropDuplicates(list(unique)), i, path))
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def current_status(spark: SparkSession, path: str, event_time: str = "ts", unique: tuple[str, ...] = ("event_id",)
                   ) -> DataFrame:
    """Latest decision and number of distinct decisions per alert over all logged batches."""
    log = spark.read.parquet(path).drop("batch").dropDuplicates(list(unique))
    return latest_feedback(log, "alert_id", [event_time, "event_id"])


def run_retrain_trigger(labels: DataFrame, path: str, checkpoint: str, key: str, threshold: int = 20
                        ) -> StreamingQuery:
    """Running label count per key; keys at or above the threshold are logged as they change."""
    counts = labels.groupBy(key).agg(F.count("*").alias("n_labels")).where(F.col("n_labels") >= threshold)
    return (counts.writeStream.outputMode("update").foreachBatch(lambda b, i: _log_batch(b, i, path))
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def triggered(spark: SparkSession, path: str, key: str) -> DataFrame:
    """Keys that crossed the threshold, the batch of the crossing, and the latest count."""
    return spark.read.parquet(path).groupBy(key).agg(
        F.min("batch").alias("first_batch"), F.max("n_labels").alias("n_labels"))
