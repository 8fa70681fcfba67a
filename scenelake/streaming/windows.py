"""Windowed alert activity."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def alert_windows(alerts: DataFrame, kind: str = "tumbling", size: str = "1 day", slide: str = "12 hours",
                  gap: str = "6 hours", delay: str = "2 days", event_time: str = "ts", by: tuple[str, ...] = ("status",)
                  ) -> DataFrame:
    """Alert count and mean confidence per window; works on a stream and on a table.

    Rows later than ``delay`` behind the newest event are dropped by a stream.
    """
    window = {"tumbling": lambda: F.window(event_time, size), "sliding": lambda: F.window(event_time, size, slide),
              "session": lambda: F.session_window(event_time, gap)}[kind]()
    return (alerts.withWatermark(event_time, delay).groupBy(window.alias("w"), *by)
            .agg(F.count("*").alias("n"), F.avg("confidence").alias("avg_confidence"))
            .select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n", "avg_confidence"))


def run_windows(windows: DataFrame, path: str, checkpoint: str):
    """Append closed windows to a parquet folder."""
    return (windows.writeStream.outputMode("append").format("parquet").option("path", path)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
