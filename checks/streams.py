"""Streaming forms replayed over the event table to completion."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from checks import views as v
from checks.registry import check
from scenelake.session import ensure_checkpoint_dir
from scenelake.streaming import earliest, feedback as sf_feedback, status, windows


def _event_stream(s, sf):
    schema = s.read.parquet(f"{sf}/events.parquet").schema
    raw = s.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def _folder(s) -> str:
    return f"{ensure_checkpoint_dir(s)}/stream-{uuid4().hex}"


def _finish(query) -> None:
    query.awaitTermination()
    if query.exception():
        raise query.exception()


def _feedback_stream(s, sf):
    e = _event_stream(s, sf).where(F.col("event_type").isin("purchase", "click"))
    return e.select(F.concat(F.lit("ALT-"), F.col("user_id").cast("string")).alias("alert_id"), "user_id",
                    F.when(F.col("event_type") == "purchase", "CONFIRM").otherwise("REJECT").alias("action"), "ts", "event_id")


@check("stream_feedback_status", "alert_id:s action:s event_id:l n_decisions:l", """
SELECT 'ALT-' || user_id AS alert_id, CASE WHEN arg_max(event_type, (ts, event_id)) = 'purchase' THEN 'CONFIRM' ELSE 'REJECT' END AS action,
       arg_max(event_id, (ts, event_id)) AS event_id, count(*) AS n_decisions FROM events WHERE event_type IN ('purchase', 'click') GROUP BY user_id""")
def _(s, sf):
    folder = _folder(s)
    _finish(status.run_feedback_status(_feedback_stream(s, sf), f"{folder}/store", f"{folder}/state", buckets=8))
    return status.current_status(s, f"{folder}/store")


@check("stream_retrain_trigger", "user_id:l n_labels:l", """
SELECT user_id, count(*) AS n_labels FROM events WHERE event_type IN ('purchase', 'click') GROUP BY user_id HAVING count(*) >= 20""")
def _(s, sf):
    folder = _folder(s)
    _finish(sf_feedback.run_retrain_trigger(_feedback_stream(s, sf), f"{folder}/log", f"{folder}/state", "user_id"))
    return sf_feedback.triggered(s, f"{folder}/log", "user_id")


def _window_check(kind: str, sql: str):
    @check(f"stream_alert_windows_{kind}", "start:t end:t event_type:s n:l avg_confidence:6", sql)
    def _(s, sf):
        e = _event_stream(s, sf).withColumn("confidence", F.col("value") / 100.0)
        folder = _folder(s)
        w = windows.alert_windows(e, kind, by=("event_type",), delay="0 seconds", gap="20 minutes")
        _finish(windows.run_windows(w, f"{folder}/out", f"{folder}/state"))
        return s.read.schema(w.schema).parquet(f"{folder}/out")


# A stream emits a window once the newest event has passed its end.
_CLOSED = '"end" <= (SELECT date_trunc(\'milliseconds\', max(ts)) FROM events)'
_window_check("tumbling", f"""
SELECT * FROM (SELECT date_trunc('day', ts) AS start, date_trunc('day', ts) + INTERVAL 1 DAY AS "end", event_type, count(*) AS n, avg(value / 100.0) AS avg_confidence
FROM events GROUP BY ALL) WHERE {_CLOSED}""")
_window_check("sliding", f"""
SELECT * FROM (SELECT start, start + INTERVAL 1 DAY AS "end", event_type, count(*) AS n, avg(value / 100.0) AS avg_confidence
FROM (SELECT *, unnest([time_bucket(INTERVAL 12 HOUR, ts, TIMESTAMP '2024-01-01'), time_bucket(INTERVAL 12 HOUR, ts, TIMESTAMP '2024-01-01') - INTERVAL 12 HOUR]) AS start FROM events) GROUP BY ALL) WHERE {_CLOSED}""")
_window_check("session", f"""
SELECT * FROM (SELECT min(ts) AS start, max(ts) + INTERVAL 20 MINUTE AS "end", event_type, count(*) AS n, avg(value / 100.0) AS avg_confidence
FROM (SELECT *, sum(fresh) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS session FROM (
  SELECT *, CASE WHEN ts > lag(ts) OVER (PARTITION BY event_type ORDER BY ts, event_id) + INTERVAL 20 MINUTE THEN 1 ELSE 0 END AS fresh FROM events))
GROUP BY event_type, session) WHERE {_CLOSED}""")


@check("stream_earliest_date", "site:l earliest:t", """
SELECT site, min(ts) AS earliest FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY ts, event_id) AS rn FROM acquisition)
WHERE rn > 1 AND confidence >= 0.70 AND qa_coverage >= 0.75 GROUP BY site""", v.ACQUISITION)
def _(s, sf):
    e = _event_stream(s, sf)
    k = F.get_json_object("props", "$.k").cast("int")
    acq = e.select(F.col("user_id").alias("site"), "ts", F.unix_micros("ts").alias("ts_us"),
                   F.least(F.lit(1.0), F.col("value") / 100.0).alias("confidence"), ((k % 100) / 100.0).alias("qa_coverage"))
    name = "spark.sql.streaming.stateStore.providerClass"
    before = s.conf.get(name, None)
    s.conf.set(name, earliest.STATE_STORE[name])
    folder = _folder(s)
    try:
        out = earliest.earliest_dates(acq, delay="0 seconds")
        _finish(out.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/out")
                .option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start())
    finally:
        s.conf.set(name, before) if before else s.conf.unset(name)
    return s.read.schema(out.schema).parquet(f"{folder}/out").select("site", F.timestamp_micros("earliest_us").alias("earliest"))
