"""Current decision of each alert as keyed state of a feedback stream.

The state of an alert holds its latest decision and how many it had; ids of
decisions are remembered, for a while or for good, so a repeated delivery counts once. The
stream's output is the changed alerts only; they are upserted into a store, so
the current status is read from there and never from the whole log.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from scenelake.operators.store import read_store, upsert

STATE = "action string, ts timestamp, event_id long, n_decisions long"
OUTPUT = f"alert_id string, {STATE}"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class LatestDecision(StatefulProcessor):
    """Latest decision by (ts, event_id), and the number of distinct decisions; late ones count as well."""

    def __init__(self, repeats_ms: int | None = None):
        self.repeats_ms = repeats_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.current = handle.getValueState("current", STATE)
        self.seen = handle.getMapState("seen", "event_id long", "was boolean", self.repeats_ms)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        row = initialState.iloc[0]
        self.current.update((row["action"], row["ts"].to_pydatetime(), int(row["event_id"]), int(row["n_decisions"])))
        self.seen.updateValue((int(row["event_id"]),), (True,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        action, ts, event_id, n = self.current.get() if self.current.exists() else (None, None, None, 0)
        before = n
        for part in rows:
            for row in part.drop_duplicates("event_id").sort_values(["ts", "event_id"]).itertuples(index=False):
                if self.seen.containsKey((int(row.event_id),)):
                    continue
                self.seen.updateValue((int(row.event_id),), (True,))
                n += 1
                when = row.ts.to_pydatetime()
                if ts is None or (when, int(row.event_id)) >= (ts, event_id):
                    action, ts, event_id = row.action, when, int(row.event_id)
        if n > before:
            self.current.update((action, ts, event_id, n))
            yield pd.DataFrame({"alert_id": [key[0]], "action": [action], "ts": [ts], "event_id": [event_id], "n_decisions": [n]})

    def close(self) -> None:
        pass


def run_feedback_status(feedback: DataFrame, store: str, checkpoint: str, initial: DataFrame | None = None,
                        repeats_ms: int | None = None, buckets: int = 64) -> StreamingQuery:
    """Keep the status of alerts in a store up to date from a stream (alert_id, action, ts, event_id).

    Without ``repeats_ms`` all that is there is read, ids of decisions are kept
    for good, and the query ends. With it ids are forgotten after that many
    milliseconds, by the clock of the stream, which then runs until it is stopped.
    ``initial`` (the columns of ``OUTPUT``) starts the state of alerts that were
    decided before the stream began. A batch that runs again after a failure
    upserts rows that the store already has, which changes nothing.
    """
    spark = feedback.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    start = initial.groupBy("alert_id") if initial is not None else None
    changed = feedback.select("alert_id", "action", "ts", "event_id").groupBy("alert_id").transformWithStateInPandas(
        statefulProcessor=LatestDecision(repeats_ms), outputStructType=OUTPUT, outputMode="Update",
        timeMode="ProcessingTime" if repeats_ms else "None", initialState=start)
    pace = {"processingTime": "10 seconds"} if repeats_ms else {"availableNow": True}
    return (changed.writeStream.outputMode("update")
            .foreachBatch(lambda batch, _: upsert(batch, store, ["alert_id"], "n_decisions", buckets) and None)
            .option("checkpointLocation", checkpoint).trigger(**pace).start())


def current_status(spark: SparkSession, store: str) -> DataFrame:
    """Latest decision and number of decisions per alert."""
    return read_store(spark, store)
