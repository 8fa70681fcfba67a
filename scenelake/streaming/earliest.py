"""Earliest supported date per site, kept as keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROW = T.StructType([T.StructField("ts_us", T.LongType()), T.StructField("confidence", T.DoubleType()),
                    T.StructField("qa_coverage", T.DoubleType())])
SEEN = T.StructType([T.StructField("seen", T.BooleanType()), T.StructField("locked", T.BooleanType())])
OUTPUT = T.StructType([T.StructField("site", T.LongType()), T.StructField("earliest_us", T.LongType())])

# transformWithState needs this state store.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass":
               "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class EarliestDate(StatefulProcessor):
    """Buffers acquisitions until the watermark passes them, then walks them in time order.

    The buffer holds one watermark delay of a site. A site locks its first
    supported date once and ignores everything later.
    """

    def __init__(self, min_confidence: float = 0.70, min_coverage: float = 0.75):
        self.min_confidence, self.min_coverage = min_confidence, min_coverage

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", ROW)
        self.state = handle.getValueState("state", SEEN)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if not (self.state.exists() and self.state.get()[1]):
            for frame in rows:
                self.waiting.appendList([tuple(r) for r in frame[["ts_us", "confidence", "qa_coverage"]].itertuples(index=False)])
                self.handle.registerTimer(int(frame["ts_us"].max()) // 1000)
        yield pd.DataFrame(columns=["site", "earliest_us"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        seen, locked = self.state.get() if self.state.exists() else (False, False)
        watermark = timerValues.getCurrentWatermarkInMs()
        found = None
        if not locked and self.waiting.exists():
            rows = sorted(tuple(r) for r in self.waiting.get())
            ready = [r for r in rows if r[0] // 1000 <= watermark]
            rest = [r for r in rows if r[0] // 1000 > watermark]
            for ts, confidence, coverage in ready:
                if seen and found is None and confidence >= self.min_confidence and coverage >= self.min_coverage:
                    found = ts
                seen = True
            self.state.update((seen, found is not None))
            self.waiting.clear()
            if found is None and rest:
                self.waiting.put(rest)
        frame = {"site": [key[0]], "earliest_us": [found]} if found is not None else {"site": [], "earliest_us": []}
        yield pd.DataFrame(frame).astype("int64")

    def close(self) -> None:
        pass


def earliest_dates(acquisitions: DataFrame, event_time: str = "ts", delay: str = "1 day",
                   min_confidence: float = 0.70, min_coverage: float = 0.75) -> DataFrame:
    """Stream of (site, earliest_us) from a stream with site, event time, ts_us, confidence and qa_coverage."""
    return (acquisitions.withWatermark(event_time, delay).groupBy("site").transformWithStateInPandas(
        statefulProcessor=EarliestDate(min_confidence, min_coverage), outputStructType=OUTPUT, outputMode="Append",
        timeMode="EventTime"))
