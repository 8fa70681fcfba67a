"""Stored upserts, feedback status as keyed state, seasonal moments."""

import datetime
import glob
import os
import time

import pytest
from pyspark.sql import functions as F

from scenelake.operators import store, timeline
from scenelake.streaming import status


def files(path):
    return {p: os.path.getmtime(p) for p in glob.glob(f"{path}/_bucket=*/*.parquet")}


def test_an_upsert_rewrites_touched_buckets_only(spark, tmp_path):
    path = str(tmp_path / "s")
    rows = spark.range(200).select(F.col("id").alias("k"), F.lit(1).alias("version"), F.concat(F.lit("v"), F.col("id").cast("string")).alias("value"))
    assert store.upsert(rows, path, ["k"], "version", 8) == list(range(8))
    first = files(path)
    again = rows.withColumn("value", F.lit("older or equal is ignored"))
    assert store.upsert(again, path, ["k"], "version", 8) == [] and files(path) == first
    change = spark.createDataFrame([(7, 2, "new"), (7, 3, "newest"), (7, 2, "x"), (8, 0, "too old")], "k long, version int, value string")
    touched = store.upsert(change, path, ["k"], "version", 8)
    assert len(touched) == 1
    after = files(path)
    assert {p for p in first if f"_bucket={touched[0]}/" not in p} == {p for p in after if f"_bucket={touched[0]}/" not in p}
    assert all(after[p] == first[p] for p in after if p in first)
    added = spark.createDataFrame([(1000, None, "first"), (None, 1, "no key")], "k long, version int, value string")
    assert store.upsert(added, path, ["k"], "version", 8)
    got = {r.k: (r.version, r.value) for r in store.read_store(spark, path).collect()}
    want = {i: (1, f"v{i}") for i in range(200)} | {7: (3, "newest"), 1000: (None, "first"), None: (1, "no key")}
    assert got == want
    assert store.upsert(rows.limit(0), path, ["k"], "version", 8) == []


def at(minute):
    return datetime.datetime(2024, 5, 1, 12, minute)


def test_feedback_status_is_state(spark, tmp_path):
    source, path, state = (str(tmp_path / n) for n in ("in", "store", "ck"))
    schema = "alert_id string, action string, ts timestamp, event_id long"

    def feed(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(source)
        stream = spark.readStream.schema(schema).json(source)
        initial = spark.createDataFrame([("old", "REJECT", at(0), 1, 4)], status.OUTPUT)
        query = status.run_feedback_status(stream, path, state, initial, buckets=4)
        query.awaitTermination()
        assert query.exception() is None
        return {r.alert_id: (r.action, r.event_id, r.n_decisions) for r in status.current_status(spark, path).collect()}

    assert feed([("a", "CONFIRM", at(5), 10), ("a", "REJECT", at(6), 11), ("b", "CONFIRM", at(5), 12), ("a", "REJECT", at(6), 11)]) == {
        "a": ("REJECT", 11, 2), "b": ("CONFIRM", 12, 1)}
    # A repeat counts once, a late decision counts without winning, an initial state goes on.
    assert feed([("a", "CONFIRM", at(5), 10), ("a", "CONFIRM", at(1), 13), ("old", "CONFIRM", at(9), 14)]) == {
        "a": ("REJECT", 11, 3), "b": ("CONFIRM", 12, 1), "old": ("CONFIRM", 14, 5)}
    # The last batch runs again, as after a driver that died before it was marked as done.
    commits = sorted((int(os.path.basename(p)) for p in glob.glob(f"{state}/commits/[0-9]*")))
    os.remove(f"{state}/commits/{commits[-1]}")
    for crc in glob.glob(f"{state}/commits/.{commits[-1]}.crc"):
        os.remove(crc)
    before = files(path)
    assert feed([("b", "REJECT", at(20), 15)]) == {"a": ("REJECT", 11, 3), "b": ("REJECT", 15, 2), "old": ("CONFIRM", 14, 5)}
    assert before.keys() - files(path).keys() <= {p for p in before if "_bucket" in p}


def test_status_with_ids_that_are_forgotten_runs_until_stopped(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "store")
    schema = "alert_id string, action string, ts timestamp, event_id long"
    spark.createDataFrame([("a", "CONFIRM", at(5), 10), ("a", "CONFIRM", at(5), 10)], schema).write.json(source)
    query = status.run_feedback_status(spark.readStream.schema(schema).json(source), path, str(tmp_path / "ck"), repeats_ms=3_600_000, buckets=2)
    for _ in range(60):
        if query.exception() or glob.glob(f"{path}/_bucket=*/*.parquet"):
            break
        time.sleep(0.5)
    query.stop()
    assert [tuple(r)[:2] for r in status.current_status(spark, path).select("alert_id", "n_decisions").collect()] == [("a", 1)]


@pytest.mark.parametrize("parts", [1, 4])
def test_seasonal_moments_add_up(spark, parts):
    import random

    rng = random.Random(parts)
    rows = [(rng.choice("ab"), datetime.datetime(2020 + i % 4, rng.randint(1, 12), 1 + i % 28), 1e6 + rng.gauss(0, 3)) for i in range(400)]
    rows += [("c", datetime.datetime(2024, 2, 1), 5.0), ("c", datetime.datetime(2024, 2, 2), None)]
    df = spark.createDataFrame(rows, "site string, ts timestamp, value double")
    moments = None
    for i in range(parts):
        part = timeline.seasonal_moments(df.where(F.pmod(F.hash("site", "ts", "value"), F.lit(parts)) == i), "site", "ts", "value")
        moments = part if moments is None else timeline.merge_moments(moments, part, "site")
    key = lambda r: tuple(r)[:2]
    for one, other in zip(*(sorted(timeline.seasonal_scores(df, m, "site", "ts", "value").select("site", "ts", "value", "z", "is_anomaly").collect(),
                                   key=lambda r: (r.site, r.ts, r.value is None, r.value or 0))
                            for m in (moments, timeline.seasonal_moments(df, "site", "ts", "value")))):
        assert key(one) == key(other) and one.is_anomaly == other.is_anomaly
        assert (one.z is None) == (other.z is None) and (one.z is None or one.z == pytest.approx(other.z, abs=1e-6))
    full = timeline.seasonal_zscore(df, "site", "ts", "value").select("site", "ts", "z")
    assert full.count() == len(rows)
