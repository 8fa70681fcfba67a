"""Scenes cut into blocks give what they give as one row; late feedback; region numbers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scenelake.functions.text import region_id
from scenelake.operators import registration, scenes as scenes_of, timeline
from scenelake.operators.blocks import unroll
from scenelake.plans import change_event as ce, rgb_report
from scenelake.session import checkpoint
from scenelake.streaming import feedback as stream

SIDE = 16


def scenes(spark, cut, shift=(2, -1), n=3):
    """Scenes of smooth noise and their shifted later date, as one row or cut into blocks."""
    rng = np.random.default_rng(5)
    rows = []
    for scene in range(n):
        base = rng.random((3, SIDE, SIDE))
        later = np.roll(base, (-shift[0], -shift[1]), axis=(1, 2))
        later[:, 3:6, 3:7] = np.clip(later[:, 3:6, 3:7] + 0.6 * (scene + 1) / n, 0, 1)
        qa = rng.choice([1, 1, 1, 3], size=(SIDE, SIDE)) if scene % 2 == 0 else rng.choice([4, 5, 8, 9], size=(SIDE, SIDE))
        sar = rng.random((2, SIDE, SIDE))
        size = SIDE // cut
        for r in range(cut):
            for c in range(cut):
                box = np.s_[r * size:(r + 1) * size, c * size:(c + 1) * size]
                flat = lambda a: a[box].ravel().tolist()
                rows.append((scene, r, c, size, size, *[flat(base[i]) for i in range(3)], *[flat(later[i]) for i in range(3)],
                             [int(v) for v in flat(qa)], [int(v) for v in flat(qa)], *([flat(sar[0]), flat(sar[1])] if scene else [None, None])))
    bands = ", ".join(f"{b}{e} array<double>" for e in (1, 2) for b in "rgb")
    frame = spark.createDataFrame(rows, f"scene int, block_row int, block_col int, block_size int, width int, {bands}, "
                                        "qa1 array<int>, qa2 array<int>, sar1 array<double>, sar2 array<double>")
    return frame if cut > 1 else frame.drop("block_row", "block_col", "block_size")


def same(a, b):
    assert a.keys() == b.keys()
    for k in a:
        for x, y in zip(a[k], b[k]):
            assert x == y if isinstance(x, (str, bool, list, type(None))) else x == pytest.approx(y, abs=1e-9), (k, a[k], b[k])


def by(frame, keys, values):
    return {tuple(r[k] for k in keys): [r[v] for v in values] for r in frame.collect()}


@pytest.mark.parametrize("cut", [2, 4])
def test_probability_and_suppression_do_not_notice_blocks(spark, cut):
    results = []
    for n in (1, cut):
        rows = ce.raw_change_prob(scenes(spark, n), ["r", "g", "b"], keys=["scene"])
        px = ce.suppress(rows, ["scene"])
        results.append((by(px, ["scene", "y", "x"], ["prob", "p", "mask", "usable", "sar_agreement"]),
                        by(ce.event_metrics(px, ["scene"]), ["scene"], ["confidence", "qa_coverage", "n_masked", "sar_fused"])))
    same(results[0][0], results[1][0])
    same(results[0][1], results[1][1])


@pytest.mark.parametrize("shift", [(2, -1), (0, 0), (-3, 3)])
def test_registration_finds_one_shift_per_scene(spark, shift):
    found = []
    for n in (1, 2):
        out = registration.coregister(scenes(spark, n, shift), ["r", "g", "b"], keys=["scene"])
        assert {tuple(r) for r in out.select("shift.dy", "shift.dx").collect()} == {shift}
        found.append(by(unroll(out, ["scene"], ["r2a", "g2a"]), ["scene", "y", "x"], ["r2a", "g2a"]))
    same(*found)


def test_subpixel_registration_does_not_notice_blocks(spark):
    found = []
    for n in (1, 2):
        out = registration.coregister_sub(scenes(spark, n), ["r", "b"], keys=["scene"]).cache()
        found.append((by(out.select("scene", "shift.*").distinct(), ["scene"], ["dy", "dx", "confidence"]),
                      by(unroll(out, ["scene"], ["r2a", "b2a"]), ["scene", "y", "x"], ["r2a", "b2a"])))
    same(found[0][0], found[1][0])
    same(found[0][1], found[1][1])


def large_scene(spark, height, width, size, shift):
    """One scene in blocks, the last ones partial, and its circularly shifted later date with changes."""
    rng = np.random.default_rng(8)
    before = rng.random((height, width))
    after = np.roll(before, (-shift[0], -shift[1]), (0, 1)) + 0.1 * rng.random((height, width))
    after[50:90, 60:120] = 1.0
    cut = [(r, c) for r in range(-(-height // size)) for c in range(-(-width // size))]

    def rows(numbers):
        for i in numbers:
            r, c = cut[i]
            box = np.s_[r * size:(r + 1) * size, c * size:(c + 1) * size]
            yield 1, r, c, size, before[box].shape[1], before[box].ravel().tolist(), after[box].ravel().tolist()

    schema = "scene int, block_row int, block_col int, block_size int, width int, r1 array<double>, r2 array<double>"
    frames = spark.sparkContext.parallelize(range(len(cut)), 8).mapPartitions(rows).toDF(schema)
    return frames, before, after


def test_shift_of_large_scenes_is_that_of_all_pixels(spark):
    for height, width, size, shift in ((3100, 3080, 512, (3, -5)), (700, 531, 128, (1, 4)), (600, 40, 64, (-2, 5))):
        frame, _, _ = large_scene(spark, height, width, size, shift)
        whole = scenes_of.scene_shift(frame, ["scene"], F.col("r1"), F.col("r2"), registration.phase_shift).collect()
        assert [tuple(r["shift"]) for r in whole] == [shift]


def test_subpixel_shift_of_large_scenes_is_that_of_all_pixels(spark, monkeypatch):
    frame, _, _ = large_scene(spark, 151, 90, 32, (4, -3))
    # Circularly by half a pixel along x.
    half = F.transform("r2", lambda v, i: (v + F.col("r2")[F.greatest(i - 1, F.lit(0))]) / 2)
    for after in (F.col("r2"), half):
        found = []
        for most in (1000, 16):
            monkeypatch.setattr(scenes_of, "WHOLE", most)
            rows = scenes_of.scene_shift(frame, ["scene"], F.col("r1"), after, registration.subpixel_shift)
            found.append(by(rows.select("scene", "shift.*"), ["scene"], ["dy", "dx", "confidence"]))
        same(*found)
    frame, _, _ = large_scene(spark, 1100, 1040, 256, (4, -3))
    monkeypatch.setattr(scenes_of, "WHOLE", 512)
    rows = scenes_of.scene_shift(frame, ["scene"], F.col("r1"), F.col("r2"), registration.subpixel_shift).collect()
    assert [tuple(r["shift"])[:2] for r in rows] == [(4.0, -3.0)]


def test_reports_and_events_do_not_notice_blocks(spark):
    reports, events = [], []
    for n in (1, 2):
        px = rgb_report.change_pixels(scenes(spark, n), ["scene"])
        reports.append(by(px, ["scene", "y", "x"], ["distance", "changed", "cloud1"]))
        pixels, found = ce.detect_change(scenes(spark, n), ["scene"])
        events.append((by(pixels, ["scene", "y", "x"], ["p", "mask"]),
                       by(found, ["scene"], ["confidence", "n_masked", "change_type", "change_morphology", "offset_dy", "offset_dx"])))
    same(*reports)
    same(events[0][0], events[1][0])
    same(events[0][1], events[1][1])


def test_detect_change_of_a_rectangle(spark):
    side = 32
    before, after = np.zeros((side, side)), np.zeros((side, side))
    after[10:20, 10:20] = 200
    flat = lambda a: a.ravel().tolist()
    row = (1, side, *[flat(before)] * 3, *[flat(after)] * 3, [1] * side * side, [1] * side * side)
    bands = ", ".join(f"{b}{e} array<double>" for e in (1, 2) for b in "rgb")
    pairs = spark.createDataFrame([row], f"scene int, width int, {bands}, qa1 array<int>, qa2 array<int>")
    pixels, events = ce.detect_change(pairs, ["scene"])
    mask = {(r.y, r.x) for r in pixels.where("mask").collect()}
    wanted = {(y, x) for y in range(10, 20) for x in range(10, 20)}
    assert len(mask & wanted) > 0.8 * len(mask | wanted)
    event = events.first()
    assert event["change_morphology"] == "appearance" and not event["sar_fused"] and event["n_masked"] == len(mask)


def test_stack_takes_the_first_supported_date(spark):
    rows = []
    for site in (1, 2):
        for i, month in enumerate(("2023-01-01", "2023-06-01", "2024-01-01")):
            picture = np.zeros((16, 16))
            if site == 1 and i == 2:
                picture[4:12, 4:12] = 1.0
            flat = picture.ravel().tolist()
            rows.append((site, month, 16, flat, flat, flat, [1] * 256))
    frame = spark.createDataFrame(rows, "site int, day string, width int, r array<double>, g array<double>, b array<double>, "
                                        "qa array<int>").withColumn("ts", F.to_timestamp("day"))
    evidence, result = ce.detect_change_over_stack(frame, "site", "ts", min_confidence=0.5)
    found = {r["site"]: r for r in result.collect()}
    assert evidence.count() == 4 and all(r["n_pairs"] == 2 for r in found.values())
    confidence = {(r["site"], r["t2_date"].year, r["t2_date"].month): r["confidence"] for r in evidence.collect()}
    assert confidence[1, 2024, 1] > max(v for k, v in confidence.items() if k != (1, 2024, 1))


def test_region_numbers_are_not_cut(spark):
    rows = spark.range(98, 103).select(region_id(F.lit("a"), F.col("id")).alias("r")).collect()
    assert [r["r"] for r in rows] == ["a_reg_98", "a_reg_99", "a_reg_100", "a_reg_101", "a_reg_102"]
    assert spark.range(3, 4).select(region_id(F.lit("a"), F.col("id")).alias("r")).first()["r"] == "a_reg_03"


def test_late_feedback_is_kept(spark, tmp_path):
    schema = "alert_id string, action string, ts timestamp, event_id long"
    source = str(tmp_path / "in")
    for n, rows in enumerate([[("A", "CONFIRM", "2024-05-01 10:00:00", 1), ("A", "CONFIRM", "2024-05-01 10:00:00", 1)],
                              [("B", "REJECT", "2024-01-01 00:00:00", 2)],
                              [("A", "CONFIRM", "2024-05-01 10:00:00", 1), ("B", "CONFIRM", "2024-01-02 00:00:00", 3)]]):
        frame = spark.createDataFrame([(a, b, c, d) for a, b, c, d in rows], "alert_id string, action string, t string, event_id long")
        frame.select("alert_id", "action", F.to_timestamp("t").alias("ts"), "event_id").coalesce(1).write.mode("append").parquet(source)
        feed = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        stream.run_feedback_log(feed, str(tmp_path / "log"), str(tmp_path / "state")).awaitTermination()
    found = by(stream.current_status(spark, str(tmp_path / "log")), ["alert_id"], ["action", "n_decisions"])
    assert found == {("A",): ["CONFIRM", 1], ("B",): ["CONFIRM", 2]}


@pytest.mark.parametrize("register, cuts", [(False, (1, 2, 4)), (True, (1, 2))])
def test_stacks_do_not_notice_blocks(spark, register, cuts):
    """One site with three dates and one with two: as one row per date, 2 x 2 and 4 x 4 blocks."""
    found = []
    for cut in cuts:
        rows = scenes(spark, cut)
        ts = F.timestamp_add("DAY", F.col("scene"), F.lit("2024-05-01").cast("timestamp"))
        own = ["width", *([] if cut == 1 else ["block_row", "block_col", "block_size"])]
        stack = rows.select(F.lit("a").alias("site"), ts.alias("ts"), *own, *[F.col(f"{b}1").alias(b) for b in "rgb"],
                            F.col("qa1").alias("qa"), F.col("sar1").alias("sar"))
        other = rows.where("scene < 2").select(F.lit("b").alias("site"), ts.alias("ts"), *own, *[F.col(f"{b}2").alias(b) for b in "rgb"],
                                               F.col("qa1").alias("qa"), F.col("sar2").alias("sar"))
        evidence, result = ce.detect_change_over_stack(stack.unionAll(other), "site", "ts", register=register,
                                                       min_confidence=0.3, min_coverage=0.1)
        evidence = checkpoint(evidence)
        assert sorted(tuple(r) for r in evidence.groupBy("site").count().collect()) == [("a", 2), ("b", 1)]
        earliest = timeline.earliest_supported(stack.unionAll(other), evidence, "site")
        found.append((by(evidence, ["site", "t1_date", "t2_date"], ["confidence", "qa_coverage", "is_valid_change"]),
                      {tuple(r) for r in earliest.collect()}))
    assert {r[2] for r in result.collect()} == {1, 2}
    for other in found[1:]:
        same(found[0][0], other[0])
        assert found[0][1] == other[1]


def test_blocks_of_one_date_only_meet_nothing(spark):
    rows = scenes(spark, 2, n=1).select("block_row", "block_col", "block_size", "width", *[F.col(f"{b}1").alias(b) for b in "rgb"])
    first = rows.where("block_row = 0").withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    second = rows.withColumn("ts", F.lit("2024-01-02").cast("timestamp"))
    evidence, result = ce.detect_change_over_stack(first.unionByName(second).withColumn("site", F.lit(1)), "site", "ts", register=False)
    assert evidence.count() == 1 and result.collect()[0]["n_pairs"] == 1
