"""Hand-sized cases with known answers."""

import json

import numpy as np
import pytest
from pyspark.sql import Row, functions as F

from scenelake.functions import qa
from scenelake.operators import clusters, evaluation, neighbourhood as nb, radiometry, registration, timeline
from scenelake.operators.blocks import bitemporal_join, roll_up, unroll
from scenelake.plans import change_event as ce
from scenelake.sources import stac


def block(array, **extra):
    array = np.asarray(array, dtype=float)
    return dict(values=[float(v) for v in array.ravel()], width=array.shape[1], **extra)


def test_qa_bits(spark):
    values = [1, 3, 5, 9, 17, 33, 65, 129, 0]
    rows = spark.createDataFrame([(v,) for v in values], "qa int").select("qa", *[c.alias(n) for n, c in qa.decode_bits(F.col("qa")).items()])
    got = {r.qa: r for r in rows.collect()}
    assert [v for v in values if got[v].usable] == [1, 33]
    assert not got[0].valid_data
    flags = dict(zip(values[1:8], ["cloud", "cloud_shadow", "snow", "haze", "water", "saturated", "cirrus"]))
    for v, name in flags.items():
        assert [n for n in qa.QA_BITS if got[v][n]] == ["valid_data", name]


def test_stac_dialects(spark):
    items = [
        dict(id="a", properties={"datetime": "2024-03-15T05:32:11Z", "platform": "sentinel-2a", "constellation": "sentinel-2", "instruments": ["msi"],
                                 "view:off_nadir": 3.2, "proj:epsg": 32644}, assets={"visual": {"href": "x", "eo:platform": "sentinel-2a"}}),
        dict(id="b", properties={"datetime": "2024-03-15T05:32:11Z", "eo:platform": "sentinel-2b", "view:incidence_angle": 32.5, "proj:epsg": 32644}),
        dict(id="c", properties={"platform": "landsat-8", "instruments": ["oli"], "view:sun_elevation": 55.0}),
        dict(id="S2A_MSIL2A_20240315T053211", bbox=[77.1, 28.5, 77.3, 28.7], properties={
            "datetime": "2024-03-15T05:32:11Z", "platform": "S2A", "sat:incidence_angle": 12.4, "view:off_nadir": 5.2, "sat:orbit_state": "descending", "proj:epsg": 32643}),
        dict(id="e", assets={"x": {"sar:platform": "S1_A"}}, properties={"view:off_nadir": 0, "view_angle": 7}),
        dict(properties={"instruments": ["OLI"]}),
    ]
    rows = stac.parse_items(spark.createDataFrame([(json.dumps(i),) for i in items], "json string")).collect()
    assert [r.platform for r in rows] == ["sentinel-2a", "sentinel-2b", "landsat-8", "sentinel-2a", "s1-a", "oli"]
    assert [r.crs for r in rows] == ["EPSG:32644", "EPSG:32644", "EPSG:4326", "EPSG:32643", "EPSG:4326", "EPSG:4326"]
    assert rows[1].incidence_angle == 32.5 and rows[2].view_angle == 55.0 and rows[4].view_angle == 7.0
    full = rows[3]
    assert (full.incidence_angle, full.view_angle, full.orbit, full.bbox) == (12.4, 5.2, "descending", [77.1, 28.5, 77.3, 28.7])
    assert rows[5].id == "unknown_item" and rows[5].bbox == [0.0] * 4


def test_suppression_of_a_cloudy_corner(spark):
    mask = np.ones((10, 10), int)
    mask[:3, :3] = 3
    pair = spark.createDataFrame([Row(tile="t", width=10, prob=[1.0] * 100, qa1=[int(v) for v in mask.ravel()], qa2=[1] * 100, seasonal_delta=0.0)])
    px = ce.suppress(pair, ["tile"]).collect()
    assert {(r.y, r.x) for r in px if r.p == 0} == {(y, x) for y in range(3) for x in range(3)}
    assert all(r.mask for r in px if r.p > 0)
    m = ce.event_metrics(ce.suppress(pair, ["tile"]), ["tile"]).first()
    assert m.qa_coverage == pytest.approx(0.91) and not m.sar_fused
    # 1.0 * 0.8 (mild season) * 0.9 (no SAR) blended with the fixed weights.
    assert m.confidence == pytest.approx(0.4 * 0.72 + 0.2 * 0.91 + 0.15 * 0.5 + 0.15 + 0.1)


def test_event_of_a_bright_square(spark):
    t2 = np.zeros((32, 32))
    t2[10:20, 10:20] = 200
    arrays = {f"{b}{n}": [float(v) for v in (a * 1.0).ravel()] for b in "rgb" for n, a in (("1", np.zeros((32, 32))), ("2", t2))}
    pair = spark.createDataFrame([Row(tile="t", width=32, qa1=[1] * 1024, qa2=[1] * 1024, **arrays)])
    pair = radiometry.radiometric_align(pair, ["tile"], [(f"{b}1", f"{b}2", f"{b}a") for b in "rgb"])
    px = ce.suppress(ce.raw_change_prob(pair, ["r", "g", "b"], after="a"), ["tile"])
    hit = {(r.y, r.x) for r in px.where("mask").collect()}
    truth = {(y, x) for y in range(10, 20) for x in range(10, 20)}
    assert len(hit & truth) / len(hit | truth) > 0.8
    kind, morph = ce.semantics_from_scores(F.lit(len(hit)), F.lit(None).cast("array<double>"), F.lit(None).cast("array<double>"))
    got = spark.range(1).select(kind.alias("k"), morph.alias("m")).first()
    assert (got.k, got.m) == ("construction", "appearance")


def test_morphology_of_a_new_square(spark):
    rows = [Row(scene=1, y=y, x=x, a=False, b=5 <= y < 15 and 5 <= x < 15) for y in range(20) for x in range(20)]
    px = spark.createDataFrame(rows).withColumn("changed", F.col("a") != F.col("b"))
    assert nb.morphology_rule(px, ["scene"], "a", "b", "changed").first().morphology == "appearance"


@pytest.mark.parametrize("shift", [(0, 0), (2, -1), (-3, 3)])
def test_registration_finds_a_roll(spark, shift):
    base = np.random.default_rng(3).random((16, 16))
    moved = np.roll(base, shift, axis=(0, 1))
    pair = spark.createDataFrame([Row(width=16, **{f"{b}1": base.ravel().tolist() for b in "rgb"}, **{f"{b}2": moved.ravel().tolist() for b in "rgb"})])
    row = registration.coregister(pair, "rgb").first()
    assert (row["shift"].dy, row["shift"].dx) == (-shift[0], -shift[1])
    assert np.allclose(row.r2a, base.ravel())
    fine = registration.coregister_sub(pair, ["r"]).first()
    assert fine["shift"].dy == pytest.approx(-shift[0], abs=0.05) and fine["shift"].dx == pytest.approx(-shift[1], abs=0.05)


def test_subpixel_shift(spark):
    y, x = np.mgrid[0:32, 0:32]
    wave = lambda dy, dx: np.sin(2 * np.pi * (y - dy) / 32) + np.cos(2 * np.pi * 3 * (x - dx) / 32) + np.sin(2 * np.pi * 2 * ((y - dy) + (x - dx)) / 32)
    pair = spark.createDataFrame([Row(width=32, r1=wave(0, 0).ravel().tolist(), r2=wave(0.4, -0.3).ravel().tolist())])
    s = registration.coregister_sub(pair, ["r"]).first()["shift"]
    assert s.dy == pytest.approx(-0.4, abs=0.11) and s.dx == pytest.approx(0.3, abs=0.11)


def test_registration_of_constant_images(spark):
    pair = spark.createDataFrame([Row(width=8, r1=[1.0] * 64, r2=[1.0] * 64)])
    s = registration.coregister_sub(pair, ["r"]).first()["shift"]
    assert abs(s.dy) < 0.1 and abs(s.dx) < 0.1


def test_earliest_date(spark):
    acq = spark.createDataFrame([("s", "2023-01-01", 0.0, 1.0), ("s", "2023-06-01", 0.10, 1.0), ("s", "2024-01-01", 0.95, 1.0), ("lone", "2023-01-01", 0.9, 1.0)],
                                "site string, d string, confidence double, qa_coverage double").withColumn("ts", F.to_timestamp("d"))
    pairs = timeline.scene_pairs(acq, "site", "ts", ["confidence", "qa_coverage"])
    out = {r.site: r for r in timeline.earliest_supported(acq, timeline.date_confidence(pairs, "site", "ts"), "site").collect()}
    assert str(out["s"].earliest_supported_date) == "2024-01-01 00:00:00" and out["s"].n_pairs == 2
    assert out["lone"].earliest_supported_date is None and out["lone"].n_pairs == 0


def test_confusion(spark):
    df = spark.createDataFrame([(True, True), (True, False), (False, True), (False, False)], "p boolean, g boolean")
    m = evaluation.seg_metrics(df, F.col("p"), F.col("g")).first()
    assert (m.precision, m.recall, m.fpr) == (0.5, 0.5, 0.5)
    none = evaluation.seg_metrics(df.where("not p and not g"), F.col("p"), F.col("g")).first()
    assert (none.precision, none.recall, none.f1) == (1.0, 0.0, 0.0)


def test_holdout_is_exact_and_disjoint(spark):
    ids = spark.range(100).select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("id"))
    train, held = (set(r.id for r in d.collect()) for d in evaluation.split_holdout(ids, "id"))
    assert (len(train), len(held)) == (80, 20) and not train & held
    assert evaluation.split_holdout(ids.limit(1), "id")[1].count() == 0


def test_class_weights(spark):
    df = spark.createDataFrame(list(enumerate([0] * 8 + [1, 2])), "i int, cls int")
    w = [r.weight for r in evaluation.class_weights(df, "cls").orderBy("i").collect()]
    assert sum(w) == pytest.approx(1.0) and w[8] > w[0] and w[8] == pytest.approx(w[9])


@pytest.mark.parametrize("size,source,out", [(200, 0.5, 10), (10, 30.0, 30)])
def test_resample_sizes(spark, size, source, out):
    px = spark.range(size * size).select(F.lit(1).alias("s"), F.expr(f"int(id div {size})").alias("y"), F.expr(f"int(id % {size})").alias("x"), F.col("id").alias("v"), F.lit(size).alias("h"), F.lit(size).alias("w"))
    rows = radiometry.block_resample_nearest(px, ["s"], "h", "w", "v", source, 10.0).collect()
    index = np.linspace(0, size - 1, out).astype(int)
    assert {(r.y, r.x): r.v for r in rows} == {(i, j): int(index[i]) * size + int(index[j]) for i in range(out) for j in range(out)}
    with pytest.raises(ValueError):
        radiometry.block_resample_nearest(px, ["s"], "h", "w", "v", 0.0, 10.0)


def test_histogram_match_to_a_constant(spark):
    src = spark.createDataFrame([("a", 50.0)] * 5, "k string, v double")
    ref = spark.createDataFrame([("a", 200.0)] * 7, "k string, v double")
    assert {r.matched for r in radiometry.histogram_match(src, ref, ["k"], "v").collect()} == {200.0}


def test_standardize(spark):
    chip = np.random.default_rng(1).uniform(500, 3000, (32, 32))
    out = np.array(radiometry.domain_standardize(spark.createDataFrame([Row(tile="t", **block(chip))]), ["tile"], "values", "out").first().out)
    assert out.min() >= 0 and out.max() <= 1 and abs(out.mean() - 0.15) < 0.08


def test_four_spread_alerts_fall_back_to_one_cluster(spark):
    pts = spark.createDataFrame([("ALT-2026-024", 13.3408, 77.1009, 0.92, "a"), ("ALT-2026-025", 16.2, 80.5, 0.95, "b"), ("ALT-2026-026", 12.9141, 75.5, 0.88, "c"),
                                 ("ALT-2026-027", 13.12, 76.98, 0.68, "d")], "alert_id string, lat double, lng double, confidence double, type string")
    got = clusters.clusters_or_fallback(pts, clusters.spatial_clusters(pts, 0.1)).collect()
    assert len(got) == 1 and got[0].member_count == 4 and got[0].confidence == 0.86
    assert (got[0].center_lat, got[0].center_lng) == (13.89372, 77.52022)
    assert (got[0].min_lat, got[0].min_lng, got[0].max_lat, got[0].max_lng) == pytest.approx((12.9041, 75.49, 16.21, 80.51))


def test_blocks_of_unequal_size_are_an_error(spark):
    a = spark.createDataFrame([Row(tile="t", width=2, r=[1.0, 2.0, 3.0, 4.0])])
    b = spark.createDataFrame([Row(tile="t", width=3, r=[1.0, 2.0, 3.0])])
    with pytest.raises(Exception, match="block shapes differ"):
        bitemporal_join(a, b, ["tile"], ["r"]).collect()
    assert bitemporal_join(a, b, ["tile"], ["r"], strict=False).count() == 0


def test_unroll_and_roll_up_are_inverse(spark):
    df = spark.createDataFrame([Row(tile="t", **block(np.arange(6).reshape(2, 3)))])
    back = roll_up(unroll(df, ["tile"], ["values"]), ["tile"], ["values"]).first()
    assert back.width == 3 and back.values == [0.0, 1.0, 2.0, 3.0, 4.0, 5.0]


def test_view_angle_zero_falls_through(spark):
    df = spark.createDataFrame([(0.0, 10.0, 30.0, None), (None, None, 5.0, 1.0), (1.0, None, 16.0, None)], "v1 double, i1 double, v2 double, i2 double")
    ok, delta = ce.view_angle(*[F.col(c) for c in ("v1", "i1", "v2", "i2")])
    assert [tuple(r) for r in df.select(ok, delta).collect()] == [(False, 20.0), (True, 0.0), (True, 15.0)]
