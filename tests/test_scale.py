"""Hot keys, long chains, brute force on small fixtures, and plan shapes."""

import glob
import itertools
import os

import numpy as np
import pytest
from pyspark.sql import Row, functions as F

from scenelake.operators import clusters, evaluation, feedback, neighbourhood as nb, radiometry, ranks, timeline
from scenelake.operators.components import connected_components
from scenelake.operators.ranks import grouped_cdf, grouped_quantiles, lowest_n
from scenelake.plans import rgb_report
from scenelake.sources import manifest, pairs, rasters, records


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def groups(pairs_, nodes):
    """Plain union-find."""
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            parent[n] = parent[parent[n]]
            n = parent[n]
        return n

    for a, b in pairs_:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_of_a_chain_a_star_and_islands(spark):
    edges = [(i, i + 1) for i in range(40)] + [(50, i) for i in range(51, 90)] + [(95, 94), (94, 93)]
    nodes = list(range(100))
    got = connected_components(spark.createDataFrame([(n,) for n in nodes], "node long"), spark.createDataFrame(edges, "src long, dst long"))
    assert {r.node: r.component for r in got.collect()} == groups(edges, nodes)


@pytest.mark.parametrize("most,buckets", [(100_000, 1024), (400, 8)])
def test_quantiles_of_a_hot_group(spark, most, buckets, monkeypatch):
    monkeypatch.setattr(ranks, "BUCKET_ROWS", 10)
    monkeypatch.setattr(ranks, "ORDERED_ROWS", most)
    rng = np.random.default_rng(2)
    data = [("hot", float(x)) for x in np.round(rng.lognormal(size=500), 3)] + [("hot", 0.0)] * 300 + [("flat", 3.0)] * 5 + [("one", 1.5)]
    df = spark.createDataFrame(data, "k string, v double")
    got = {r.k: (r.a, r.b) for r in grouped_quantiles(df, ["k"], "v", [0.02, 0.98], ["a", "b"], buckets=buckets).collect()}
    for k in ("hot", "flat", "one"):
        want = np.percentile([x for g, x in data if g == k], [2, 98])
        assert got[k] == pytest.approx(tuple(want))


def test_cdf_and_histogram_match(spark, monkeypatch):
    monkeypatch.setattr(ranks, "BUCKET_ROWS", 10)
    rng = np.random.default_rng(4)
    src, ref = np.round(rng.normal(size=400), 2), np.round(rng.exponential(size=150), 2)
    s = spark.createDataFrame([("k", i, float(x)) for i, x in enumerate(src)], "k string, i int, v double")
    r = spark.createDataFrame([("k", float(x)) for x in ref], "k string, v double")
    sv, index, sc = np.unique(src, return_inverse=True, return_counts=True)
    rv, rc = np.unique(ref, return_counts=True)
    want = np.interp(np.cumsum(sc) / src.size, np.cumsum(rc) / ref.size, rv)[index]
    for buckets in (4, 64):
        cdf = {x.v: x.q for x in grouped_cdf(s, ["k"], "v", buckets=buckets).collect()}
        assert [cdf[x] for x in sv] == pytest.approx(list(np.cumsum(sc) / src.size))
        rows = radiometry.histogram_match(s, r, ["k"], "v", buckets=buckets).orderBy("i").collect()
        assert [x.matched for x in rows] == pytest.approx(list(want))


def test_lowest_n_with_equal_prefixes(spark):
    df = spark.createDataFrame([(i, f"{i % 3:04x}{i:08x}") for i in range(60)], "id int, h string")
    got = {r.id for r in lowest_n(df, "id", F.lit(33), "h").collect()}
    assert got == set(sorted(range(60), key=lambda i: (i % 3, i))[:33])


def test_next_row_across_time_buckets(spark):
    rng = np.random.default_rng(9)
    rows = [("hot" if i % 3 else "cold", int(t)) for i, t in enumerate(rng.permutation(300))]
    df = spark.createDataFrame(rows, "k string, t int")
    got = {(r.k, r.t): r.next and r.next.t for r in timeline.with_next(df, ["k"], ["t"], ["t"], F.expr("t div 37")).collect()}
    for k in ("hot", "cold"):
        order = sorted(t for g, t in rows if g == k)
        assert [got[k, t] for t in order] == order[1:] + [None]


@pytest.mark.parametrize("eps", [0.05, 0.21])
def test_clusters_equal_brute_force(spark, eps):
    rng = np.random.default_rng(6)
    xy = np.concatenate([np.round(rng.random((120, 2)), 3), np.tile([[0.5, 0.5]], (80, 1)), rng.normal([0.2, 0.8], 0.01, (60, 2)),
                         np.round(rng.random((40, 2)) * 2 - 1, 1)])
    ids = [f"p{i:03d}" for i in range(len(xy))]
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in zip(ids, xy)], "alert_id string, lat double, lng double")
    near = [(ids[i], ids[j]) for i, j in itertools.combinations(range(len(xy)), 2) if np.hypot(*(xy[i] - xy[j])) <= eps]
    got = {r.alert_id: r.cluster for r in clusters.spatial_clusters(df, eps).collect()}
    assert got == groups(near, ids)


def test_regions_do_not_see_block_borders(spark):
    rng = np.random.default_rng(8)
    scenes = {0: rng.random((12, 12)) < 0.55, 1: np.ones((12, 12), bool), 2: np.zeros((12, 12), bool)}
    spiral = np.zeros((12, 12), bool)
    spiral[0, :], spiral[:, 11], spiral[11, :], spiral[2:, 0], spiral[2, :10], spiral[2:10, 9] = (True,) * 6
    scenes[3] = spiral
    rows = [Row(scene_id=s, block_row=i, block_col=j, block_size=4, width=4, mask=[bool(v) for v in m[4 * i:4 * i + 4, 4 * j:4 * j + 4].ravel()])
            for s, m in scenes.items() for i in range(3) for j in range(3)]
    got = nb.change_regions(spark.createDataFrame(rows)).collect()
    for s, m in scenes.items():
        on = {(int(y), int(x)) for y, x in zip(*np.nonzero(m))}
        links = [(p, q) for p in on for q in ((p[0] + 1, p[1]), (p[0], p[1] + 1)) if q in on]
        label = groups(links, on)
        want = sorted(sum(1 for p in on if label[p] == root) for root in set(label.values()))
        assert sorted(r.n_pixels for r in got if r.scene_id == s) == want


def test_contains_match_without_pairs(spark):
    alerts = spark.createDataFrame([("ALT-1",), ("ALT-12",), ("ALT-2",)], "alert_id string")
    fb = spark.createDataFrame([("ALT-12",), ("12",), ("T-1",), ("zzz",), ("ALT-1",), ("LT-1",)] + [("ALT-2",)] * 50, "alert_id string")
    out = feedback.match_feedback(fb, alerts)
    got = {r.alert_id: r.matched_id for r in out.collect()}
    assert got == {"ALT-12": "ALT-12", "12": "ALT-12", "T-1": "ALT-1", "zzz": None, "ALT-1": "ALT-1", "LT-1": "ALT-1", "ALT-2": "ALT-2"}
    assert out.count() == fb.count()


def test_pair_pipeline_aggregates_without_a_second_shuffle(spark, small):
    from checks import views
    pairs_ = views.pairs(spark, small)
    report = rgb_report.change_summary(rgb_report.change_pixels(pairs_, ["scene"], register=False), ["scene"])
    text = plan(report)
    # One exchange gathers a scene's bands; the scalar subquery of the view adds its own.
    main = text.split("Subquery")[0]
    assert main.count("Exchange hashpartitioning(scene") == 1


def test_projection_reaches_the_scan(spark, small):
    from __spark_entry__ import queries
    text = plan(queries()["catalog_search"](spark, small))
    assert "PushedFilters: [IsNotNull(user_id), IsNotNull(ts), IsNotNull(value)" in text
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint,value" in text


def test_no_cartesian_products(spark, small):
    from __spark_entry__ import queries
    lazy = ["change_report", "hybrid_rank", "histogram_match", "feedback_alert_match", "stac_ingest_route", "morphology_rule", "query_parse", "percentile_stretch"]
    for name in lazy:
        assert "CartesianProduct" not in plan(queries()[name](spark, small)), name


def test_raster_files_round_trip(spark, tmp_path):
    chip = np.random.default_rng(0).random((3, 9, 7)).astype("float32")
    np.save(tmp_path / "a.npy", chip)
    blocks = rasters.scan(spark, str(tmp_path), block=4)
    px = {}
    for b in blocks.collect():
        part = np.array(b["values"]).reshape(b.height, b.width)
        for (y, x), v in np.ndenumerate(part):
            px[b.band, b.block_row * 4 + y, b.block_col * 4 + x] = v
    assert all(px[i] == float(v) for i, v in np.ndenumerate(chip)) and len(px) == chip.size
    assert {b.dtype for b in blocks.select("dtype").distinct().collect()} == {"float32"}


def mask_blocks(spark, name, image, size):
    rows = []
    for r in range(-(-image.shape[0] // size)):
        for c in range(-(-image.shape[1] // size)):
            part = image[r * size:(r + 1) * size, c * size:(c + 1) * size]
            rows.append((name, r, c, size, part.shape[1], part.astype(float).ravel().tolist()))
    return spark.createDataFrame(rows, "tile_id string, block_row int, block_col int, block_size int, width int, mask array<double>")


def cell_means(image, level):
    side = 1 << level
    return {(y // side, x // side): image[y:y + side, x:x + side].mean() for y in range(0, image.shape[0], side)
            for x in range(0, image.shape[1], side)}


def test_mask_sink_adds_overviews_to_large_masks_only(spark, tmp_path):
    rng = np.random.default_rng(3)
    big, wide, tiny = rng.random((70, 90)) > 0.5, rng.random((5, 66)) > 0.3, rng.random((9, 7)) > 0.5
    blocks = mask_blocks(spark, "big", big, 32).unionAll(mask_blocks(spark, "wide", wide, 32)).unionAll(mask_blocks(spark, "tiny", tiny, 32))
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rasters.write_mask(blocks.mapInArrow(counted, blocks.schema), str(tmp_path / "m"), min_size=64)
    assert seen.value == blocks.count()  # the input is evaluated once
    got = {}
    for r in rasters.read_mask(spark, str(tmp_path / "m")).collect():
        got.setdefault((r.tile_id, r.level), {})[r.y, r.x] = r.mask
    assert set(got) == {("tiny", 0), *[(t, n) for t in ("big", "wide") for n in range(5)]}
    for (tile, level), cells in got.items():
        assert cells == pytest.approx(cell_means({"big": big, "wide": wide, "tiny": tiny}[tile], level))


def test_masks_are_blocks_on_disk_and_appended(spark, tmp_path):
    image = np.arange(64 * 64).reshape(64, 64) % 3 == 0
    for name in ("a", "b"):
        rasters.write_mask(mask_blocks(spark, name, image, 32), str(tmp_path / "m"), min_size=64)
    stored = spark.read.parquet(str(tmp_path / "m"))
    assert {(r.tile_id, r.level): r["count"] for r in stored.groupBy("tile_id", "level").count().collect()} == {
        (t, n): 4 for t in "ab" for n in range(5)}
    with pytest.raises(Exception, match="whole cells"):
        rasters.write_mask(mask_blocks(spark, "odd", image, 24), str(tmp_path / "odd"), min_size=8)


def test_a_file_above_two_gigabytes_is_read_by_window(spark, tmp_path):
    """Sparse zeros with a few values: only the windows asked for are read, by many tasks."""
    bands, height, width = 2, 16_400, 16_400
    path = tmp_path / "big.npy"
    image = np.lib.format.open_memmap(path, mode="w+", dtype="float32", shape=(bands, height, width))
    spots = {(0, 0, 0): 1.5, (1, 300, 16_399): 2.5, (1, 16_399, 16_399): 3.5}
    for at, value in spots.items():
        image[at] = value
    del image
    assert os.path.getsize(path) > 2 << 30
    reader = rasters.RasterReader({"path": str(path), "block": "256"})
    parts = reader.partitions()
    assert len(parts) == -(-os.path.getsize(path) // rasters.TASK_BYTES)
    with open(path, "rb") as source:
        windows = rasters.Windows(source)
        assert windows.places(256) == (2, 65, 65)
        assert windows.read(0, 0, 0, 256)[0, 0] == 1.5 and windows.read(1, 1, 64, 256)[44, 15] == 2.5
        assert windows.read(1, 64, 64, 256).shape == (16, 16) and windows.read(1, 64, 64, 256)[15, 15] == 3.5
    last = [b for batch in reader.read(parts[-1]) for b in batch.to_pylist()]
    total = 2 * 65 * 65
    assert len(last) == total - total * (len(parts) - 1) // len(parts)
    assert [max(b["values"]) for b in last if max(b["values"])] == [3.5]


def test_windows_of_many_files_and_a_failed_write(spark, tmp_path):
    rng = np.random.default_rng(1)
    images = {f"i{i}": rng.random((1 + i % 3, 20 + i, 13)) for i in range(12)}
    rows = [(n, *a.shape, a.ravel().tolist()) for n, a in images.items()]
    rasters.write_images(spark.createDataFrame(rows, rasters.IMAGE_SCHEMA).repartition(4), str(tmp_path / "r"))
    assert sorted(os.listdir(tmp_path / "r")) == sorted(f"{n}.npy" for n in images)
    for task_bytes in (1000, 1 << 20):
        found = {}
        for b in rasters.scan(spark, str(tmp_path / "r"), block=8, task_bytes=task_bytes).collect():
            found[os.path.basename(b.path)[:-4], b.band, b.block_row, b.block_col] = np.array(b["values"]).reshape(b.height, b.width)
        for n, a in images.items():
            for band, y, x in np.ndindex(a.shape[0], -(-a.shape[1] // 8), -(-a.shape[2] // 8)):
                assert (found.pop((n, band, y, x)) == a[band, y * 8:y * 8 + 8, x * 8:x * 8 + 8]).all()
        assert not found
    bad = spark.createDataFrame([*rows[:2], ("bad", 1, 2, 2, [1.0])], rasters.IMAGE_SCHEMA).repartition(1)
    with pytest.raises(Exception):
        rasters.write_images(bad, str(tmp_path / "f"))
    assert not [f for f in os.listdir(tmp_path / "f") if f.endswith(".npy")]
    rasters.write_images(spark.createDataFrame(rows[:3], rasters.IMAGE_SCHEMA), str(tmp_path / "r"), "overwrite")
    assert len(os.listdir(tmp_path / "r")) == 3


def test_manifest_finds_changes(spark, tmp_path):
    for name in ("a", "b", "c"):
        (tmp_path / "w").mkdir(exist_ok=True)
        (tmp_path / "w" / f"{name}.bin").write_bytes(name.encode())
    sums = manifest.checksums(spark, str(tmp_path / "w"))
    manifest.append_manifest(sums, str(tmp_path / "manifest"))
    (tmp_path / "w" / "a.bin").write_bytes(b"changed")
    os.rename(tmp_path / "w" / "b.bin", tmp_path / "w" / "d.bin")
    out = manifest.verify(manifest.read_manifest(spark, str(tmp_path / "manifest")), manifest.checksums(spark, str(tmp_path / "w")))
    assert {os.path.basename(r.path): r.state for r in out.collect()} == {"a.bin": "changed", "b.bin": "missing", "c.bin": "same", "d.bin": "added"}


@pytest.mark.parametrize("layout,paths,want", [
    ("second", ["/s/test/im1/1.png", "/s/test/im2/1.png", "/s/test/label1/1.png", "/s/test/im1/2.png"], [("1.png", "/s/test/label1/1.png")]),
    ("sen1floods", ["/v/HandLabeled/S2Hand/X_1_S2Hand.tif", "/v/HandLabeled/S1Hand/X_1_S1Hand.tif", "/v/HandLabeled/LabelHand/X_1_LabelHand.tif"],
     [("X_1_S2Hand.tif", "/v/HandLabeled/LabelHand/X_1_LabelHand.tif")]),
    ("oscd", ["/o/rome/imgs_1_rect/B04.tif", "/o/rome/imgs_2_rect/B04.tif", "/o/rome/imgs_1_rect/B03.tif", "/o/rome/cm/cm.png"], [("rome", "/o/rome/cm/cm.png")]),
    ("s2looking", ["/l/train/Image1/9.png", "/l/train/Image2/9.png"], [("9.png", None)]),
])
def test_pair_layouts(spark, layout, paths, want):
    out = pairs.index_pairs(spark.createDataFrame([(p,) for p in paths], "path string"), layout).collect()
    mask = "mask1" if layout == "second" else "mask"
    assert [(r["sample"], r[mask]) for r in out] == want


def test_events_are_exported_in_clustered_files(spark, small, tmp_path):
    from checks.events import assembled
    ev = assembled(spark, small)
    masks = ev.select("event_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("block_row"), F.lit(0).alias("block_col"),
                      F.lit(2).alias("block_size"), F.lit(2).alias("width"), F.array(*[F.lit(1.0)] * 4).alias("mask"))
    records.export_events(ev, str(tmp_path / "out"), masks, files=4)
    stored = records.read_events(spark, str(tmp_path / "out"))
    n = ev.count()
    assert {r.artifact: r["count"] for r in stored.groupBy("artifact").count().collect()} == {
        "stac": n, "provenance": n, "readme": n, "mask": 4 * n}
    assert len(glob.glob(str(tmp_path / "out/artifact=*/*.parquet"))) <= 16
    one = stored.where(F.col("event_id") == ev.first()["event_id"])
    assert one.where("artifact = 'readme'").collect()[0]["value"].startswith("Change Event: ")
    assert one.where("artifact = 'mask'").count() == 4


def test_load_alerts_only_into_an_empty_table(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"id":"A1","confidence":0.5}\n{"id":"A2"}\n')
    first = records.load_alerts(spark, str(tmp_path / "a.json"))
    assert {(r.alert_id, r.status, r.confidence) for r in first.collect()} == {("A1", "PENDING REVIEW", 0.5), ("A2", "PENDING REVIEW", 0.9)}
    assert records.load_alerts(spark, str(tmp_path / "a.json"), first.limit(1)).count() == 1
    assert records.load_alerts(spark, str(tmp_path / "a.json"), first.where("false")).count() == 2


def test_tile_grid_in_sql(spark):
    from scenelake.functions import sql
    sql.register(spark)
    scenes = spark.createDataFrame([(7, 300, 520)], "scene_id int, height int, width int").withColumn("bbox", F.array(*[F.lit(0.0)] * 4))
    scenes.createOrReplaceTempView("scenes")
    got = {(r.tile_x, r.tile_y, r.x_end, r.y_end) for r in spark.sql("SELECT g.* FROM scenes, LATERAL tile_grid(height, width, 256) g").collect()}
    want = {(r.tile_x, r.tile_y, r.x_end, r.y_end) for r in nb.tile_grid(scenes, filter_edges=False).collect()}
    assert got == want and len(got) == 6


def test_order_statistics_survive_outliers(spark, monkeypatch):
    """One value of 1e9 must not leave its group in one range."""
    from scenelake.operators import ranks
    monkeypatch.setattr(ranks, "ORDERED_ROWS", 3000)
    rng = np.random.default_rng(3)
    values = np.concatenate([rng.random(20_000), [1e9, -1e9]])
    frame = spark.createDataFrame([(1, float(v)) for v in values] + [(2, 5.0)] * 2000, "k int, v double").repartition(8)
    got = {r["k"]: (r["a"], r["b"]) for r in ranks.grouped_quantiles(frame, ["k"], "v", [0.02, 0.98], ["a", "b"]).collect()}
    assert np.allclose(got[1], np.quantile(values, [0.02, 0.98])) and got[2] == (5.0, 5.0)
    cdf = ranks.grouped_cdf(frame, ["k"], "v")
    found = {r["v"]: r["q"] for r in cdf.where("k = 1").collect()}
    for share, v in enumerate(np.sort(values), 1):
        assert abs(found[float(v)] - share / len(values)) < 1e-12


@pytest.fixture
def no_broadcast(spark):
    """Joins by exchange, tasks not merged, so that the rows of a partition are those of a task."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "64"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, x in conf.items():
        spark.conf.set(k, x)
    yield
    for k, x in before.items():
        spark.conf.set(k, x)


def heat(pixels):
    return rgb_report.heatmap_rgba(pixels.withColumnRenamed("v", "distance"), ["k"], bounded=False)


def colours(pixels):
    reports = pixels.select("k").distinct().withColumn("category", F.lit("NO_CHANGE"))
    return rgb_report.mask_rgba(pixels.withColumn("changed", F.col("v") > 0), reports, ["k"])


@pytest.mark.parametrize("operator", [
    lambda px: radiometry.percentile_stretch(px, ["k"], "v"), heat, colours, lambda px: evaluation.class_weights(px, "k"),
    lambda px: timeline.seasonal_zscore(px.withColumn("ts", F.lit("2024-03-01").cast("timestamp")), "k", "ts", "v")],
    ids=["stretch", "heatmap", "mask", "class_weights", "zscore"])
def test_a_key_with_a_third_of_the_rows_is_spread(spark, no_broadcast, operator):
    n = 6000
    rows = spark.range(n).select(F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id") % 200).alias("k"),
                                 F.col("id").alias("y"), F.lit(0).alias("x"), F.rand(5).alias("v"))
    out = operator(rows)
    tasks = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(tasks) == n and max(tasks) < n / 12  # the key alone has n / 3


def test_scene_figures_of_a_hot_scene_are_spread(spark, no_broadcast):
    from scenelake.operators.scenes import scene_values

    n = 6000
    rows = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id") % 200).alias("scene"), F.col("id").alias("block_row"),
        F.lit(0).alias("block_col"), F.lit(8).alias("block_size"), F.rand(1).alias("v"))
    out = scene_values(rows, ["scene"], {"top": (F.col("v"), F.max)})
    tasks = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(tasks) == n and max(tasks) < n / 12
    assert out.where("scene = -1").agg(F.min("top"), F.max("top")).collect()[0][0] == out.where("scene = -1").agg(F.max("v")).collect()[0][0]
