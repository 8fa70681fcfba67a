"""Growth of plans: shared statistics and cells, on rows of the tests' own."""

import math
import random
import statistics

import numpy as np
from pyspark.sql import functions as F

from scenelake.operators import radiometry
from scenelake.operators.registration import shift_join


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_bands_are_standardised_by_one_join(spark):
    """six bands were six nested joins, whose tables were made 64 times."""
    rng = random.Random(1)
    rows = [(s % 3, [rng.random() for _ in range(4)], [0.5] * 4, None if s == 2 else [rng.random() for _ in range(4)]) for s in range(5)]
    df = spark.createDataFrame(rows, "scene int, a array<double>, b array<double>, c array<double>")
    bands = ["a", "b", "c"]
    one = radiometry.domain_standardize(df, ["scene"], bands, ["a_", "b_", "c_"])
    assert plan(one).count("Join") == 1
    got = {(r.scene, tuple(r.a)): r for r in one.collect()}
    scenes = {s for s, *_ in rows if any(r[3] for r in rows if r[0] == s)}  # a scene without any value of a band is left out
    assert {k[0] for k in got} == scenes and len(got) == sum(r[0] in scenes for r in rows)
    for scene, *arrays in rows:
        if scene not in scenes:
            continue
        for i, c in enumerate(bands):
            values = [x for r in rows if r[0] == scene and r[i + 1] for x in r[i + 1]]
            m, s = statistics.fmean(values), statistics.pstdev(values)
            out = got[scene, tuple(arrays[0])][f"{c}_"]
            if arrays[i] is None:
                assert out is None
                continue
            want = [min(1.0, max(0.0, (x - m) / s * 0.10 + 0.15 if s > 1e-6 else x)) for x in arrays[i]]
            assert all(math.isclose(x, y, abs_tol=1e-9) for x, y in zip(out, want, strict=True))


def test_shifted_pixels_meet_in_cells(spark):
    """every pixel was copied for each of 121 shifts, and the pixels were gathered in the driver."""
    rng = random.Random(2)
    rows = [(rng.choice([1, 2, None]), rng.randrange(40), rng.randrange(40), rng.random(), rng.random()) for _ in range(700)]
    rows += rows[:20] + [(1, None, 3, 0.5, 0.5), (1, -3, -2, 0.5, 0.25)]
    df = spark.createDataFrame(rows, "s int, y int, x int, a double, b double")
    found = shift_join(df, ["s"], "a", "b", reach=4)
    text = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in text and "SortMergeJoin" in text
    want = sorted((s, y, x, a, y - y2, x - x2, b) for s, y, x, a, _ in rows for s2, y2, x2, _, b in rows
                  if s is not None and s == s2 and None not in (y, y2) and abs(y - y2) < 4 and abs(x - x2) < 4)
    assert found.columns == ["s", "y", "x", "a", "dy", "dx", "b"] and sorted(map(tuple, found.collect())) == want
    assert found.where(F.col("dy").isNull()).count() == 0


def test_vectors_stay_out_of_the_driver(spark, monkeypatch):
    """F8, F9, F11, F12: queries passed through the driver, and every 128 points all queries were sorted anew."""
    from pyspark.sql.classic.dataframe import DataFrame

    from scenelake.operators import vectors

    rng = np.random.default_rng(3)
    x = rng.standard_normal((90, 6))
    x[30:60] = x[30]  # ties go to the smaller id
    rows = [(f"t{i:02d}", "ab"[i % 2], [float(v) for v in r]) for i, r in enumerate(x)]
    p = spark.createDataFrame(rows, "tile_id string, aoi string, embedding array<double>").repartition(3)
    q = p.select(F.col("tile_id").alias("query_id"), "aoi", F.col("embedding").alias("vector"))

    def refuse(*_, **__):
        raise AssertionError("rows went to the driver")

    with monkeypatch.context() as patch:
        for name in ("toLocalIterator", "collect", "toPandas"):
            patch.setattr(DataFrame, name, refuse)
        found = vectors.vector_topk(p, q, 4, block_values=60, bucket="aoi")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = {}
    for r in found.orderBy("query_id", "vec_rank").collect():
        got.setdefault(r.query_id, []).append(r.tile_id)
    for i, (name, aoi, _) in enumerate(rows):
        score = np.round(unit @ unit[i], 9)
        assert got[name] == [rows[j][0] for j in sorted((j for j in range(90) if rows[j][1] == aoi), key=lambda j: (-score[j], j))[:4]]


def test_best_points_of_a_block():
    """a block made one table per query; now all queries of a block are judged together."""
    from scenelake.operators import vectors

    rng = np.random.default_rng(5)
    for n, m, k in ((1, 3, 4), (400, 30, 5), (97, 8, 10)):
        points, queries = vectors._unit(rng.integers(-2, 3, (n, 3)).astype(float)), vectors._unit(rng.standard_normal((m, 3)))
        q, at, score = vectors._best_of(queries, points, k)
        for i in range(m):
            all_ = np.round(points @ queries[i], 9) + 0.0
            assert list(at[q == i]) == sorted(range(n), key=lambda j: (-all_[j], j))[:k]


def test_tile_rows_are_rounded_in_compiled_code(spark):
    """each of five figures of a tile was rounded by an interpreted array function."""
    from scenelake.functions.mathx import round_to
    from scenelake.sources import records

    values = [0.0000005, 1.0000015, -3.1234565, 2.5, 1e-7, -0.0, float("nan"), None, 77.1234564999999, 12.005, 12.015, 179.999999500001]
    rows = [(str(i), i, v, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "tile_id string, scene_id long, v double, cloud_percentage double")
    df = df.select("*", *[F.lit(1).alias(c) for c in ("tile_x", "tile_y", "tile_width", "tile_height")],
                   *[F.col("v").alias(c) for c in ("min_lon", "min_lat", "max_lon", "max_lat")])
    out = records.tile_csv_rows(df)
    assert "transform(" not in plan(out)
    want = df.select("tile_id", round_to(F.col("v"), 6).alias("a"), round_to(F.col("v"), 2).alias("b")).collect()
    got = {r.tile_id: (r.max_lat, r.cloud_percentage) for r in out.collect()}
    assert {r.tile_id: str((r.a, r.b)) for r in want} == {t: str(v) for t, v in got.items()}


def test_scenes_of_one_file_are_tiled_by_many_tasks(spark):
    """the tiles of one small file of scenes were all made by one task."""
    from scenelake.operators import neighbourhood as nb

    scenes = spark.range(200).coalesce(1).select(F.col("id").alias("scene_id"), F.lit(600).alias("height"), F.lit(900).alias("width"))
    tiles = nb.tile_grid(scenes, filter_edges=False)
    assert tiles.count() == 200 * 12 and tiles.select(F.spark_partition_id().alias("p")).distinct().count() > 4
