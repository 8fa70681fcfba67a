"""QA/SAR change events, stacks, timelines and neighbourhood operators."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from checks import views as v
from checks.pixels import CHANGE_PX, PROB, _changes, scored
from checks.registry import check
from scenelake.operators import evaluation, neighbourhood as nb, radiometry, registration as reg, timeline
from scenelake.operators.blocks import roll_up, unroll
from scenelake.plans import change_event as ce, rgb_report as rgb
from scenelake.session import ensure_checkpoint_dir
from scenelake.sources import pairs as pair_source, rasters, records

# Masks and backscatter derived from the bands: even scenes use bit flags, odd
# scenes scene classes; every third scene has no SAR.
_MASK = "CASE WHEN scene % 2 = 1 THEN CAST(floor({c} * 997.0) AS BIGINT) % 12 WHEN CAST(floor({c} * 997.0) AS BIGINT) % 8 = 0 THEN 3 WHEN CAST(floor({c} * 997.0) AS BIGINT) % 8 = 1 THEN 33 ELSE 1 END"
META = "CAST(scene % 5 AS DOUBLE) AS offset_mag, scene % 4 <> 0 AS view_ok, (scene % 10) / 50.0 AS seasonal_delta, 1.0 - (scene % 5) / 10.0 AS reg_conf"


def _mask(array: str):
    def one(x):
        n = F.floor(x * 997.0)
        bits = F.when(n % 8 == 0, 3).when(n % 8 == 1, 33).otherwise(1)
        return F.when(F.col("scene") % 2 == 1, (n % 12).cast("int")).otherwise(bits)

    return F.transform(array, one)


def event_pairs(s, sf):
    sar = lambda a: F.when(F.col("scene") % 3 != 0, F.transform(a, lambda x: x * 0.4))
    return scored(s, sf).withColumns({
        "qa1": _mask("r1"), "qa2": _mask("r2"), "sar1": sar("g1"), "sar2": sar("b2"),
        "offset_mag": (F.col("scene") % 5).cast("double"), "view_ok": F.col("scene") % 4 != 0,
        "seasonal_delta": (F.col("scene") % 10) / 50.0, "reg_conf": F.lit(1.0) - (F.col("scene") % 5) / 10.0})


def _usable(m: str, flag: str) -> str:
    return f"CASE WHEN {flag} THEN {m} IN (2, 4, 5, 6, 7) ELSE ({m} & 1) > 0 AND ({m} & 222) = 0 END"


def _scl(m: str) -> str:
    return (f"max({m}) <= 11 AND count(DISTINCT {m}) >= 2 AND (bool_or({m} IN (4, 6, 7)) OR "
            f"(bool_or({m} = 5) AND bool_or({m} IN (8, 9, 10))))")


EVENT = PROB + f""",
qa AS (SELECT scene, y, x, {_MASK.format(c='r1')} AS qa1, {_MASK.format(c='r2')} AS qa2, g1 * 0.4 AS s1, b2 * 0.4 AS s2 FROM pair_px),
enc AS (SELECT scene, {_scl('qa1')} AS e1, {_scl('qa2')} AS e2,
        CASE WHEN scene % 3 <> 0 THEN greatest(0.0, least(1.0, avg(abs(s2 - s1)) / (0.2 + 1e-6))) END AS sar_agreement
        FROM qa GROUP BY scene),
us AS (SELECT qa.scene, y, x, ({_usable('qa1', 'e1')}) AND ({_usable('qa2', 'e2')}) AS usable, sar_agreement, {META}
       FROM (SELECT scene, * EXCLUDE (scene) FROM qa JOIN enc USING (scene)) AS qa),
sp AS (SELECT us.*, prob, CASE WHEN usable THEN prob * (CASE WHEN offset_mag > 2.5 THEN 0.5 ELSE 1.0 END
         * CASE WHEN NOT view_ok AND sar_agreement IS NULL THEN 0.2 ELSE 1.0 END
         * CASE WHEN abs(seasonal_delta) < 0.05 THEN 0.8 ELSE 1.0 END
         * CASE WHEN sar_agreement IS NULL THEN 0.9 WHEN sar_agreement < 0.2 THEN 0.6 ELSE 1.0 END) ELSE 0.0 END AS p
       FROM us JOIN pr USING (scene, y, x)),
em AS (SELECT scene, avg(prob) AS raw_change_prob, avg(CASE WHEN usable THEN 1.0 ELSE 0.0 END) AS qa_coverage,
         coalesce(avg(CASE WHEN usable THEN p END), 0.0) AS mean_prob, any_value(sar_agreement) AS sar_agreement,
         any_value(seasonal_delta) AS seasonal_delta, any_value(reg_conf) AS registration_confidence,
         count_if(p > 0.55) AS n_masked FROM sp GROUP BY scene),
ev_conf AS (SELECT *, greatest(0.0, least(1.0, 0.40 * mean_prob + 0.20 * qa_coverage + 0.15 * coalesce(sar_agreement, 0.5)
         + 0.15 * greatest(0.0, 1.0 - abs(seasonal_delta)) + 0.10 * registration_confidence)) AS confidence FROM em)
"""


def suppressed(s, sf):
    return ce.suppress(event_pairs(s, sf), ["scene"])


def metrics(s, sf):
    return ce.event_metrics(suppressed(s, sf), ["scene"])


@check("qa_overlay", "scene:l y:l x:l usable:b", "SELECT * FROM sp", EVENT)
def _(s, sf):
    return suppressed(s, sf)


@check("sar_overlay", "scene:l sar_fused:b", "SELECT DISTINCT scene, scene % 3 <> 0 AS sar_fused FROM pair_px", v.PAIR_PX)
def _(s, sf):
    return metrics(s, sf)


@check("sar_agreement", "scene:l sar_agreement:6", "SELECT * FROM em", EVENT)
def _(s, sf):
    return event_pairs(s, sf).withColumn("sar_agreement", ce.sar_agreement(F.col("sar1"), F.col("sar2")))


@check("suppress_pipeline", "scene:l y:l x:l p:6 mask:b", "SELECT *, p > 0.55 AS mask FROM sp", EVENT)
def _(s, sf):
    return suppressed(s, sf)


@check("confidence_blend", "scene:l raw_change_prob:6 qa_coverage:6 mean_prob:6 sar_agreement:6 confidence:6",
       "SELECT * FROM ev_conf", EVENT)
def _(s, sf):
    return metrics(s, sf)


def _scores(s, sf):
    e = table_scores(s, sf)
    return metrics(s, sf).join(e, "scene", "left")


def table_scores(s, sf):
    """Class scores of a scene: its first two vectors, folded into five sums each; every seventh scene has none."""
    e = v.table(s, sf, "embeddings")
    folded = F.array(*[F.expr(f"aggregate(filter(embedding, (x, i) -> i % 5 = {k}), 0D, (a, x) -> a + cast(x AS double))")
                       for k in range(5)])
    pick = lambda i: F.max(F.when(F.col("vec_id") % 6 == i, folded))
    return (e.where(F.expr("vec_id div 6") % 7 != 3).groupBy(F.expr("vec_id div 6").alias("scene"))
            .agg(pick(0).alias("morph_scores"), pick(1).alias("type_scores")))


def _arg(i: int, names) -> str:
    vocab = "[" + ", ".join(f"'{n}'" for n in names) + "]"
    return f"{vocab}[list_position(s{i}, list_max(s{i}))]"


SEM = EVENT + f""",
sc AS (SELECT vec_id // 6 AS scene, max(CASE WHEN vec_id % 6 = 0 THEN folded END) AS s0,
              max(CASE WHEN vec_id % 6 = 1 THEN folded END) AS s1 FROM (
         SELECT vec_id, [list_sum([CAST(embedding[i] AS DOUBLE) FOR i IN range(k + 1, len(embedding) + 1, 5)]) FOR k IN range(0, 5)] AS folded
         FROM embeddings) WHERE (vec_id // 6) % 7 <> 3 GROUP BY 1),
sem AS (SELECT em.scene, n_masked,
  CASE WHEN n_masked = 0 THEN 'unknown' WHEN s1 IS NULL THEN 'construction' ELSE {_arg(1, ['construction', 'clearance', 'water_extent', 'road', 'unknown'])} END AS change_type,
  CASE WHEN n_masked = 0 THEN 'none' WHEN s0 IS NULL THEN 'appearance' ELSE {_arg(0, ['appearance', 'disappearance', 'expansion', 'contraction', 'none'])} END AS change_morphology
  FROM em LEFT JOIN sc USING (scene))"""


def classified(s, sf):
    kind, morph = ce.semantics_from_scores(F.col("n_masked"), F.col("morph_scores"), F.col("type_scores"))
    return _scores(s, sf).withColumn("change_type", kind).withColumn("change_morphology", morph)


@check("semantics_from_scores", "scene:l change_type:s change_morphology:s", "SELECT * FROM sem", SEM)
def _(s, sf):
    return classified(s, sf)


# The whole detection in one call, unregistered; every fifth scene is seen from too different an angle.
PLAIN_META = "0.0 AS offset_mag, scene % 5 <> 4 AS view_ok, 0.02 AS seasonal_delta, 1.0 AS reg_conf"


@check("change_event", "scene:l n_masked:l change_type:s change_morphology:s confidence:6 qa_coverage:6 stages:s", """
SELECT *, CASE WHEN sar_agreement IS NULL THEN 'qa,registration,seasonal,confidence' ELSE 'qa,registration,seasonal,sar,confidence' END AS stages
FROM ev_conf JOIN (SELECT scene, change_type, change_morphology FROM sem) USING (scene)""", SEM.replace(META, PLAIN_META))
def _(s, sf):
    rows = event_pairs(s, sf).select("scene", "width", *[f"{b}{n}" for n in (1, 2) for b in "rgb"], "qa1", "qa2", "sar1", "sar2",
                                     ((F.col("scene") % 5) * 5.0).alias("view1"), F.lit(2.0).alias("incidence2"))
    _, events = ce.detect_change(rows.join(table_scores(s, sf), "scene", "left"), ["scene"], register=False)
    return events.withColumn("stages", F.array_join("stages", ","))


@check("change_event_registered", "scene:l dy:2 dx:2 registration_confidence:4 n_masked:l confidence:4")
def _(s, sf):
    _, events = ce.detect_change(event_pairs(s, sf).drop("offset_mag", "view_ok", "seasonal_delta", "reg_conf"), ["scene"])
    return events.withColumns({"dy": F.col("offset_dy"), "dx": F.col("offset_dx")})


def assembled(s, sf):
    sid = F.col("scene").cast("string")
    lon, lat = F.lit(77.0) + F.col("scene") / 10.0, F.lit(12.0) + F.col("scene") / 10.0
    return ce.assemble(classified(s, sf).withColumns({
        "event_id": F.concat(F.lit("ce_"), sid), "t1_scene_id": F.concat(F.lit("s"), sid, F.lit("_0")),
        "t2_scene_id": F.concat(F.lit("s"), sid, F.lit("_1")), "t1_datetime": F.lit("2023-01-01T00:00:00Z"),
        "t2_datetime": F.lit("2024-01-01T00:00:00Z"), "bbox": F.array(lon, lat, lon + 0.1, lat + 0.1),
        "mask_href": F.concat(F.lit("masks/tile_id=s"), sid), "offset_dx": F.lit(0.0), "offset_dy": F.lit(0.0),
        "latency_ms": F.lit(0)}))


@check("change_event_assemble", "event_id:s stac_id:s start:s finish:s kind:s morph:s west:6 north:6 corners:l sar_fused:b n_stages:l conf:6", """
SELECT 'ce_' || e.scene AS event_id, 'ce_' || e.scene AS stac_id, '2023-01-01T00:00:00Z' AS start, '2024-01-01T00:00:00Z' AS finish,
       change_type AS kind, change_morphology AS morph, 77.0 + e.scene / 10.0 AS west, 12.0 + e.scene / 10.0 + 0.1 AS north, 5 AS corners,
       sar_agreement IS NOT NULL AS sar_fused, CASE WHEN sar_agreement IS NULL THEN 4 ELSE 5 END AS n_stages, confidence AS conf
FROM ev_conf e JOIN sem ON e.scene = sem.scene""", SEM)
def _(s, sf):
    a, f, p = assembled(s, sf), F.col("stac_change_event"), F.col("provenance")
    return a.select(
        "event_id", f["id"].alias("stac_id"), f["properties"]["start_datetime"].alias("start"),
        f["properties"]["end_datetime"].alias("finish"), f["properties"]["change:type"].alias("kind"),
        f["properties"]["change:morphology"].alias("morph"), f["bbox"][0].alias("west"), f["bbox"][3].alias("north"),
        F.size(f["geometry"]["coordinates"][0]).alias("corners"), p["sar_fused"].alias("sar_fused"),
        F.size(p["suppression_stages_fired"]).alias("n_stages"), F.get_json_object(F.to_json(f), "$.properties.change:confidence")
        .cast("double").alias("conf"))


@check("change_event_export", "event_id:s artifact:s n_chars:l")
def _(s, sf):
    path = f"{ensure_checkpoint_dir(s)}/events-{uuid4().hex}"
    records.export_events(assembled(s, sf), path)
    stored = records.read_events(s, path)
    return stored.withColumn("n_chars", F.length("value"))


# ---- time -------------------------------------------------------------------

PAIRS_SQL = v.ACQUISITION + """,
nx AS (SELECT site, ts AS t1_date, lead(ts) OVER w AS t2_date, lead(confidence) OVER w AS confidence, lead(qa_coverage) OVER w AS qa_coverage
       FROM acquisition WINDOW w AS (PARTITION BY site ORDER BY ts, event_id)),
pr AS (SELECT *, confidence >= 0.70 AND qa_coverage >= 0.75 AS is_valid_change FROM nx WHERE t2_date IS NOT NULL)"""


def _acq_pairs(s, sf):
    return timeline.scene_pairs(v.acquisitions(s, sf), "site", "ts", ["confidence", "qa_coverage"], tie=["event_id"])


@check("scene_pairs", "site:l t1:t t2:t", "SELECT site, t1_date AS t1, t2_date AS t2 FROM pr", PAIRS_SQL)
def _(s, sf):
    return _acq_pairs(s, sf).select("site", F.col("ts").alias("t1"), F.col("next.ts").alias("t2"))


@check("per_date_confidence", "site:l t1_date:t t2_date:t confidence:6 qa_coverage:6 is_valid_change:b", "SELECT * FROM pr", PAIRS_SQL)
def _(s, sf):
    return timeline.date_confidence(_acq_pairs(s, sf), "site", "ts")


@check("earliest_supported_date", "site:l earliest_supported_date:t n_pairs:l", """
SELECT a.site, min(CASE WHEN is_valid_change THEN t2_date END) AS earliest_supported_date, count(t2_date) AS n_pairs
FROM (SELECT DISTINCT site FROM acquisition) a LEFT JOIN pr ON a.site = pr.site GROUP BY a.site""", PAIRS_SQL)
def _(s, sf):
    evidence = timeline.date_confidence(_acq_pairs(s, sf), "site", "ts")
    return timeline.earliest_supported(v.acquisitions(s, sf), evidence, "site")


# Stacks of pictures: consecutive ones are compared, with the default limits of support.
STACK = (EVENT.replace(v.PAIR_PX, v.STACK_PX).replace(META, PLAIN_META.replace("scene % 5 <> 4", "true"))
         .replace("b2 * 0.4 AS s2", "g2 * 0.4 AS s2").replace("scene % 3 <> 0", "scene % 3 <> 0 AND (scene + 8) % 3 <> 0"))


@check("change_stack", "site:l earliest:t n_pairs:l", """
SELECT n.site, min(CASE WHEN confidence >= 0.70 AND qa_coverage >= 0.75 THEN TIMESTAMP '2024-01-01' + to_days(CAST(e.scene + 8 AS INTEGER)) END) AS earliest,
       count(e.scene) AS n_pairs
FROM (SELECT DISTINCT scene % 8 AS site FROM pic) n LEFT JOIN ev_conf e ON e.scene % 8 = n.site GROUP BY n.site""", STACK)
def _(s, sf):
    return _stack(s, sf)[1].withColumnRenamed("earliest_supported_date", "earliest")


@check("change_stack_blocks", "site:l t1:t t2:t confidence:6 qa_coverage:6", """
SELECT scene % 8 AS site, TIMESTAMP '2024-01-01' + to_days(CAST(scene AS INTEGER)) AS t1, TIMESTAMP '2024-01-01' + to_days(CAST(scene + 8 AS INTEGER)) AS t2,
       confidence, qa_coverage FROM ev_conf""", STACK)
def _(s, sf):
    cut = lambda rows: v.blocks_of_pictures(rows, ["r", "g", "b", "qa", "sar"])
    return _stack(s, sf, cut)[0].withColumnsRenamed({"t1_date": "t1", "t2_date": "t2"})


def _stack(s, sf, cut=lambda rows: rows):
    rows = v.picture_stack(s, sf)
    parity = F.col("picture") % 2 == 1
    bits = lambda x: F.when(F.floor(x * 997.0) % 8 == 0, 3).when(F.floor(x * 997.0) % 8 == 1, 33).otherwise(1)
    rows = rows.withColumn("qa", F.transform("r", lambda x: F.when(parity, (F.floor(x * 997.0) % 12).cast("int")).otherwise(bits(x))))
    rows = rows.withColumn("sar", F.when(F.col("picture") % 3 != 0, F.transform("g", lambda x: x * 0.4)))
    return ce.detect_change_over_stack(cut(rows), "site", "ts", register=False)


@check("change_stack_evidence", "site:l t1:t t2:t confidence:6 qa_coverage:6", """
SELECT scene % 8 AS site, TIMESTAMP '2024-01-01' + to_days(CAST(scene AS INTEGER)) AS t1, TIMESTAMP '2024-01-01' + to_days(CAST(scene + 8 AS INTEGER)) AS t2,
       confidence, qa_coverage FROM ev_conf""", STACK)
def _(s, sf):
    return _stack(s, sf)[0].withColumnsRenamed({"t1_date": "t1", "t2_date": "t2"})


@check("seasonal_zscore", "site:l event_id:l z:6 is_anomaly:b", """
SELECT site, event_id, CASE WHEN sd > 1e-9 THEN (value - m) / sd ELSE 0.0 END AS z,
       abs(CASE WHEN sd > 1e-9 THEN (value - m) / sd ELSE 0.0 END) > 2.0 AS is_anomaly
FROM acquisition JOIN (SELECT site, month(ts) AS mo, avg(value) AS m, stddev_pop(value) AS sd FROM acquisition GROUP BY ALL) b
USING (site) WHERE month(ts) = mo""", v.ACQUISITION)
def _(s, sf):
    return timeline.seasonal_zscore(v.acquisitions(s, sf), "site", "ts", "value")


@check("month_of", "event_id:l months:l", """
SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 0 ELSE abs(month(ts) - CAST(k % 12 + 1 AS INTEGER)) END AS months FROM acquisition""", v.ACQUISITION)
def _(s, sf):
    from scenelake.functions.spectral import month_distance
    other = F.concat(F.lit("2025-"), F.lpad((F.col("k") % 12 + 1).cast("string"), 2, "0"), F.lit("-01"))
    other = F.when(F.col("event_id") % 9 == 0, F.lit("undated")).otherwise(other)
    return v.acquisitions(s, sf).withColumn("months", month_distance(F.date_format("ts", "yyyy-MM-dd"), other))


@check("view_angle_check", "event_id:l ok:b delta:6", """
SELECT event_id, coalesce(abs(a - b), 0.0) <= 15 AS ok, coalesce(abs(a - b), 0.0) AS delta FROM (
  SELECT event_id, coalesce(nullif(CAST(k % 40 AS DOUBLE), 0.0), CASE WHEN site % 5 = 0 THEN NULL ELSE site % 30 + 0.5 END) AS a,
         CASE WHEN site % 6 = 0 THEN nullif(value, 0.0) ELSE coalesce(nullif(CAST(site % 3 AS DOUBLE) * 10, 0.0), 12.5) END AS b FROM acquisition)""", v.ACQUISITION)
def _(s, sf):
    k, site = F.col("k"), F.col("site")
    ok, delta = ce.view_angle((k % 40).cast("double"), F.when(site % 5 != 0, site % 30 + 0.5),
                              F.when(site % 6 == 0, F.col("value")).otherwise((site % 3).cast("double") * 10),
                              F.when(site % 6 != 0, F.lit(12.5)))
    return v.acquisitions(s, sf).withColumn("ok", ok).withColumn("delta", delta)


# ---- neighbourhood ------------------------------------------------------------

SCENES = v.ACQUISITION + """,
sc AS (SELECT event_id AS scene_id, CAST(200 + k * 7 AS BIGINT) AS height, CAST(100 + site * 3 AS BIGINT) AS width, 70.0 + site / 10.0 AS w0, 10.0 + k / 10.0 AS s0,
              70.0 + site / 10.0 + 0.5 AS e0, 10.0 + k / 10.0 + 0.25 AS n0 FROM acquisition),
rr AS (SELECT *, unnest(generate_series(0, CAST(ceil(height / 256.0) AS BIGINT) - 1)) AS row FROM sc),
gr AS (SELECT *, unnest(generate_series(0, CAST(ceil(width / 256.0) AS BIGINT) - 1)) AS col FROM rr),
gd AS (SELECT *, col * 256 AS tile_x, row * 256 AS tile_y, least(col * 256 + 256, width) AS x_end, least(row * 256 + 256, height) AS y_end FROM gr)"""


def scene_table(s, sf):
    a = v.acquisitions(s, sf)
    lon, lat = F.lit(70.0) + F.col("site") / 10.0, F.lit(10.0) + F.col("k") / 10.0
    return a.select(F.col("event_id").alias("scene_id"), (F.col("k") * 7 + 200).cast("bigint").alias("height"),
                    (F.col("site") * 3 + 100).alias("width"), F.array(lon, lat, lon + 0.5, lat + 0.25).alias("bbox"))


@check("tile_grid", "scene_id:l row:l col:l tile_x:l tile_y:l x_end:l y_end:l tile_id:s",
       "SELECT *, scene_id || '_x' || tile_x || '_y' || tile_y AS tile_id FROM gd", SCENES)
def _(s, sf):
    return nb.tile_grid(scene_table(s, sf), filter_edges=False)


@check("tile_edge_drop", "tile_id:s", """
SELECT scene_id || '_x' || tile_x || '_y' || tile_y AS tile_id FROM gd WHERE x_end - tile_x >= 128 AND y_end - tile_y >= 128""", SCENES)
def _(s, sf):
    return nb.tile_grid(scene_table(s, sf))


BBOX_SQL = """
SELECT scene_id || '_x' || tile_x || '_y' || tile_y AS tile_id, *, (min_lat + max_lat) / 2.0 AS center_lat, (min_lon + max_lon) / 2.0 AS center_lon
FROM (SELECT *, w0 + (tile_x / width) * (e0 - w0) AS min_lon, w0 + (x_end / width) * (e0 - w0) AS max_lon,
             n0 - (tile_y / height) * (n0 - s0) AS max_lat, n0 - (y_end / height) * (n0 - s0) AS min_lat FROM gd)"""


@check("tile_bbox", "tile_id:s min_lon:6 max_lon:6 min_lat:6 max_lat:6 center_lat:6 center_lon:6", BBOX_SQL, SCENES)
def _(s, sf):
    return nb.tile_bbox(nb.tile_grid(scene_table(s, sf), filter_edges=False))


@check("tile_csv_export", "tile_id:s source_image:s tile_x:l tile_y:l width:l height:l min_lon:6 min_lat:6 max_lon:6 max_lat:6 cloud_percentage:2",
       f"SELECT tile_id, scene_id AS source_image, tile_x, tile_y, 256 AS width, 256 AS height, min_lon, min_lat, max_lon, max_lat, (scene_id % 997) / 9.97 AS cloud_percentage FROM ({BBOX_SQL})", SCENES)
def _(s, sf):
    t = nb.tile_bbox(nb.tile_grid(scene_table(s, sf), filter_edges=False))
    return records.tile_csv_rows(t.withColumn("tile_width", F.lit(256)).withColumn("tile_height", F.lit(256))
                                 .withColumn("cloud_percentage", (F.col("scene_id") % 997) / 9.97))


@check("ids", "scene_id:l tile:s region:s", """
SELECT scene_id, 'S' || scene_id || '_x' || width || '_y' || height AS tile, 'a' || scene_id || '_reg_' || CASE WHEN scene_id % 1500 < 10 THEN '0' ELSE '' END || (scene_id % 1500) AS region FROM sc""", SCENES)
def _(s, sf):
    from scenelake.functions.text import region_id, tile_id
    sid = F.col("scene_id").cast("string")
    return scene_table(s, sf).withColumn("tile", tile_id(F.concat(F.lit("S"), sid), F.col("width"), F.col("height"))).withColumn(
        "region", region_id(F.concat(F.lit("a"), sid), F.col("scene_id") % 1500))


# An 8 x 8 scene is the crop of a 12 x 12 tile.
@check("tile_pad_reflect", "scene:l y:l x:l r1:6", """
SELECT scene, ty AS y, tx AS x, r1 FROM (SELECT unnest(generate_series(0, 11)) AS ty) a, (SELECT unnest(generate_series(0, 11)) AS tx) b, pair_px
WHERE y = CASE WHEN ty <= 7 THEN ty ELSE 14 - ty END AND x = CASE WHEN tx <= 7 THEN tx ELSE 14 - tx END""", v.PAIR_PX)
def _(s, sf):
    px = unroll(v.pairs(s, sf), ["scene"], ["r1"]).withColumn("h", F.lit(8)).withColumn("w", F.lit(8))
    return nb.tile_pad_reflect(px, ["scene"], "h", "w", 12, ["r1"])


@check("resample_gsd", "scene:l y:l x:l r1:6", """
SELECT scene, ty AS y, tx AS x, r1 FROM (SELECT unnest(generate_series(0, 23)) AS ty) a, (SELECT unnest(generate_series(0, 23)) AS tx) b, pair_px
WHERE y = CASE WHEN ty = 23 THEN 7 ELSE CAST(floor(ty * (7 / 23.0::DOUBLE)) AS BIGINT) END AND x = CASE WHEN tx = 23 THEN 7 ELSE CAST(floor(tx * (7 / 23.0::DOUBLE)) AS BIGINT) END""", v.PAIR_PX)
def _(s, sf):
    px = unroll(v.pairs(s, sf), ["scene"], ["r1"]).withColumn("h", F.lit(8)).withColumn("w", F.lit(8))
    return radiometry.block_resample_nearest(px, ["scene"], "h", "w", "r1", 30.0, 10.0)


@check("resample_area", "scene:l y:l x:l r1:6", "SELECT scene, y // 2 AS y, x // 2 AS x, avg(r1) AS r1 FROM pair_px GROUP BY ALL", v.PAIR_PX)
def _(s, sf):
    return radiometry.block_resample_area(unroll(v.pairs(s, sf), ["scene"], ["r1"]), ["scene"], "r1", 2)


# Features: bright pixels of either date; thresholds differ by scene so that all rules occur.
MORPH = v.PAIR_PX + """,
ft AS (SELECT scene, y, x, CASE scene % 5 WHEN 0 THEN y < 2 AND x < 2 WHEN 1 THEN y < 4 ELSE r1 > 0.5 + (scene % 5) * 0.05 END AS a,
       CASE scene % 5 WHEN 0 THEN (y < 2 AND x < 2) OR (y > 5 AND x > 4) WHEN 1 THEN y < 3 WHEN 2 THEN r1 > 0.6 OR (r2 > 0.7 AND y > 3) WHEN 3 THEN r1 > 0.65 AND r1 < 0.8 ELSE r2 > 0.7 END AS b FROM pair_px)"""


def feature_pixels(s, sf):
    px = unroll(v.pairs(s, sf), ["scene"], ["r1", "r2"])
    m, y, x, r1, r2 = F.col("scene") % 5, F.col("y"), F.col("x"), F.col("r1"), F.col("r2")
    a = F.when(m == 0, (y < 2) & (x < 2)).when(m == 1, y < 4).otherwise(r1 > F.lit(0.5) + m * 0.05)
    b = (F.when(m == 0, ((y < 2) & (x < 2)) | ((y > 5) & (x > 4))).when(m == 1, y < 3)
         .when(m == 2, (r1 > 0.6) | ((r2 > 0.7) & (y > 3))).when(m == 3, (r1 > 0.65) & (r1 < 0.8)).otherwise(r2 > 0.7))
    return px.withColumn("a", a).withColumn("b", b).withColumn("changed", F.col("a") != F.col("b"))


@check("morphology_rule", "scene:l morphology:s", """
SELECT scene, CASE WHEN NOT any_change THEN 'none' WHEN has_gain AND has_loss THEN 'expansion'
  WHEN has_gain THEN CASE WHEN tg THEN 'expansion' ELSE 'appearance' END
  WHEN has_loss THEN CASE WHEN tl THEN 'contraction' ELSE 'disappearance' END ELSE 'appearance' END AS morphology
FROM (SELECT p.scene, bool_or(p.a <> p.b) AS any_change, bool_or(NOT p.a AND p.b) AS has_gain, bool_or(p.a AND NOT p.b) AS has_loss,
        bool_or(NOT p.a AND p.b AND coalesce(q.a, false)) AS tg, bool_or(p.a AND NOT p.b AND coalesce(q.b, false)) AS tl
      FROM ft p LEFT JOIN ft q ON p.scene = q.scene AND abs(p.y - q.y) + abs(p.x - q.x) = 1 GROUP BY p.scene)""", MORPH)
def _(s, sf):
    return nb.morphology_rule(feature_pixels(s, sf), ["scene"], "a", "b", "changed")


SHIFT = """
sj AS (SELECT p.scene, dy, dx, p.y, p.x, p.r1 AS u, q.r2 AS w FROM (SELECT *, unnest(generate_series(-5, 5)) AS dx FROM
   (SELECT *, unnest(generate_series(-5, 5)) AS dy FROM pair_px)) q JOIN pair_px p ON p.scene = q.scene AND p.y = q.y + dy AND p.x = q.x + dx)"""


@check("shift_join", "scene:l y:l x:l dy:l dx:l r1:6 r2:6", "SELECT *, u AS r1, w AS r2 FROM sj", v.PAIR_PX + "," + SHIFT)
def _(s, sf):
    return reg.shift_join(unroll(v.pairs(s, sf), ["scene"], ["r1", "r2"]), ["scene"], "r1", "r2")


@check("coregister_ncc", "scene:l dy:l dx:l score:6", """
SELECT scene, dy, dx, score FROM (SELECT *, row_number() OVER (PARTITION BY scene ORDER BY score DESC, abs(dy) + abs(dx), dy, dx) AS rn FROM (
  SELECT scene, dy, dx, CASE WHEN sqrt(var_pop(u) * var_pop(w)) * count(*) > 1e-12 THEN round(covar_pop(u, w) / sqrt(var_pop(u) * var_pop(w)), 9) ELSE 0.0 END AS score
  FROM sj GROUP BY scene, dy, dx)) WHERE rn = 1""", v.PAIR_PX + "," + SHIFT)
def _(s, sf):
    out = reg.coregister_ncc(v.pairs(s, sf), "r1", "r2")
    return out.select("scene", "shift.dy", "shift.dx", "shift.score")


# Phase correlation written as explicit discrete Fourier sums.
@check("coregister", "scene:l dy:l dx:l moved:b", """
SELECT scene, CASE WHEN py < 4 THEN py ELSE py - 8 END AS dy, CASE WHEN px < 4 THEN px ELSE px - 8 END AS dx,
       (py <> 0 OR px <> 0) AND abs(CASE WHEN py < 4 THEN py ELSE py - 8 END) < 6 AS moved
FROM (SELECT *, row_number() OVER (PARTITION BY scene ORDER BY val DESC, py, px) AS rn FROM (
  SELECT scene, i.y AS py, i.x AS px, round(sum(re * cos(2 * pi() * (u * i.y + w * i.x) / 8.0) - im * sin(2 * pi() * (u * i.y + w * i.x) / 8.0)) / 64.0, 10) AS val
  FROM cp, grid i GROUP BY ALL)) WHERE rn = 1""", v.PAIR_PX + """,
grid AS (SELECT a AS y, b AS x FROM (SELECT unnest(generate_series(0, 7)) AS a) p, (SELECT unnest(generate_series(0, 7)) AS b) q),
lum AS (SELECT scene, y, x, (r1 + g1 + b1) / 3.0 AS l1, (r2 + g2 + b2) / 3.0 AS l2 FROM pair_px),
ft AS (SELECT scene, g.y AS u, g.x AS w, sum(l1 * cos(2 * pi() * (g.y * l.y + g.x * l.x) / 8.0)) AS a1, -sum(l1 * sin(2 * pi() * (g.y * l.y + g.x * l.x) / 8.0)) AS c1,
         sum(l2 * cos(2 * pi() * (g.y * l.y + g.x * l.x) / 8.0)) AS a2, -sum(l2 * sin(2 * pi() * (g.y * l.y + g.x * l.x) / 8.0)) AS c2
       FROM lum l, grid g GROUP BY ALL),
cp AS (SELECT scene, u, w, (a1 * a2 + c1 * c2) / (sqrt((a1 * a2 + c1 * c2) ** 2 + (c1 * a2 - a1 * c2) ** 2) + 1e-8) AS re,
         (c1 * a2 - a1 * c2) / (sqrt((a1 * a2 + c1 * c2) ** 2 + (c1 * a2 - a1 * c2) ** 2) + 1e-8) AS im FROM ft)""")
def _(s, sf):
    out = reg.coregister(v.pairs(s, sf), rgb.BANDS)
    return out.select("scene", "shift.dy", "shift.dx", F.col("is_moved").alias("moved"))


@check("coregister_sub", "scene:l dy:4 dx:4 confidence:4 moved:b mean_warped:4")
def _(s, sf):
    out = reg.coregister_sub(v.pairs(s, sf), ["r"])
    mean = F.aggregate("r2a", F.lit(0.0), lambda a, x: a + x) / F.size("r2a")
    return out.select("scene", "shift.dy", "shift.dx", "shift.confidence", F.col("is_moved").alias("moved"), mean.alias("mean_warped"))


# A scene is cut into four 4 x 4 blocks; its regions must not notice.
def region_blocks(s, sf):
    px = nb.assign_tiles(_changes(s, sf), ["scene"], 4)
    b = roll_up(px, ["scene", "row", "col"], ["changed"])
    return b.select(F.col("scene").alias("scene_id"), F.col("row").alias("block_row"), F.col("col").alias("block_col"),
                    F.lit(4).alias("block_size"), "width", F.col("changed").alias("mask"))


@check("change_regions", "scene_id:l n_pixels:l min_y:l max_y:l min_x:l max_x:l center_y:6 center_x:6 area_ha:6", """
SELECT scene AS scene_id, count(*) AS n_pixels, min(y) AS min_y, max(y) AS max_y, min(x) AS min_x, max(x) AS max_x,
       avg(y) AS center_y, avg(x) AS center_x, count(*) * 0.01 AS area_ha FROM lab GROUP BY scene, root""",
       "RECURSIVE " + CHANGE_PX + """,
cp AS (SELECT scene, y, x FROM ev WHERE changed),
reach AS (SELECT scene, y, x, y AS sy, x AS sx FROM cp
          UNION SELECT c.scene, c.y, c.x, r.sy, r.sx FROM reach r JOIN cp c ON c.scene = r.scene AND abs(c.y - r.y) + abs(c.x - r.x) = 1),
lab AS (SELECT scene, y, x, min(sy * 8 + sx) AS root FROM reach GROUP BY scene, y, x)""")
def _(s, sf):
    return nb.change_regions(region_blocks(s, sf))


# ---- files and labels -----------------------------------------------------------


@check("raster_scan", "vec_id:l y:l x:l v:6", """
SELECT vec_id, pos // 8 AS y, pos % 8 AS x, CAST(e AS DOUBLE) AS v FROM (SELECT vec_id, unnest(embedding) AS e, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings)""")
def _(s, sf):
    # Files of up to 64 pictures as bands, named by their first one; read back in windows of 4 x 4.
    path = f"{ensure_checkpoint_dir(s)}/rasters-{uuid4().hex}"
    e = v.table(s, sf, "embeddings").groupBy(F.expr("vec_id div 64").alias("file")).agg(
        F.array_sort(F.collect_list(F.struct("vec_id", F.col("embedding").cast("array<double>").alias("e")))).alias("b"))
    listed = F.array_join(F.transform("b", lambda b: b["vec_id"].cast("string")), "-")
    images = e.select(listed.alias("name"), F.size("b").alias("bands"), F.lit(8).alias("height"), F.lit(8).alias("width"),
                      F.flatten(F.transform("b", lambda b: b["e"])).alias("values"))
    names = images.select(F.sha2("name", 256).alias("file"), F.split("name", "-").alias("ids"))
    rasters.write_images(images.withColumn("name", F.sha2("name", 256)), path)
    blocks = rasters.scan(s, path, block=4, task_bytes=1 << 14)
    px = unroll(blocks, ["path", "band", "block_row", "block_col"], ["values"])
    px = px.withColumn("file", F.regexp_extract("path", "([^/]+)[.]npy$", 1)).join(names, "file")
    return px.select(F.get("ids", F.col("band")).cast("bigint").alias("vec_id"), (F.col("block_row") * 4 + F.col("y")).alias("y"),
                     (F.col("block_col") * 4 + F.col("x")).alias("x"), F.col("values").alias("v"))


BRIGHTEST = "greatest(r1, g1, b1, r2, g2, b2)"


@check("pair_labels", "scene:l n_changed:l change_type:s change_morphology:s", f"""
SELECT scene, count_if({BRIGHTEST} > 0.85) AS n_changed, CASE WHEN bool_or({BRIGHTEST} > 0.85) THEN 'construction' ELSE 'unknown' END AS change_type,
       CASE WHEN bool_or({BRIGHTEST} > 0.85) THEN 'appearance' ELSE 'none' END AS change_morphology FROM pair_px GROUP BY scene""", v.PAIR_PX)
def _(s, sf):
    bands = [f"{b}{e}" for b in "rgb" for e in (1, 2)]
    px = unroll(v.pairs(s, sf), ["scene"], bands).withColumn("label", F.when(F.greatest(*bands) > 0.85, 255).otherwise(0))
    px = px.withColumn("mask", pair_source.change_mask("levir", F.col("label")))
    return pair_source.sample_labels(px, "scene", "levir")


# Sample listing: every document is an image pair, two thirds have a label file.
@check("pair_dataset_scan", "split:s sample:s t1:s t2:s mask:s", """
SELECT CASE WHEN doc_id % 5 = 0 THEN 'val' ELSE 'train' END AS split, doc_id || '.png' AS sample, '/d/' || split || '/A/' || sample AS t1,
       '/d/' || split || '/B/' || sample AS t2, CASE WHEN doc_id % 3 > 0 THEN '/d/' || split || '/label/' || sample END AS mask
FROM documents WHERE doc_id % 13 <> 0""")
def _(s, sf):
    d = v.table(s, sf, "documents").select("doc_id")
    folder = F.explode(F.filter(F.array(F.lit("A"), F.when(F.col("doc_id") % 13 != 0, F.lit("B")),
                                        F.when(F.col("doc_id") % 3 > 0, F.lit("label"))), lambda f: f.isNotNull()))
    files = d.select("doc_id", folder.alias("f")).select(F.concat(
        F.lit("/d/"), F.when(F.col("doc_id") % 5 == 0, "val").otherwise("train"), F.lit("/"), "f", F.lit("/"),
        F.col("doc_id").cast("string"), F.lit(".png")).alias("path"))
    return pair_source.index_pairs(files, "levir")


@check("checksum_manifest", "file:s state:s size:l", """
SELECT s_suppkey || '.npy' AS file, CASE WHEN s_suppkey % 5 = 0 THEN 'added' WHEN s_suppkey % 11 = 3 THEN 'missing'
       WHEN s_suppkey % 7 = 1 THEN 'changed' ELSE 'same' END AS state,
       CASE WHEN s_suppkey % 11 = 3 AND s_suppkey % 5 <> 0 THEN NULL ELSE 128 + 8 * 4 END AS size FROM supplier
WHERE NOT (s_suppkey % 5 = 0 AND s_suppkey % 11 = 3)""")
def _(s, sf):
    # A file per supplier in two states of a folder; the manifest is stored in the first.
    from scenelake.sources import manifest
    base = f"{ensure_checkpoint_dir(s)}/manifest-{uuid4().hex}"
    key = F.col("s_suppkey")
    rows = v.table(s, sf, "supplier").select(
        key, key.cast("string").alias("name"), F.lit(1).alias("bands"), F.lit(2).alias("height"), F.lit(2).alias("width"))
    four = lambda x: F.array(*[x.cast("double")] * 4).alias("values")
    rasters.write_images(rows.where(key % 5 != 0).select("*", four(key)), f"{base}/before")
    rasters.write_images(rows.where(key % 11 != 3).select("*", four(F.when(key % 7 == 1, -key).otherwise(key))), f"{base}/after")
    manifest.append_manifest(manifest.checksums(s, f"{base}/before", ".npy"), f"{base}/sums")
    now = manifest.checksums(s, f"{base}/after", ".npy")
    states = manifest.verify(manifest.read_manifest(s, f"{base}/sums"), now)
    return states.join(now.select("path", "size"), "path", "left").withColumnRenamed("path", "file")


@check("fit_change_threshold", "tp:l fp:l fn:l tn:l precision:4 recall:4 f1:4")
def _(s, sf):
    # Labels come from the other pipeline: what the RGB report calls changed.
    truth = _changes(s, sf).select("scene", "y", "x", F.col("changed").alias("truth"))
    px = suppressed(s, sf).select("scene", "y", "x", "prob").join(truth, ["scene", "y", "x"])
    _, scored_px = evaluation.fit_change_threshold(px, "prob", "truth")
    return evaluation.seg_metrics(scored_px, F.col("pred"), F.col("truth"))
