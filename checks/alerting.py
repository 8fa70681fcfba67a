"""Alerts, feedback, clusters, labels and presentation rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import views as v
from checks.registry import check, half_even
from scenelake.functions import labels, mathx
from scenelake.operators import clusters, evaluation as ev, feedback as fb
from scenelake.plans import rgb_report as rgb
from scenelake.sources import records

# ---- presentation rules -----------------------------------------------------------


@check("confidence_tier", "event_id:l tier:s", """
SELECT event_id, CASE WHEN p < 70 THEN 'LOW' WHEN p < 85 THEN 'MEDIUM' ELSE 'HIGH' END AS tier FROM (
  SELECT event_id, CASE WHEN value > 1 THEN floor(value + 0.5) ELSE floor(value * 100.0 + 0.5) END AS p FROM events)""")
def _(s, sf):
    return v.table(s, sf, "events").withColumn("tier", labels.confidence_tier(F.col("value")))


@check("ndvi_label", "event_id:l label:s wet:b", """
SELECT event_id, CASE WHEN d IS NULL THEN NULL WHEN d < -0.2 THEN 'Significant Loss' WHEN d < 0 THEN 'Slight Loss' ELSE 'Gain' END AS label, d > 0.3 AS wet
FROM (SELECT event_id, CASE WHEN event_id % 9 > 0 THEN (k - 50) / 100.0 END AS d FROM acquisition)""", v.ACQUISITION)
def _(s, sf):
    d = F.when(F.col("event_id") % 9 > 0, (F.col("k") - 50) / 100.0)
    return v.acquisitions(s, sf).withColumn("label", labels.ndvi_label(d)).withColumn("wet", labels.ndwi_highlighted(d))


@check("status_class", "event_id:l badge:s", """
SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'rejected' ELSE 'pending' END AS badge FROM events""")
def _(s, sf):
    st = v._choose(["Confirmed", "auto-rejected", "", "PENDING REVIEW"], F.col("event_id") % 5 % 4)
    st = F.when(F.col("event_id") % 5 < 4, st)
    return v.table(s, sf, "events").withColumn("badge", labels.status_class(st))


@check("fmt_area", "event_id:l area:s", "SELECT event_id, CAST(value AS VARCHAR) || ' hectares' AS area FROM events")
def _(s, sf):
    return v.table(s, sf, "events").withColumn("area", labels.format_hectares(F.col("value")))


@check("scalar_math", "event_id:l clipped:6 sig:6 hyp:6 ratio:6", """
SELECT event_id, greatest(-1.0, least(1.0, value / 50.0 - 1.0)) AS clipped, 1.0 / (1.0 + exp(-value / 10.0)) AS sig, sqrt(value * value + 9.0) AS hyp,
       CASE WHEN user_id % 5 = 0 THEN 0.0 ELSE value / (user_id % 5) END AS ratio FROM events""")
def _(s, sf):
    x = F.col("value")
    return v.table(s, sf, "events").select(
        "event_id", mathx.clip(x / 50.0 - 1.0, -1, 1).alias("clipped"), mathx.sigmoid(x / 10.0).alias("sig"),
        mathx.hypot(x, F.lit(3.0)).alias("hyp"), mathx.safe_ratio(x, F.col("user_id") % 5).alias("ratio"))


@check("l2norm", "vec_id:l norm:6", "SELECT vec_id, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) AS norm FROM embeddings")
def _(s, sf):
    return v.table(s, sf, "embeddings").withColumn("norm", mathx.l2_norm(F.col("embedding")))


# ---- alerts --------------------------------------------------------------------------


@check("alerts_by_status", "alert_id:s status:s", "SELECT * FROM alert WHERE status = 'CONFIRMED'", v.ALERT)
def _(s, sf):
    return fb.alerts_by_status(v.alerts(s, sf), "confirmed")


@check("alert_by_id", "alert_id:s type:s", "SELECT * FROM alert WHERE alert_id = (SELECT max(alert_id) FROM alert)", v.ALERT)
def _(s, sf):
    a = v.alerts(s, sf)
    return fb.alert_by_id(a, a.agg(F.max("alert_id").alias("m")).scalar())


@check("alerts_text_filter", "alert_id:s", """
SELECT alert_id FROM alert WHERE status = 'PENDING REVIEW' AND (contains(lower(alert_id), '1') OR contains(lower(type), '1') OR contains(lower(location_name), '1'))""", v.ALERT)
def _(s, sf):
    return fb.alerts_text_filter(v.alerts(s, sf), "PENDING", "1")


@check("sensor_class_filter", "alert_id:s optical:b sar:b", """
SELECT alert_id, contains(sensor, 'MSI') OR contains(sensor, 'Landsat') AS optical, contains(sensor, 'SAR') OR contains(sensor, 'Sentinel-1') AS sar FROM alert""", v.ALERT)
def _(s, sf):
    c = F.col("sensor")
    return v.alerts(s, sf).withColumn("optical", labels.sensor_matches(c, "OPTICAL")).withColumn("sar", labels.sensor_matches(c, "SAR"))


@check("alert_counts", "status:s n:l", "SELECT status, count(*) AS n FROM alert GROUP BY status", v.ALERT)
def _(s, sf):
    return fb.alert_counts(v.alerts(s, sf))


@check("alerts_json_load", "alert_id:s type:s status:s confidence:6 latitude:6 sensor:s affected_area:s", """
SELECT 'J' || event_id AS alert_id, 'Change Anomaly' AS type, CASE WHEN event_id % 2 = 0 THEN status ELSE 'PENDING REVIEW' END AS status,
       CASE WHEN event_id % 3 = 0 THEN 0.5 ELSE 0.90 END AS confidence, 13.34 AS latitude, 'Sentinel-2 MSI' AS sensor, '10 ha' AS affected_area FROM alert""", v.ALERT)
def _(s, sf):
    n = F.col("event_id").cast("string")
    js = F.concat(F.lit('{"id":"J'), n, F.lit('"'), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit(',"status":"'), "status", F.lit('"'))).otherwise(""),
                  F.when(F.col("event_id") % 3 == 0, F.lit(',"confidence":0.5')).otherwise(""), F.lit("}"))
    return records.alerts_from_json(v.alerts(s, sf).select(js.alias("json")))


FB = v.ALERT + "," + v.FEEDBACK + """,
ids AS (SELECT DISTINCT alert_id FROM feedback),
mt AS (SELECT f.alert_id, coalesce(a.alert_id, c.cid) AS matched_id FROM ids f LEFT JOIN alert a USING (alert_id)
       LEFT JOIN (SELECT i.alert_id AS fid, min(b.alert_id) AS cid FROM ids i JOIN alert b ON contains(b.alert_id, i.alert_id) GROUP BY i.alert_id) c ON c.fid = f.alert_id),
fm AS (SELECT f.*, matched_id FROM feedback f JOIN mt USING (alert_id)),
lt AS (SELECT *, count(*) OVER (PARTITION BY matched_id) AS n_decisions FROM fm WHERE matched_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY matched_id ORDER BY ts DESC, event_id DESC) = 1)"""


def _matched(s, sf):
    return fb.match_feedback(v.feedback(s, sf), v.alerts(s, sf))


@check("feedback_alert_match", "event_id:l alert_id:s matched_id:s", "SELECT * FROM fm", FB)
def _(s, sf):
    return _matched(s, sf)


def _latest(s, sf):
    return fb.latest_feedback(_matched(s, sf).where("matched_id is not null"), "matched_id", ["ts", "event_id"])


@check("feedback_latest", "matched_id:s action:s event_id:l n_decisions:l", "SELECT * FROM lt", FB)
def _(s, sf):
    return _latest(s, sf)


APPLIED = """
SELECT a.alert_id, type, latitude, longitude, confidence, detected_at, sensor, affected_area, location_name, analysis_id, summary,
  CASE WHEN action = 'CONFIRM' THEN 'CONFIRMED' WHEN action IS NOT NULL THEN 'REJECTED' ELSE status END AS status, action, reviewed_at AS seen_at FROM alert a LEFT JOIN lt ON lt.matched_id = a.alert_id"""


@check("feedback_apply", "alert_id:s status:s action:s", f"SELECT * FROM ({APPLIED})", FB)
def _(s, sf):
    return fb.apply_feedback(v.alerts(s, sf), _latest(s, sf)).withColumn("action", F.col("feedback_action"))


@check("alert_to_json", "alert_id:s json:s", f"""
SELECT alert_id, '{{"id":"' || alert_id || '","type":"' || type || '","latitude":' || latitude || ',"longitude":' || longitude || ',"confidence":' || floor(confidence * 100.0) / 100.0 || ',"detectedAt":"' || detected_at || '","status":"' || status
  || '","sensor":"' || sensor || '","affectedArea":"' || affected_area || '","locationName":"' || location_name || '","analysisId":"' || analysis_id || '","summary":"' || summary || '"'
  || coalesce(',"feedback":{{"action":"' || action || '","rationale":"Visual Inspection","analystNotes":"","reviewedAt":"' || seen_at || '"}}', '') || '}}' AS json FROM ({APPLIED})""", FB)
def _(s, sf):
    rows = fb.apply_feedback(v.alerts(s, sf), _latest(s, sf))
    return records.alert_to_json(rows.withColumn("confidence", F.floor(F.col("confidence") * 100.0) / 100.0))


# Decisions are stored per reviewing user; the count includes everything appended so far.
@check("feedback_append", "action:s n:l", "SELECT action, count(*) AS n FROM feedback GROUP BY action", v.FEEDBACK)
def _(s, sf):
    from uuid import uuid4
    from scenelake.session import ensure_checkpoint_dir
    rows = v.feedback(s, sf).select("alert_id", "action", "rationale", "reviewed_at")
    path = f"{ensure_checkpoint_dir(s)}/feedback-{uuid4().hex}"
    for action in ("CONFIRM", "REJECT"):
        records.append_feedback(rows.where(F.col("action") == action), path)
    return s.read.schema(rows.schema).json(path).groupBy("action").agg(F.count("*").alias("n"))


@check("retrain_trigger", "user_id:l n_labels:l is_triggered:b", "SELECT user_id, count(*) AS n_labels, count(*) >= 20 AS is_triggered FROM feedback GROUP BY user_id", v.FEEDBACK)
def _(s, sf):
    return fb.retrain_trigger(v.feedback(s, sf), "user_id")


# Requests name scenes by file; half of the requested files do not exist.
SCENE_FILES = "files AS (SELECT DISTINCT 'scene_' || (user_id % 90) || '.png' AS file_name FROM events)"


@check("scene_resolve", "event_id:l file_t1:s file_t2:s is_resolved:b", """
SELECT event_id, CASE WHEN a.file_name IS NOT NULL AND b.file_name IS NOT NULL THEN f1 ELSE 'base_t1.png' END AS file_t1,
       CASE WHEN a.file_name IS NOT NULL AND b.file_name IS NOT NULL THEN f2 ELSE 'base_t2.png' END AS file_t2, a.file_name IS NOT NULL AND b.file_name IS NOT NULL AS is_resolved
FROM (SELECT event_id, 'scene_' || (event_id % 120) || '.png' AS f1, 'scene_' || (event_id * 7 % 120) || '.png' AS f2 FROM events) r
LEFT JOIN files a ON a.file_name = f1 LEFT JOIN files b ON b.file_name = f2""", SCENE_FILES)
def _(s, sf):
    e = v.table(s, sf, "events")
    files = e.select(F.concat(F.lit("scene_"), (F.col("user_id") % 90).cast("string"), F.lit(".png")).alias("file_name"))
    n1, n2 = (F.concat(F.lit("scene_"), x.cast("string")) for x in (F.col("event_id") % 120, F.col("event_id") * 7 % 120))
    req = e.select("event_id", n1.alias("scene_t1"), F.concat(n2, F.lit(".png")).alias("scene_t2"))
    return fb.resolve_scenes(req, files, ("base_t1.png", "base_t2.png"))


from checks.pixels import REP  # noqa: E402


def _reports(s, sf):
    r = rgb.change_report(v.pairs(s, sf), ["scene"], register=False)
    sid = F.col("scene").cast("string")
    return (r.withColumn("analysis_id", F.concat(F.lit("analysis_"), sid)).withColumn("tile_id_t1", F.concat(F.lit("s"), sid, F.lit("_0")))
            .withColumn("tile_id_t2", F.concat(F.lit("s"), sid, F.lit("_1"))))


TYPE_CASE = ("CASE category WHEN 'flood' THEN 'Flood / Water-Body Inundation' WHEN 'vegetation' THEN 'Deforestation / Vegetation Loss' "
             "WHEN 'solar' THEN 'Solar Array / Industrial Facility' ELSE 'New Construction / Urban Expansion' END")
LOG_SQL = f"""
SELECT 'analysis_' || scene AS analysis_id, 's' || scene || '_0' AS tile_id_t1, 's' || scene || '_1' AS tile_id_t2, {TYPE_CASE} AS change_type,
       {half_even('confidence', 2)} AS confidence, area_ha AS affected_area_ha, area_sq_m AS affected_area_sq_m FROM rep"""


@check("detection_log", "analysis_id:s tile_id_t1:s tile_id_t2:s change_type:s confidence:2 affected_area_ha:2 affected_area_sq_m:2", LOG_SQL, REP)
def _(s, sf):
    return records.detection_rows(_reports(s, sf))


@check("report_lookup", "analysis_id:s found:b affected_area_ha:2", f"""
SELECT w.analysis_id, l.analysis_id IS NOT NULL AS found, affected_area_ha FROM (SELECT DISTINCT 'analysis_' || user_id AS analysis_id FROM events) w LEFT JOIN ({LOG_SQL}) l USING (analysis_id)""", REP)
def _(s, sf):
    wanted = v.table(s, sf, "events").select(F.concat(F.lit("analysis_"), F.col("user_id").cast("string")).alias("analysis_id")).distinct()
    return records.report_lookup(records.detection_rows(_reports(s, sf)), wanted)


@check("compare_result", "id:s title:s confidence:2 changeType:s affectedArea:s affectedAreaSqM:2 gsd:s status:s meanDeltaNdvi:3", f"""
SELECT 'analysis_' || scene AS id, 'Bi-Temporal Analysis (s' || scene || '_0 -> s' || scene || '_1)' AS title, confidence, {TYPE_CASE} AS changeType,
       CAST(area_ha AS VARCHAR) || ' hectares' AS affectedArea, area_sq_m AS affectedAreaSqM, '10.0m Ground Sample Distance' AS gsd, 'PENDING REVIEW' AS status, mean_delta_veg AS meanDeltaNdvi FROM rep""", REP)
def _(s, sf):
    r = _reports(s, sf)
    req = r.select("analysis_id", F.col("tile_id_t1").alias("scene_t1"), F.col("tile_id_t2").alias("scene_t2"), F.lit("2024-08-10").alias("before_date"), F.lit("2026-08-14").alias("after_date"))
    return rgb.compare_result(req, r, "analysis_id")


# ---- clusters ----------------------------------------------------------------------------

EPS = 0.15


def points(s, sf):
    return v.alerts(s, sf).select("alert_id", "type", "confidence", F.col("latitude").alias("lat"), F.col("longitude").alias("lng"))


CLUSTER = "RECURSIVE " + v.ALERT + f""",
spot AS (SELECT DISTINCT latitude AS lat, longitude AS lng FROM alert),
link AS (SELECT a.lat AS alat, a.lng AS alng, b.lat AS blat, b.lng AS blng FROM spot a JOIN spot b ON sqrt((a.lat - b.lat) ** 2 + (a.lng - b.lng) ** 2) <= {EPS}),
reach AS (SELECT lat AS rlat, lng AS rlng, lat, lng FROM spot UNION SELECT rlat, rlng, blat, blng FROM reach JOIN link ON lat = alat AND lng = alng),
grp AS (SELECT rlat, rlng, min(alert_id) AS cluster FROM reach JOIN alert ON latitude = lat AND longitude = lng GROUP BY ALL),
mem AS (SELECT alert_id, type, confidence, latitude AS lat, longitude AS lng, cluster FROM alert JOIN grp ON latitude = rlat AND longitude = rlng),
summ AS (SELECT cluster, avg(lat) AS center_lat, avg(lng) AS center_lng, count(*) AS member_count, avg(confidence) AS confidence, min(lat) - 0.008 AS min_lat, max(lng) + 0.008 AS max_lng
         FROM mem GROUP BY cluster HAVING count(*) >= 2)"""


def members(s, sf):
    return clusters.spatial_clusters(points(s, sf), EPS)


@check("spatial_clusters", "alert_id:s cluster:s", "SELECT * FROM mem", CLUSTER)
def _(s, sf):
    return members(s, sf)


@check("cluster_summary", "cluster:s center_lat:5 center_lng:5 member_count:l confidence:2 min_lat:6 max_lng:6", "SELECT * FROM summ", CLUSTER)
def _(s, sf):
    return clusters.cluster_summary(members(s, sf))


@check("cluster_fallback", "cluster:s member_count:l min_lat:6 max_lng:6", """
SELECT min(alert_id) AS cluster, count(*) AS member_count, min(latitude) - 0.01 AS min_lat, max(longitude) + 0.01 AS max_lng FROM alert""", v.ALERT)
def _(s, sf):
    p = points(s, sf)
    return clusters.clusters_or_fallback(p, p.withColumn("cluster", F.col("alert_id")))


@check("cluster_number", "cluster:s cluster_id:s cluster_name:s", """
SELECT cluster, 'cluster_' || n AS cluster_id, 'Spatial Activity Cluster #' || n AS cluster_name FROM (
  SELECT cluster, CASE WHEN r < 10 THEN '0' || r ELSE CAST(r AS VARCHAR) END AS n FROM (SELECT cluster, row_number() OVER (ORDER BY cluster) AS r FROM summ))""", CLUSTER)
def _(s, sf):
    return clusters.cluster_number(clusters.cluster_summary(members(s, sf)))


@check("cluster_types", "cluster:s types:s", """
SELECT cluster, array_to_string(list_transform(list_sort(list({'f': f, 't': type}))[1:3], lambda e: e.t), '|') AS types
FROM (SELECT cluster, type, min(alert_id) AS f FROM mem GROUP BY ALL) GROUP BY cluster""", CLUSTER)
def _(s, sf):
    return clusters.cluster_types(members(s, sf)).withColumn("types", F.array_join("types", "|"))


# Clustering needs no point pairs: a link joins two occupied cells that hold at
# least one pair in reach, and the points of one cell are always in reach.
CELL = f"CAST(floor({{c}} / {EPS / 2 ** 0.5 * (1 - 1e-12)!r}) AS BIGINT)"


@check("neighbor_pairs", "src:s dst:s", f"""
SELECT DISTINCT ay || '/' || ax AS src, b_y || '/' || bx AS dst FROM (
  SELECT {CELL.format(c='alat')} AS ay, {CELL.format(c='alng')} AS ax, {CELL.format(c='blat')} AS b_y, {CELL.format(c='blng')} AS bx FROM link)
WHERE b_y > ay OR (b_y = ay AND bx > ax)""",
       v.ALERT + "," + CLUSTER.split("reach AS")[0].split("spot AS")[1].join(["spot AS", ""]).rstrip().rstrip(","))
def _(s, sf):
    return clusters.neighbor_cells(points(s, sf), EPS)


# ---- labels --------------------------------------------------------------------------------

COUNTS = """
(SELECT {keys} count_if(pred AND truth) AS tp, count_if(pred AND NOT truth) AS fp, count_if(NOT pred AND truth) AS fn, count_if(NOT pred AND NOT truth) AS tn FROM pair_label {group})"""
METRICS = """
SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 1.0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall,
  CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0.0 END AS f1, CASE WHEN tp + fp + fn > 0 THEN tp / (tp + fp + fn) ELSE 0.0 END AS iou,
  CASE WHEN fp + tn > 0 THEN fp / (fp + tn) ELSE 0.0 END AS fpr FROM """


@check("seg_metrics", "tp:l fp:l fn:l tn:l precision:4 recall:4 f1:4 iou:4 fpr:4", METRICS + COUNTS.format(keys="", group=""), v.PAIR_LABEL)
def _(s, sf):
    return ev.seg_metrics(v.pair_labels(s, sf), F.col("pred"), F.col("truth"))


@check("label_accuracy", "accuracy:4", "SELECT avg(CASE WHEN doc_id % 5 = (doc_id * 3) % 5 THEN 1.0 ELSE 0.0 END) AS accuracy FROM pair_label", v.PAIR_LABEL)
def _(s, sf):
    return ev.label_accuracy(v.pair_labels(s, sf), F.col("cls"), F.col("doc_id") * 3 % 5)


@check("per_class_accuracy", "cls:l accuracy:4 f1:4 macro_f1:4", f"""
SELECT cls, (tp + tn) / (tp + fp + fn + tn) AS accuracy, f1, avg({half_even('f1', 4)}) OVER () AS macro_f1 FROM ({METRICS + COUNTS.format(keys='cls,', group='GROUP BY cls')})""", v.PAIR_LABEL)
def _(s, sf):
    return ev.per_class_accuracy(v.pair_labels(s, sf), "cls", F.col("pred"), F.col("truth"))


@check("class_weights", "doc_id:l weight:8", """
SELECT doc_id, w / sum(w) OVER () AS weight FROM (SELECT doc_id, (SELECT count(*) FROM pair_label) / (n * 5.0) AS w FROM pair_label JOIN (SELECT cls, count(*) AS n FROM pair_label GROUP BY cls) USING (cls))""", v.PAIR_LABEL)
def _(s, sf):
    return ev.class_weights(v.pair_labels(s, sf), "cls")


SPLIT = v.PAIR_LABEL + """,
rk AS (SELECT doc_id, row_number() OVER (ORDER BY sha256('42:' || doc_id)) <= greatest(1, round_even(count(*) OVER () * 0.2, 0)) AS held FROM pair_label)"""


@check("split_holdout", "doc_id:l", "SELECT doc_id FROM rk WHERE held", SPLIT)
def _(s, sf):
    return ev.split_holdout(v.pair_labels(s, sf), "doc_id")[1]


@check("split_anti", "doc_id:l", "SELECT doc_id FROM rk WHERE NOT held", SPLIT)
def _(s, sf):
    return ev.split_holdout(v.pair_labels(s, sf), "doc_id")[0]


@check("contract_validate", "event_id:l violations:s", """
SELECT event_id, array_to_string(list_filter([CASE WHEN NOT coalesce(k BETWEEN 1 AND 50, false) THEN 'top_k' END, CASE WHEN NOT coalesce(value / 90.0 BETWEEN 0 AND 1, false) THEN 'min_confidence' END,
  CASE WHEN NOT d IN ('confirm', 'reject') THEN 'decision' END, CASE WHEN len(sha) <> 64 THEN 'sha256' END], lambda r: r IS NOT NULL), ',') AS violations
FROM (SELECT *, (['confirm', 'reject', 'Confirm', ''])[event_id % 4 + 1] AS d, CASE WHEN event_id % 11 = 0 THEN 'abc' ELSE sha256(CAST(event_id AS VARCHAR)) END AS sha FROM acquisition)""", v.ACQUISITION)
def _(s, sf):
    a = v.acquisitions(s, sf)
    n = F.col("event_id")
    a = a.withColumn("d", v._choose(["confirm", "reject", "Confirm", ""], n % 4)).withColumn(
        "sha", F.when(n % 11 == 0, "abc").otherwise(F.sha2(n.cast("string"), 256)))
    out = ev.check_contract(a, {
        "top_k": ev.between(F.col("k"), 1, 50), "min_confidence": ev.between(F.col("value") / 90.0, 0.0, 1.0),
        "decision": F.col("d").rlike("^(confirm|reject)$"), "sha256": F.col("sha").rlike("^[a-fA-F0-9]{64}$")})
    return out.withColumn("violations", F.array_join("violations", ","))
