"""Views that give the driver tables the shapes of the data model, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from scenelake.functions.mathx import clip
from scenelake.operators.blocks import widen


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# --- Scenes: an embedding is an 8 x 8 band; six make one scene (three bands, two dates).
# The first vectors complete the last scene a second time. ---

SCENE_WIDTH = 8
PAIR_ROLES = [(f"{b}{e + 1}", e, i) for e in (0, 1) for i, b in enumerate("rgb")]


def band_blocks(spark, sf) -> DataFrame:
    e = table(spark, sf, "embeddings")
    places = F.expr("filter(array(vec_id, vec_id + n), p -> p < (n + 5) div 6 * 6)")
    e = e.withColumn("n", e.agg(F.max("vec_id") + 1).scalar()).withColumn("place", F.explode(places))
    values = F.transform("embedding", lambda v: clip(F.lit(0.5) + F.lit(0.8) * v.cast("double"), 0.0, 1.0))
    return e.select(F.expr("place div 6").alias("scene"), F.expr("(place div 3) % 2").alias("epoch"),
                    (F.col("place") % 3).alias("band"), F.expr("place div 3").alias("picture"), values.alias("values"))


def pairs(spark, sf) -> DataFrame:
    roles = {name: (F.col("epoch") == e) & (F.col("band") == b) for name, e, b in PAIR_ROLES}
    return widen(band_blocks(spark, sf), ["scene"], roles).withColumn("width", F.lit(SCENE_WIDTH))


def picture_stack(spark, sf) -> DataFrame:
    """Every picture (three bands) as one acquisition; eight sites take turns, one picture a day."""
    roles = {b: F.col("band") == i for i, b in enumerate("rgb")}
    rows = widen(band_blocks(spark, sf), ["picture"], roles).withColumn("width", F.lit(SCENE_WIDTH))
    return rows.withColumn("site", F.col("picture") % 8).withColumn(
        "ts", F.timestamp_add("DAY", F.col("picture").cast("int"), F.lit("2024-01-01").cast("timestamp")))


def blocks_of_pictures(pictures: DataFrame, arrays, side: int = 4) -> DataFrame:
    """Pictures cut into square blocks: one row per block, with its place."""
    place = F.explode(F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c"))
                                for r in range(SCENE_WIDTH // side) for c in range(SCENE_WIDTH // side)]))
    rows = pictures.withColumn("_p", place)

    def cut(name: str):
        starts = [F.col("_p.r") * side * SCENE_WIDTH + F.col("_p.c") * side + line * SCENE_WIDTH + 1 for line in range(side)]
        return F.concat(*[F.slice(name, start, side) for start in starts])

    return rows.withColumns({**{a: cut(a) for a in arrays}, "width": F.lit(side), "block_row": F.col("_p.r"),
                             "block_col": F.col("_p.c"), "block_size": F.lit(side)}).drop("_p")


def epoch_blocks(spark, sf, epoch: int) -> DataFrame:
    """Blocks of one date with arrays r, g, b."""
    roles = {b: F.col("band") == i for i, b in enumerate("rgb")}
    return widen(band_blocks(spark, sf).where(F.col("epoch") == epoch), ["scene"], roles).withColumn(
        "width", F.lit(SCENE_WIDTH))


BAND_PX = """
band_px AS (
  SELECT place // 6 AS scene, (place // 3) % 2 AS epoch, place % 3 AS band, pos // 8 AS y, pos % 8 AS x,
         greatest(0.0, least(1.0, 0.5 + 0.8 * CAST(v AS DOUBLE))) AS v
  FROM (SELECT place, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM (
          SELECT vec_id AS place, embedding FROM embeddings UNION ALL
          SELECT vec_id + n, embedding FROM embeddings, (SELECT max(vec_id) + 1 AS n FROM embeddings)
          WHERE vec_id + n < (n + 5) // 6 * 6)))
"""
PAIR_PX = BAND_PX + ", pair_px AS (SELECT scene, y, x, " + ", ".join(
    f"max(CASE WHEN epoch = {e} AND band = {b} THEN v END) AS {name}" for name, e, b in PAIR_ROLES
) + " FROM band_px GROUP BY scene, y, x)"

# Consecutive pictures of a site as pairs, named by the first one.
STACK_PX = BAND_PX + """, pair_px AS (
  SELECT a.scene, a.y, a.x, a.r AS r1, a.g AS g1, a.b AS b1, b.r AS r2, b.g AS g2, b.b AS b2
  FROM pic a JOIN pic b ON b.scene = a.scene + 8 AND a.y = b.y AND a.x = b.x)""".replace("pair_px", """pic AS (
  SELECT scene * 2 + epoch AS scene, y, x, max(CASE WHEN band = 0 THEN v END) AS r, max(CASE WHEN band = 1 THEN v END) AS g,
         max(CASE WHEN band = 2 THEN v END) AS b FROM band_px GROUP BY ALL), pair_px""", 1)

# --- Flat pixels: one row per line item. ---


def pixel_flat(spark, sf) -> DataFrame:
    li = table(spark, sf, "lineitem")
    return li.select(
        F.col("l_suppkey").alias("tile"), F.col("l_orderkey").alias("okey"), F.col("l_linenumber").alias("line"),
        (F.col("l_discount") * 10.0).alias("red"), (F.col("l_quantity") / 50.0).alias("green"),
        ((F.col("l_discount") * 10.0 + F.col("l_quantity") / 50.0) / 2.0).alias("blue"),
        (F.lit(1.0) - F.col("l_tax") * 10.0).alias("nir"), (F.col("l_partkey") % 256).cast("int").alias("qa"),
        (F.col("l_partkey") % 12).cast("int").alias("scl"), F.col("l_extendedprice").alias("dn"))


PIXEL_FLAT = """
pixel_flat AS (
  SELECT l_suppkey AS tile, l_orderkey AS okey, l_linenumber AS line, l_discount * 10.0 AS red,
         l_quantity / 50.0 AS green, (l_discount * 10.0 + l_quantity / 50.0) / 2.0 AS blue,
         1.0 - l_tax * 10.0 AS nir, CAST(l_partkey % 256 AS INTEGER) AS qa, CAST(l_partkey % 12 AS INTEGER) AS scl,
         l_extendedprice AS dn
  FROM lineitem)
"""

# --- Acquisitions: one row per event. ---


def acquisitions(spark, sf) -> DataFrame:
    ev = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    return ev.select(
        F.col("user_id").alias("site"), "ts", "event_id", F.least(F.lit(1.0), F.col("value") / 100.0).alias("confidence"),
        ((k % 100) / 100.0).alias("qa_coverage"), k.alias("k"), "value")


ACQUISITION = """
acquisition AS (
  SELECT user_id AS site, ts, event_id, least(1.0, value / 100.0) AS confidence, (k % 100) / 100.0 AS qa_coverage, k,
         value
  FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events))
"""

# --- Alerts and feedback. ---

ALERT_TYPES = ["New Construction / Urban Expansion", "Flood / Water-Body Inundation",
               "Deforestation / Vegetation Loss", "Solar Array / Industrial Facility", "General Spectral Anomaly"]
STATUSES = ["PENDING REVIEW", "CONFIRMED", "REJECTED"]
SENSORS = ["Sentinel-2 MSI", "Sentinel-1 SAR", "Landsat-9 OLI-2", "Sentinel-2 MSI + Sentinel-1 SAR"]


def _choose(values, index):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def _sql_choose(values, index: str) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + f"][({index}) + 1]"


def alerts(spark, sf) -> DataFrame:
    ev = table(spark, sf, "events").where(F.col("event_type") == "error")
    return ev.select(
        F.concat(F.lit("ALT-"), F.col("event_id").cast("string")).alias("alert_id"),
        _choose(ALERT_TYPES, F.col("event_id") % 5).alias("type"), _choose(STATUSES, F.col("event_id") % 3).alias("status"),
        F.least(F.lit(1.0), F.col("value") / 100.0).alias("confidence"),
        (F.lit(12.0) + (F.col("user_id") % 40) / 10.0).alias("latitude"),
        (F.lit(75.0) + (F.col("user_id") % 60) / 10.0).alias("longitude"),
        F.concat(F.lit("Block "), (F.col("user_id") % 17).cast("string")).alias("location_name"),
        F.concat((F.col("event_id") % 50).cast("string"), F.lit(" ha")).alias("affected_area"),
        _choose(SENSORS, F.col("user_id") % 4).alias("sensor"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("detected_at"),
        F.concat(F.lit("analysis_"), F.col("event_id").cast("string")).alias("analysis_id"),
        F.concat(F.lit("Event "), F.col("event_id").cast("string")).alias("summary"), "ts", "event_id", "user_id")


ALERT = f"""
alert AS (
  SELECT 'ALT-' || event_id AS alert_id, {_sql_choose(ALERT_TYPES, 'event_id % 5')} AS type,
         {_sql_choose(STATUSES, 'event_id % 3')} AS status, least(1.0, value / 100.0) AS confidence,
         12.0 + (user_id % 40) / 10.0 AS latitude, 75.0 + (user_id % 60) / 10.0 AS longitude,
         'Block ' || (user_id % 17) AS location_name, (event_id % 50) || ' ha' AS affected_area,
         {_sql_choose(SENSORS, 'user_id % 4')} AS sensor, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS detected_at,
         'analysis_' || event_id AS analysis_id, 'Event ' || event_id AS summary, ts, event_id, user_id
  FROM events WHERE event_type = 'error')
"""


def feedback(spark, sf) -> DataFrame:
    """Purchases confirm and clicks reject the first alert of the same user.

    Every fourth id lacks its ``ALT-`` prefix and every seventh names no alert.
    """
    ev = table(spark, sf, "events")
    first = ev.where(F.col("event_type") == "error").groupBy("user_id").agg(F.min("event_id").alias("target"))
    rows = ev.where(F.col("event_type").isin("purchase", "click")).join(first, "user_id")
    target = F.col("target").cast("string")
    ident = (F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("NONE-"), F.col("event_id").cast("string")))
             .when(F.col("event_id") % 4 == 0, F.concat(F.lit("T-"), target))
             .otherwise(F.concat(F.lit("ALT-"), target)))
    return rows.select(
        ident.alias("alert_id"), F.when(F.col("event_type") == "purchase", "CONFIRM").otherwise("REJECT").alias("action"),
        F.lit("Visual Inspection").alias("rationale"), F.lit(None).cast("string").alias("notes"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("reviewed_at"), "ts", "event_id", "user_id")


FEEDBACK = """
feedback AS (
  SELECT CASE WHEN e.event_id % 7 = 0 THEN 'NONE-' || e.event_id WHEN e.event_id % 4 = 0 THEN 'T-' || f.target
              ELSE 'ALT-' || f.target END AS alert_id,
         CASE WHEN event_type = 'purchase' THEN 'CONFIRM' ELSE 'REJECT' END AS action,
         'Visual Inspection' AS rationale, CAST(NULL AS VARCHAR) AS notes,
         strftime(ts, '%Y-%m-%dT%H:%M:%S') AS reviewed_at, ts, event_id, e.user_id
  FROM events e JOIN (SELECT user_id, min(event_id) AS target FROM events WHERE event_type = 'error' GROUP BY user_id) f
    ON e.user_id = f.user_id
  WHERE event_type IN ('purchase', 'click'))
"""

# --- Natural-language queries, one per event. ---

SUBJECTS = ["new construction", "flood inundation", "deforestation and tree loss", "solar park expansion",
            "port terminal growth", "built-up sprawl", "green cover change", "clean energy projects", "anything at all",
            "high-tech shed", "city growth", "water-body change"]
PLACES = ["in Tumakuru", "near the Krishna delta", "around Ennore Port", "in Bengaluru", "across New Delhi",
          "near rivers", "in recent", "at Silver-Lake Town", "", "region of Coorg", "in Goa", "over Vijayawada"]
TIMES = ["", " in 2024", " between 2023 and 2025", " since 2031", " 2019-2026", " during v2020x"]


def query_texts(spark, sf) -> DataFrame:
    ev = table(spark, sf, "events")
    return ev.select(F.col("event_id").alias("query_id"), F.concat(
        _choose(SUBJECTS, F.col("event_id") % 12), F.lit(" "), _choose(PLACES, F.expr("(event_id div 12) % 12")),
        _choose(TIMES, F.expr("(event_id div 144 + user_id) % 6"))).alias("query"))


QUERY_TEXT = f"""
query_text AS (
  SELECT event_id AS query_id, {_sql_choose(SUBJECTS, 'event_id % 12')} || ' '
      || {_sql_choose(PLACES, '(event_id // 12) % 12')}
      || {_sql_choose(TIMES, '(event_id // 144 + user_id) % 6')} AS query
  FROM events)
"""

# --- STAC items, one per event, in three dialects. ---


def stac_items(spark, sf) -> DataFrame:
    ev = table(spark, sf, "events")
    ident = F.col("event_id").cast("string")
    day = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    user = F.col("user_id").cast("string")
    platform = (F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('"platform":"'), _choose(["S2A", "Landsat_8", " lc09 ", "PlanetScope"], F.col("user_id") % 4), F.lit('",')))
                .when(F.col("event_id") % 3 == 1, F.lit('"platform":"","eo:platform":"sentinel-2b",'))
                .otherwise(F.lit('"instruments":["oli","tirs"],')))
    view = (F.when(F.col("event_id") % 3 == 0, F.lit(""))
            .when(F.col("event_id") % 10 == 1, F.lit('"view:off_nadir":0,"view:sun_elevation":55.5,'))
            .otherwise(F.concat(F.lit('"view:off_nadir":'), (F.col("user_id") % 30).cast("string"), F.lit(".5,"))))
    when = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit('"datetime":"","start_datetime":"'), day, F.lit('",'))).otherwise(
        F.concat(F.lit('"datetime":"'), day, F.lit('",')))
    crs = (F.when(F.col("event_id") % 4 == 0, F.lit('"proj:epsg":32644,'))
           .when(F.col("event_id") % 4 == 1, F.lit('"crs":"32643",')).when(F.col("event_id") % 4 == 2, F.lit('"crs":"EPSG:3857",'))
           .otherwise(F.lit("")))
    box = F.when(F.col("event_id") % 6 == 0, F.lit("")).otherwise(F.concat(
        F.lit(',"bbox":['), user, F.lit(".0,"), user, F.lit(".5,"), user, F.lit(".25,"), user, F.lit(".75]")))
    json = F.concat(F.lit('{"id":"item_'), ident, F.lit('","properties":{'), platform, view, when, crs,
                    F.lit('"sat:incidence_angle":"'), (F.col("event_id") % 40).cast("string"),
                    F.lit('","sat:orbit_state":"'), F.when(F.col("event_id") % 2 == 0, "ascending").otherwise(""),
                    F.lit('","orbit":"'), user, F.lit('"}'), box, F.lit("}"))
    return ev.select("event_id", json.alias("json"))


# --- Tile vectors. ---


def tile_vectors(spark, sf) -> DataFrame:
    e = table(spark, sf, "embeddings")
    vec = F.col("vec_id")
    return e.select(
        F.concat(F.lit("tile_"), vec.cast("string")).alias("tile_id"), "embedding",
        _choose(["tumakuru", "krishna", "ennore"], F.col("label") % 3).alias("aoi"), "vec_id", "label",
        (F.lit(2024) + vec % 3).cast("int").alias("year"))


TILE_CATEGORIES = ["VEGETATION", "URBAN_EXPANSION", "CONSTRUCTION_INDUSTRIAL", "SOLAR_ENERGY", "WATER_FLOOD",
                   "PORT_INFRASTRUCTURE"]


def tile_profiles(spark, sf) -> DataFrame:
    """Profiles of all tiles but every eleventh."""
    t = tile_vectors(spark, sf).where(F.col("vec_id") % 11 != 0)
    main = _choose(TILE_CATEGORIES, F.col("label") % 6)
    second = _choose(TILE_CATEGORIES, (F.col("label") + F.col("vec_id")) % 6)
    return t.select("tile_id", "aoi", F.array_distinct(F.array(main, second)).alias("primary_types"),
                    F.concat(F.lit("Category "), main).alias("category"),
                    F.concat(F.lit("Scene "), "tile_id").alias("description"), "year")


TILE_VECTOR = f"""
tile_vector AS (
  SELECT 'tile_' || vec_id AS tile_id, embedding, {_sql_choose(['tumakuru', 'krishna', 'ennore'], 'label % 3')} AS aoi,
         vec_id, label, CAST(2024 + vec_id % 3 AS INTEGER) AS year FROM embeddings),
tile_profile AS (
  SELECT tile_id, aoi, list_distinct([{_sql_choose(TILE_CATEGORIES, 'label % 6')},
         {_sql_choose(TILE_CATEGORIES, '(label + vec_id) % 6')}]) AS primary_types,
         'Category ' || {_sql_choose(TILE_CATEGORIES, 'label % 6')} AS category, 'Scene ' || tile_id AS description, year
  FROM tile_vector WHERE vec_id % 11 <> 0)
"""

# --- Labelled pairs. ---


def pair_labels(spark, sf) -> DataFrame:
    lb = table(spark, sf, "labels")
    return lb.select("doc_id", (F.col("toxic") > 0).alias("pred"), (F.col("quality") < 1).alias("truth"),
                     (F.col("doc_id") % 5).alias("cls"))


PAIR_LABEL = """
pair_label AS (SELECT doc_id, toxic > 0 AS pred, quality < 1 AS truth, doc_id % 5 AS cls FROM labels)
"""
