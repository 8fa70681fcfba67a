"""Alert, hit, event and log records: loading, JSON shapes and append sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from scenelake.functions.labels import format_coordinates
from scenelake.functions.mathx import round_column

ALERT_JSON = ("id string, type string, status string, confidence double, latitude double, longitude double, "
              "locationName string, affectedArea string, sensor string, detectedAt string, analysisId string, "
              "summary string")


def alerts_from_json(raw: DataFrame, json: str = "json") -> DataFrame:
    """Alert texts to table rows with defaults for absent fields."""
    a = raw.select(F.from_json(F.col(json), ALERT_JSON).alias("a"))

    def field(name: str, default) -> Column:
        return F.coalesce(F.col("a")[name], F.lit(default))

    return a.select(
        F.col("a.id").alias("alert_id"), field("type", "Change Anomaly").alias("type"),
        field("status", "PENDING REVIEW").alias("status"), field("confidence", 0.90).alias("confidence"),
        field("latitude", 13.34).alias("latitude"), field("longitude", 77.10).alias("longitude"),
        field("locationName", "").alias("location_name"), field("affectedArea", "10 ha").alias("affected_area"),
        field("sensor", "Sentinel-2 MSI").alias("sensor"), F.col("a.detectedAt").alias("detected_at"),
        field("analysisId", "").alias("analysis_id"), field("summary", "").alias("summary"))


def load_alerts(spark, path: str, existing: DataFrame | None = None) -> DataFrame:
    """Alerts of JSON-line files, used only while the existing table is empty."""
    fresh = alerts_from_json(spark.read.text(path).withColumnRenamed("value", "json"))
    if existing is None:
        return fresh
    empty = existing.agg((F.count("*") == 0).alias("is_empty")).scalar()
    return existing.select(*fresh.columns).unionByName(fresh.where(empty))


def alert_to_json(alerts: DataFrame) -> DataFrame:
    """(alert_id, json) in camel case; ``feedback`` only where an action was recorded."""
    def text(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(""))

    feedback = F.when(F.col("feedback_action") != "", F.struct(
        F.col("feedback_action").alias("action"), text("feedback_rationale").alias("rationale"),
        text("feedback_notes").alias("analystNotes"), text("feedback_reviewed_at").alias("reviewedAt")))
    record = F.struct(
        F.col("alert_id").alias("id"), "type", "latitude", "longitude", "confidence",
        F.col("detected_at").alias("detectedAt"), "status", "sensor", F.col("affected_area").alias("affectedArea"),
        F.col("location_name").alias("locationName"), F.col("analysis_id").alias("analysisId"), "summary",
        feedback.alias("feedback"))
    return alerts.select("alert_id", F.to_json(record).alias("json"))


def hit_to_json(hits: DataFrame) -> DataFrame:
    """(tile_id, json) of search hits in camel case."""
    record = F.struct(
        F.col("tile_id").alias("id"), "title", "thumbnail", "latitude", "longitude",
        F.col("acquisition_date").alias("acquisitionDate"), "sensor", F.col("relevance").alias("relevanceScore"),
        "confidence", F.coalesce("category", F.lit("")).alias("category"),
        F.coalesce("details", F.lit("")).alias("details"),
        format_coordinates(F.col("latitude"), F.col("longitude")).alias("coordinates"), "bbox")
    return hits.select("tile_id", F.to_json(record).alias("json"))


def tile_csv_rows(tiles: DataFrame) -> DataFrame:
    """The eleven exported columns of a tile table."""
    return tiles.select(
        "tile_id", F.col("scene_id").cast("string").alias("source_image"), "tile_x", "tile_y", "tile_width",
        "tile_height", *[round_column(c, 6).alias(c) for c in ("min_lon", "min_lat", "max_lon", "max_lat")],
        round_column("cloud_percentage", 2).alias("cloud_percentage")
    ).withColumnsRenamed({"tile_width": "width", "tile_height": "height"})


def write_tile_csv(tiles: DataFrame, path: str) -> None:
    tile_csv_rows(tiles).write.mode("overwrite").csv(path, header=True)


def append_feedback(labels: DataFrame, path: str) -> None:
    labels.write.mode("append").json(path)


def append_detections(reports: DataFrame, path: str) -> None:
    detection_rows(reports).write.mode("append").parquet(path)


def detection_rows(reports: DataFrame) -> DataFrame:
    """Log row of an analysis."""
    return reports.select("analysis_id", "tile_id_t1", "tile_id_t2", "change_type",
                          F.col("confidence_score").alias("confidence"), F.col("area_ha").alias("affected_area_ha"),
                          F.col("area_sq_m").alias("affected_area_sq_m"))


def report_lookup(reports: DataFrame, wanted: DataFrame, key: str = "analysis_id") -> DataFrame:
    """Wanted ids with their report; ``found`` is false where none exists."""
    return (wanted.select(key).join(reports.withColumn("found", F.lit(True)), key, "left")
            .withColumn("found", F.coalesce("found", F.lit(False))))


def event_readme(events: DataFrame) -> Column:
    p = F.col("provenance")
    return F.format_string(
        "Change Event: %s\nModel: %s v%s\nWeights SHA-256: %s\nCode Git SHA: %s\nConfidence: %s\n"
        "Change Type: %s\nMorphology: %s\n",
        F.col("event_id"), p["model_name"], p["model_version"], p["weights_sha256"], p["code_git_sha"],
        F.col("confidence").cast("string"), F.col("change_type"), F.col("change_morphology"))


EVENT_FILES = 64  # files that an export is clustered into, by event


def export_events(events: DataFrame, path: str, mask: DataFrame | None = None, files: int = EVENT_FILES) -> None:
    """STAC feature, provenance, readme and optionally the mask of each event, as rows clustered by event.

    ``mask`` has one row per block of a mask: event_id, block_row, block_col,
    block_size, width and the array ``mask``. Rows of one event lie together, in
    files ordered by event, so a reader of one event opens few files however
    many events there are; the artefact is a folder level.
    """
    none = F.lit(None).cast("array<double>")
    texts = events.select("event_id", F.explode(F.create_map(
        F.lit("stac"), F.to_json("stac_change_event"), F.lit("provenance"), F.to_json("provenance"),
        F.lit("readme"), event_readme(events))).alias("artifact", "value")).select(
        "event_id", "artifact", "value", *[F.lit(None).cast("int").alias(c) for c in ("block_row", "block_col", "block_size", "width")],
        none.alias("mask"))
    if mask is not None:
        texts = texts.unionByName(mask.select(
            "event_id", F.lit("mask").alias("artifact"), F.lit(None).cast("string").alias("value"),
            *[F.col(c).cast("int") for c in ("block_row", "block_col", "block_size", "width")], F.col("mask").cast("array<double>")))
    # A busy event has many mask blocks: they are dealt by place as well.
    dealt = texts.repartitionByRange(files, "event_id", F.coalesce("block_row", F.lit(-1)), F.coalesce("block_col", F.lit(-1)))
    dealt.sortWithinPartitions("event_id").write.mode("append").partitionBy("artifact").parquet(path)


def read_events(spark, path: str) -> DataFrame:
    """Stored artefacts: event_id, artifact, value (texts) or the mask block."""
    return spark.read.parquet(path)
