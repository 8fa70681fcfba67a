"""Alerts and analyst feedback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from scenelake.operators.components import salted_lookup

# Unmatched ids (short texts) that may be broadcast.
IDS_BROADCAST = 100_000


def alerts_by_status(alerts: DataFrame, status: str | None = None, short_pending: bool = False) -> DataFrame:
    """Alerts of a status; everything for none or ALL. ``short_pending`` reads PENDING as PENDING REVIEW."""
    if not status or status.upper() == "ALL":
        return alerts
    wanted = status.upper()
    if short_pending and wanted == "PENDING":
        wanted = "PENDING REVIEW"
    return alerts.where(F.col("status") == wanted)


def alerts_text_filter(alerts: DataFrame, status: str, text: str) -> DataFrame:
    """Status tab and a case-insensitive substring of id, type or location."""
    rows = alerts_by_status(alerts, status, short_pending=True)
    if not text.strip():
        return rows
    needle = text.lower()
    hit = [F.lower(F.col(c)).contains(needle) for c in ("alert_id", "type", "location_name")]
    return rows.where(hit[0] | hit[1] | hit[2])


def alert_by_id(alerts: DataFrame, alert_id: str | Column) -> DataFrame:
    """The alert of that id (a value, or a scalar such as an aggregate's result): one row, or none."""
    wanted = alert_id if isinstance(alert_id, Column) else F.lit(alert_id)
    return alerts.where(F.col("alert_id") == wanted).limit(1)


def alert_counts(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("status").agg(F.count("*").alias("n"))


def new_status(action: Column) -> Column:
    return F.when(F.upper(action) == "CONFIRM", "CONFIRMED").otherwise("REJECTED")


def match_feedback(feedback: DataFrame, alerts: DataFrame, key: str = "alert_id") -> DataFrame:
    """Add ``matched_id``: the alert of that id, else the smallest alert id containing it, else NULL.

    A containing id is found by equality on its substrings of the lengths that
    unmatched feedback really uses, so no pair of tables is compared row by row.
    Distinct feedback ids are resolved once, however often one alert is reviewed.
    """
    ids = feedback.select(key).distinct()
    exact = alerts.select(F.col("alert_id").alias(key), F.col("alert_id").alias("matched_id")).distinct()
    found = ids.join(exact, key, "left")
    rest = found.where(F.col("matched_id").isNull()).select(key)
    lengths = rest.agg(F.collect_set(F.length(key)).alias("n")).scalar()
    names = alerts.select("alert_id").distinct()
    parts = (names.select("alert_id", F.explode(lengths).alias("_len"))
             .where(F.col("_len") <= F.length("alert_id"))
             .select("alert_id", F.explode(F.expr(
                 "transform(sequence(1, length(alert_id) - _len + 1), i -> substring(alert_id, i, _len))")).alias("_part")))
    # Only substrings that some unmatched id equals are shuffled.
    few = rest.count() <= IDS_BROADCAST
    asked = rest.withColumnRenamed(key, "_part")
    parts = parts.join(F.broadcast(asked) if few else asked, "_part", "left_semi")
    contained = (parts.groupBy("_part").agg(F.min("alert_id").alias("_contains"))
                 .withColumnRenamed("_part", key))
    resolved = (found.join(contained, key, "left")
                .select(key, F.coalesce("matched_id", "_contains").alias("matched_id")))
    # The salt comes from the row itself, so a recomputed stage deals it to the same copy.
    own = F.xxhash64(*feedback.columns)
    return salted_lookup(feedback.withColumn("_row", own), resolved, key, "_row").drop("_row")


def latest_feedback(feedback: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Last decision per alert by arrival, plus how many decisions it had.

    An ordered maximum combines before the shuffle, so a much reviewed alert is
    no hot group.
    """
    rest = [c for c in feedback.columns if c != key]
    return (feedback.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_f"),
                                      F.count("*").alias("n_decisions"))
            .select(key, *[F.col("_f")[c].alias(c) for c in rest], "n_decisions"))


def apply_feedback(alerts: DataFrame, latest: DataFrame) -> DataFrame:
    """Alerts with the status and note of their last decision (latest: matched_id, action, rationale, notes, reviewed_at)."""
    f = latest.select(F.col("matched_id").alias("alert_id"), F.col("action").alias("feedback_action"),
                      F.col("rationale").alias("feedback_rationale"),
                      F.coalesce("notes", F.lit("")).alias("feedback_notes"),
                      F.col("reviewed_at").alias("feedback_reviewed_at"))
    status = F.when(F.col("feedback_action").isNotNull(), new_status(F.col("feedback_action"))).otherwise(F.col("status"))
    base = alerts.drop("feedback_action", "feedback_rationale", "feedback_notes", "feedback_reviewed_at")
    return base.join(f, "alert_id", "left").withColumn("status", status)


def retrain_trigger(labels: DataFrame, key: str, threshold: int = 20) -> DataFrame:
    """Labels stored per model and whether they reach the retraining threshold."""
    return labels.groupBy(key).agg(F.count("*").alias("n_labels"), (F.count("*") >= threshold).alias("is_triggered"))


def resolve_scenes(requests: DataFrame, scenes: DataFrame, default: tuple[str, str], reject: bool = False
                   ) -> DataFrame:
    """Scene file pair of each request; the default pair for both unless both exist.

    ``.png`` is added where missing. With ``reject`` such requests keep NULLs instead.
    """
    def file(name: str) -> Column:
        c = F.col(name)
        return F.when(c.endswith(".png"), c).otherwise(F.concat(c, F.lit(".png")))

    files = scenes.select("file_name").distinct()
    both = requests.withColumn("_f1", file("scene_t1")).withColumn("_f2", file("scene_t2"))
    for n in ("1", "2"):
        both = both.join(files.select(F.col("file_name").alias(f"_f{n}"), F.lit(True).alias(f"_ok{n}")), f"_f{n}", "left")
    ok = F.col("_ok1").isNotNull() & F.col("_ok2").isNotNull()
    names = [F.when(ok, F.col(f"_f{n}")).otherwise(F.lit(None if reject else default[i]).cast("string")).alias(f"file_t{n}")
             for i, n in enumerate(("1", "2"))]
    return both.select(*requests.columns, *names, ok.alias("is_resolved"))
