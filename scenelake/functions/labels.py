"""Presentation rules: tiers, badges and formatted values."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from scenelake.functions.mathx import clip, round_half_up, round_to


def confidence_tier(score: Column) -> Column:
    """HIGH / MEDIUM / LOW; scores above 1 are percentages already."""
    pct = F.when(score > 1.0, round_half_up(score, 0)).otherwise(round_half_up(score * 100.0, 0))
    return F.when(pct < 70, "LOW").when(pct < 85, "MEDIUM").otherwise("HIGH")


def ndvi_label(delta: Column) -> Column:
    return (F.when(delta.isNull(), F.lit(None).cast("string"))
            .when(delta < -0.2, "Significant Loss").when(delta < 0, "Slight Loss").otherwise("Gain"))


def ndwi_highlighted(value: Column) -> Column:
    return F.when(value.isNotNull(), value > 0.3)


def status_class(status: Column) -> Column:
    text = F.upper(F.when(F.coalesce(status, F.lit("")) == "", "PENDING REVIEW").otherwise(status))
    return F.when(text.contains("CONFIRM"), "confirmed").when(text.contains("REJECT"), "rejected").otherwise("pending")


def sensor_matches(sensor: Column, kind: str) -> Column:
    """Sensor class test; a mixed sensor text may belong to both classes."""
    if kind == "OPTICAL":
        return sensor.contains("MSI") | sensor.contains("Landsat")
    if kind == "SAR":
        return sensor.contains("SAR") | sensor.contains("Sentinel-1")
    return F.lit(True)


def relevance_pct(cosine: Column) -> Column:
    """Cosine in [-1, 1] as a percentage with one decimal."""
    return round_to(clip((cosine + 1.0) / 2.0 * 100.0, 0.0, 100.0), 1)


def format_coordinates(lat: Column, lon: Column) -> Column:
    return F.format_string("%.4f° N, %.4f° E", lat, lon)


def format_hectares(area: Column) -> Column:
    return F.concat(area.cast("string"), F.lit(" hectares"))
