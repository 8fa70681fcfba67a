"""Two-date RGB change report.

cloud masks -> co-registration -> spectral distance -> index deltas ->
threshold -> phenology filter -> one aggregate per tile -> classification.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from scenelake.functions.mathx import clip, round_to, sigmoid
from scenelake.functions.spectral import (is_cloud_rgb, is_phenology, month_distance, rgb_distance, vegetation_proxy,
                                          water_proxy)
from scenelake.lookups import REPORT_CATEGORIES
from scenelake.operators.blocks import unroll
from scenelake.operators.components import spread_lookup
from scenelake.operators.ranks import grouped_quantiles
from scenelake.operators.registration import coregister

BANDS = ("r", "g", "b")


def change_pixels(pairs: DataFrame, keys: Sequence[str], threshold: float = 0.22, before: Column | None = None,
                  after: Column | None = None, register: bool = True, carry: Sequence[str] = ()) -> DataFrame:
    """Per-pixel evidence of a pair table with arrays r1..b2 and ``width``.

    The later cloud mask is taken before the images are aligned. ``before`` and
    ``after`` are date texts used by the phenology filter.
    """
    if register:
        pairs = coregister(pairs, BANDS, keys)
    else:
        for b in BANDS:
            pairs = pairs.withColumn(f"{b}2a", F.col(f"{b}2"))
    months = F.lit(0) if before is None else month_distance(before, after)
    pairs = pairs.withColumn("_months", months)
    arrays = [f"{b}{n}" for n in ("1", "2", "2a") for b in BANDS]
    px = unroll(pairs, [*keys, *carry, "_months"], arrays)
    r1, g1, b1, r2, g2, b2, ra, ga, ba = (F.col(a) for a in arrays)
    px = px.select(
        *keys, *carry, "y", "x", "_months", "r1", "g1", "b1", ra.alias("r2"), ga.alias("g2"), ba.alias("b2"),
        is_cloud_rgb(r1, g1, b1).alias("cloud1"), is_cloud_rgb(r2, g2, b2).alias("cloud2"),
        rgb_distance(r1, g1, b1, ra, ga, ba).alias("_raw"),
        (vegetation_proxy(ra, ga) - vegetation_proxy(r1, g1)).alias("delta_veg"),
        (water_proxy(ra, ba) - water_proxy(r1, b1)).alias("delta_water"),
        ((ra + ga + ba) / 3.0).alias("brightness2"))
    px = px.withColumn("distance", F.when(F.col("cloud1") | F.col("cloud2"), F.lit(0.0)).otherwise(F.col("_raw")))
    raw = F.col("distance") > threshold
    changed = raw & ~is_phenology(F.col("delta_veg"), F.col("_months"))
    return px.withColumn("above_threshold", raw).withColumn("changed", changed).drop("_raw", "_months")


def change_summary(pixels: DataFrame, keys: Sequence[str], gsd: float = 10.0) -> DataFrame:
    """Area, masked means and signal-to-noise confidence, in one aggregation."""
    hit = F.col("changed")
    n = F.count_if(hit)

    def masked(name: str) -> Column:
        return F.coalesce(F.avg(F.when(hit, F.col(name))), F.lit(0.0)).alias(f"mean_{name}")

    # Spread of all bands together: within the bands, and of their means.
    means = [F.avg(F.when(hit, F.col(f"{b}2"))) for b in BANDS]
    mean = sum(means) / 3.0
    std = F.sqrt(sum(F.var_pop(F.when(hit, F.col(f"{b}2"))) + (m - mean) * (m - mean) for b, m in zip(BANDS, means)) / 3.0)
    signal = F.avg(F.when(hit, F.col("distance")))
    noise = F.avg(F.when(~hit, F.col("distance"))) + 1e-6
    conf = clip(sigmoid((signal / noise - 1.5) * 0.8), 0.72, 0.96)
    area = float(gsd * gsd)
    return pixels.groupBy(*keys).agg(
        F.count("*").alias("n_pixels"), n.alias("n_changed"),
        round_to(n / F.count("*") * 100.0, 2).alias("change_ratio_pct"),
        round_to(n * (area / 10000.0), 2).alias("area_ha"), round_to(n * area, 2).alias("area_sq_m"),
        masked("delta_veg"), masked("delta_water"), masked("brightness2"),
        F.coalesce(std, F.lit(0.0)).alias("std_changed"),
        F.when(n == 0, F.lit(0.95)).when(n == F.count("*"), F.lit(None).cast("double")).otherwise(conf)
        .alias("confidence"))


def classify(summary: DataFrame) -> DataFrame:
    """Ordered category rules on the masked means."""
    veg, water, light = F.col("mean_delta_veg"), F.col("mean_delta_water"), F.col("mean_brightness2")
    code = (F.when(water > 0.18, "flood").when(veg < -0.15, "vegetation")
            .when((light > 0.40) & (veg < -0.05), "construction")
            .when((light < 0.25) & (F.col("std_changed") > 0.10), "solar").otherwise("other"))
    return summary.withColumn("category", code)


def _by_category(field: int) -> Column:
    pairs = [F.lit(x) for code, row in REPORT_CATEGORIES.items() for x in (code, row[field])]
    return F.create_map(*pairs)[F.col("category")]


def change_report(pairs: DataFrame, keys: Sequence[str], gsd: float = 10.0, threshold: float = 0.22,
                  before: Column | None = None, after: Column | None = None, register: bool = True) -> DataFrame:
    """One report row per pair."""
    pixels = change_pixels(pairs, keys, threshold, before, after, register)
    report = classify(change_summary(pixels, keys, gsd))
    return (report.withColumn("change_type", _by_category(0)).withColumn("label", _by_category(1))
            .withColumn("confidence_score", round_to(F.col("confidence"), 2))
            .withColumn("summary", F.concat(_by_category(6), F.lit(" ("), F.col("area_ha").cast("string"),
                                            F.lit(" ha)."))))


def mask_rgba(pixels: DataFrame, reports: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Overlay colour per pixel: the category's colour where changed, else transparent."""
    colours = reports.select(*keys, *[_by_category(i).alias(c) for c, i in zip("RGBA", (2, 3, 4, 5))])
    shown = [F.when(F.col("changed"), F.col(c)).otherwise(F.lit(0)).alias(c) for c in "RGBA"]
    return spread_lookup(pixels, colours, keys).select(*keys, "y", "x", *shown)


def heatmap_rgba(pixels: DataFrame, keys: Sequence[str], bounded: bool = True) -> DataFrame:
    """Heat colour per pixel from the distance relative to the key's 99th percentile.

    ``bounded`` keys are blocks, for which the built-in percentile holds at most a
    block of values; for whole scenes the bucketed quantile is used.
    """
    if bounded:
        top = pixels.groupBy(*keys).agg(F.percentile("distance", F.lit(0.99)).alias("_p99"))
    else:
        top = grouped_quantiles(pixels, keys, "distance", [0.99], ["_p99"])
    d = F.col("_d")

    def channel(x: Column) -> Column:
        return F.floor(x).cast("int")

    return (spread_lookup(pixels, top, keys)
            .withColumn("_d", clip(F.col("distance") / (F.col("_p99") + 1e-6), 0.0, 1.0))
            .select(*keys, "y", "x", channel(d * 255).alias("R"),
                    channel((1.0 - F.abs(d - 0.5) * 2) * 200).alias("G"), channel((1.0 - d) * 255).alias("B"),
                    channel(d * 190).alias("A")))


def compare_result(requests: DataFrame, reports: DataFrame, key: str, gsd: float = 10.0) -> DataFrame:
    """Response row of a comparison request (``analysis_id, scene_t1, scene_t2, before_date, after_date``)."""
    return requests.join(reports, key).select(
        F.col("analysis_id").alias("id"),
        F.concat(F.lit("Bi-Temporal Analysis ("), "scene_t1", F.lit(" -> "), "scene_t2", F.lit(")")).alias("title"),
        F.col("before_date").alias("beforeDate"), F.col("after_date").alias("afterDate"),
        F.col("confidence_score").alias("confidence"), F.col("change_type").alias("changeType"),
        F.concat(F.col("area_ha").cast("string"), F.lit(" hectares")).alias("affectedArea"),
        F.col("area_sq_m").alias("affectedAreaSqM"),
        F.lit(f"{gsd}m Ground Sample Distance").alias("gsd"),
        round_to(F.col("mean_delta_veg"), 3).alias("meanDeltaNdvi"),
        F.lit("PENDING REVIEW").alias("status"), F.col("summary").alias("notes"))
