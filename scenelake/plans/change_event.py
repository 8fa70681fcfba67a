"""Two-date QA/SAR change events and multi-date stacks.

A pair table holds per row: bands ``b1``/``b2``, ``qa1``/``qa2`` and optional
``sar`` arrays of both dates, ``width``, and scalar metadata. Band statistics,
scores and factors are computed on the arrays of the row; pixels are unrolled
once for the final aggregate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from scenelake.functions.mathx import clip, or_missing
from scenelake.functions.qa import decode_mixed
from scenelake.lookups import MORPHOLOGY_CLASSES, TYPE_CLASSES
from scenelake.operators import radiometry, registration, timeline
from scenelake.operators.blocks import unroll
from scenelake.operators.scenes import BLOCK, is_blocked, scene_values
from scenelake.session import checkpoint

WEIGHTS = {"model": 0.40, "qa": 0.20, "sar": 0.15, "seasonal": 0.15, "registration": 0.10}
MASK_THRESHOLD = 0.55


def view_angle(view1: Column, incidence1: Column, view2: Column, incidence2: Column, limit: float = 15.0
               ) -> tuple[Column, Column]:
    """(consistent, difference); a view angle of 0 falls back to the incidence angle."""
    a = F.coalesce(or_missing(view1, 0.0), incidence1)
    b = F.coalesce(or_missing(view2, 0.0), incidence2)
    delta = F.coalesce(F.abs(a - b), F.lit(0.0))
    return delta <= limit, delta


def looks_like_scl(mask: Column) -> Column:
    """Scene classes rather than bit flags: values to 11, at least two, with a land marker."""
    land = F.arrays_overlap(mask, F.array(F.lit(4), F.lit(6), F.lit(7)))
    bare_and_cloud = F.array_contains(mask, 5) & F.arrays_overlap(mask, F.array(F.lit(8), F.lit(9), F.lit(10)))
    return ((F.array_max(mask) <= 11) & (F.array_min(mask) >= 0) & (F.array_min(mask) != F.array_max(mask))
            & (land | bare_and_cloud))


def qa_encoding(pixels: DataFrame, keys: Sequence[str], mask: str) -> DataFrame:
    """The same test for masks stored one pixel per row, by aggregation."""
    m = F.col(mask)
    return pixels.groupBy(*keys).agg(
        ((F.max(m) <= 11) & (F.min(m) >= 0) & (F.min(m) != F.max(m))
         & (F.bool_or(m.isin(4, 6, 7)) | (F.bool_or(m == 5) & F.bool_or(m.isin(8, 9, 10))))).alias("is_scl"))


def raw_change_prob(pairs: DataFrame, bands: Sequence[str], after: str = "2", keys: Sequence[str] = ()) -> DataFrame:
    """Add ``prob``: mean absolute band difference scaled by the scene's maximum.

    ``keys`` name the scene where it has several blocks.
    """
    zipped = F.arrays_zip(*[f"{b}1" for b in bands], *[f"{b}{after}" for b in bands])
    diff = F.transform(zipped, lambda p: sum(F.abs(p[f"{b}{after}"] - p[f"{b}1"]) for b in bands) / float(len(bands)))
    top = F.col("_top")
    scaled = F.transform("_diff", lambda d: F.when(top > 1e-4, clip(d / top, 0.0, 1.0)).otherwise(F.lit(0.0)))
    rows = scene_values(pairs.withColumn("_diff", diff), keys, {"_top": (F.array_max("_diff"), F.max)})
    return rows.withColumn("prob", scaled).drop("_diff", "_top")


def _sar_change(sar1: Column, sar2: Column) -> Column:
    return F.aggregate(F.zip_with(sar1, sar2, lambda a, b: F.abs(b - a)), F.lit(0.0), lambda acc, v: acc + v)


def sar_agreement(sar1: Column, sar2: Column, threshold: float = 0.20) -> Column:
    """Mean absolute backscatter change relative to the threshold; NULL when a date has none."""
    return clip(_sar_change(sar1, sar2) / F.size(sar1) / F.lit(threshold + 1e-6), 0.0, 1.0)


def _scene_sar(pairs: DataFrame, keys: Sequence[str], sar1: Column, sar2: Column, threshold: float = 0.20) -> DataFrame:
    """Adds sar_agreement and sar_fused of the whole scene."""
    both = sar1.isNotNull() & sar2.isNotNull()
    rows = scene_values(pairs, keys, {"_change": (_sar_change(sar1, sar2), F.sum),
                                      "_count": (F.when(both, F.size(sar1)), F.sum), "sar_fused": (both, F.bool_and)})
    mean = clip(F.try_divide("_change", "_count") / F.lit(threshold + 1e-6), 0.0, 1.0)
    return rows.withColumn("sar_agreement", F.when(F.col("sar_fused"), mean)).drop("_change", "_count")


def _scene_encoding(pairs: DataFrame, keys: Sequence[str], mask: str, out: str) -> DataFrame:
    """Adds ``out``: the test of ``looks_like_scl`` on the mask of the whole scene."""
    m = F.col(mask)
    has = lambda *classes: F.arrays_overlap(m, F.array(*[F.lit(c) for c in classes]))
    rows = scene_values(pairs, keys, {
        "_max": (F.array_max(m), F.max), "_min": (F.array_min(m), F.min), "_land": (has(4, 6, 7), F.bool_or),
        "_bare": (has(5), F.bool_or), "_cloud": (has(8, 9, 10), F.bool_or)})
    test = ((F.col("_max") <= 11) & (F.col("_min") >= 0) & (F.col("_min") != F.col("_max"))
            & (F.col("_land") | (F.col("_bare") & F.col("_cloud"))))
    return rows.withColumn(out, test).drop("_max", "_min", "_land", "_bare", "_cloud")


def _orelse(df: DataFrame, name: str, default) -> Column:
    return F.col(name) if name in df.columns else default


def suppress(pairs: DataFrame, keys: Sequence[str], carry: Sequence[str] = ()) -> DataFrame:
    """Per-pixel probability after the false-alarm stages, and the final mask.

    Optional columns: qa1, qa2 (missing: all usable), sar1, sar2, offset_mag (0),
    view_ok (true), seasonal_delta (0.02), reg_conf (1).
    """
    none = F.lit(None).cast("array<double>")
    sar1, sar2 = _orelse(pairs, "sar1", none), _orelse(pairs, "sar2", none)
    masks = [n for n in ("1", "2") if f"qa{n}" in pairs.columns]
    arrays = ["prob", *[f"qa{n}" for n in masks]]
    encodings = [f"scl{n}" for n in masks]
    place = list(BLOCK) if is_blocked(pairs) else []
    pairs = _scene_sar(pairs, keys, sar1, sar2)
    for n in masks:
        pairs = _scene_encoding(pairs, keys, f"qa{n}", f"scl{n}")
    row = pairs.select(
        *keys, *carry, *place, "width", *arrays, *encodings,
        _orelse(pairs, "offset_mag", F.lit(0.0)).alias("offset_mag"),
        _orelse(pairs, "view_ok", F.lit(True)).alias("view_ok"),
        _orelse(pairs, "seasonal_delta", F.lit(0.02)).alias("seasonal_delta"),
        _orelse(pairs, "reg_conf", F.lit(1.0)).alias("reg_conf"),
        "sar_agreement", "sar_fused")
    factor = (F.when(F.col("offset_mag") > 2.5, 0.5).otherwise(1.0)
              * F.when(~F.col("view_ok") & ~F.col("sar_fused"), 0.2).otherwise(1.0)
              * F.when(F.abs("seasonal_delta") < 0.05, 0.8).otherwise(1.0)
              * F.when(~F.col("sar_fused"), 0.9).when(F.col("sar_agreement") < 0.2, 0.6).otherwise(1.0))
    scalars = ["seasonal_delta", "reg_conf", "sar_agreement", "sar_fused"]
    px = unroll(row.withColumn("_factor", factor), [*keys, *carry, *scalars, "_factor", *encodings], arrays)
    usable = F.lit(True)
    for n in masks:
        usable = usable & F.coalesce(decode_mixed(F.col(f"qa{n}"), F.col(f"scl{n}"))["usable"], F.lit(True))
    px = px.withColumn("usable", usable)
    p = F.when(F.col("usable"), F.col("prob") * F.col("_factor")).otherwise(F.lit(0.0))
    return px.select(*keys, *carry, *scalars, "y", "x", *arrays, "usable", p.alias("p"),
                     (p > MASK_THRESHOLD).alias("mask"))


def event_metrics(pixels: DataFrame, keys: Sequence[str], carry: Sequence[str] = ()) -> DataFrame:
    """One aggregate per pair: coverage, confidence, mask size and debug metrics."""
    cover = F.avg(F.col("usable").cast("double"))
    model = F.coalesce(F.avg(F.when(F.col("usable"), F.col("p"))), F.lit(0.0))
    seasonal, sar, reg = F.first("seasonal_delta"), F.first("sar_agreement"), F.first("reg_conf")
    conf = (model * WEIGHTS["model"] + cover * WEIGHTS["qa"] + F.coalesce(sar, F.lit(0.5)) * WEIGHTS["sar"]
            + F.greatest(F.lit(0.0), F.lit(1.0) - F.abs(seasonal)) * WEIGHTS["seasonal"]
            + reg * WEIGHTS["registration"])
    return pixels.groupBy(*keys, *carry).agg(
        F.avg("prob").alias("raw_change_prob"), cover.alias("qa_coverage"), model.alias("mean_prob"),
        sar.alias("sar_agreement"), F.first("sar_fused").alias("sar_fused"), seasonal.alias("seasonal_delta"),
        reg.alias("registration_confidence"), F.count_if("mask").alias("n_masked"), F.count("*").alias("n_pixels"),
        clip(conf, 0.0, 1.0).alias("confidence"))


def stages(sar_fused: Column) -> Column:
    """Suppression stages that ran, in order."""
    return F.filter(F.array(F.lit("qa"), F.lit("registration"), F.lit("seasonal"),
                            F.when(sar_fused, F.lit("sar")), F.lit("confidence")), lambda s: s.isNotNull())


def _pick(scores: Column, names: Sequence[str], default: str) -> Column:
    top = F.array_position(scores, F.array_max(scores))
    vocabulary = F.array(*[F.lit(n) for n in names])
    chosen = F.element_at(vocabulary, F.least(F.greatest(top, F.lit(1)), F.lit(len(names))).cast("int"))
    return F.when(F.size(scores) > 0, chosen).otherwise(F.lit(default))


def semantics_from_scores(n_masked: Column, morph_scores: Column, type_scores: Column) -> tuple[Column, Column]:
    """(change type, morphology) from score vectors; an empty mask is unknown/none."""
    empty = n_masked == 0
    kind = F.when(empty, "unknown").otherwise(_pick(type_scores, TYPE_CLASSES, "construction"))
    morph = F.when(empty, "none").otherwise(_pick(morph_scores, MORPHOLOGY_CLASSES, "appearance"))
    return kind, morph


def detect_change(pairs: DataFrame, keys: Sequence[str], bands: Sequence[str] = ("r", "g", "b"),
                  model=None, register: bool = True) -> tuple[DataFrame, DataFrame]:
    """(pixels, events) of a pair table, end to end.

    Registers the later bands to the earlier ones (one sub-pixel shift per
    scene; not with ``register=False``), checks viewing angles, aligns radiometry, scores, suppresses false
    alarms and classifies. Pair columns: bands ``b1``/``b2``, ``width``, and
    optionally qa1/qa2, sar1/sar2, view1/incidence1/view2/incidence2,
    seasonal_delta (0.02), morph_scores/type_scores, block numbers.

    ``model`` may add ``prob`` (an array like the bands), ``morph_scores`` and
    ``type_scores`` to the aligned pair table, whose later bands are ``ba``;
    without it the scaled band difference is the probability.
    """
    keys = list(keys)
    rows = registration.coregister_sub(pairs, bands, register, keys)
    angles = [_orelse(rows, c, F.lit(None).cast("double")) for c in ("view1", "incidence1", "view2", "incidence2")]
    rows = rows.withColumns({
        "offset_dy": F.col("shift.dy"), "offset_dx": F.col("shift.dx"), "reg_conf": F.col("shift.confidence"),
        "offset_mag": F.hypot("shift.dx", "shift.dy"), "view_ok": view_angle(*angles)[0]})
    rows = radiometry.radiometric_align(rows, keys, [(f"{b}1", f"{b}2a", f"{b}a") for b in bands])
    rows = model(rows) if model else raw_change_prob(rows, bands, after="a", keys=keys)
    scores = [c for c in ("morph_scores", "type_scores") if c in rows.columns]
    carry = ["offset_dy", "offset_dx", *scores]
    pixels = suppress(rows, keys, carry)
    events = event_metrics(pixels, keys, carry)
    empty = F.lit(None).cast("array<double>")
    kind, morph = semantics_from_scores(F.col("n_masked"), *[_orelse(events, c, empty) for c in ("morph_scores", "type_scores")])
    return pixels, events.withColumns({"change_type": kind, "change_morphology": morph, "stages": stages(F.col("sar_fused"))})


def _block_pairs(acquisitions: DataFrame, site: str, ts: str, own: Sequence[str]) -> DataFrame:
    """Blocks of each date of a site beside the same blocks of its next date.

    Dates are paired first, on one small row per date; blocks then meet by site,
    later date and place, so a busy site is spread over its dates and blocks. A
    block that only one of two dates has is compared with nothing.
    """
    dates = timeline.scene_pairs(acquisitions.select(site, ts).distinct(), site, ts, []).select(
        site, ts, F.col(f"next.{ts}").alias("_later"))
    before = acquisitions.select(site, ts, *BLOCK, "width", *[F.col(c).alias(f"{c}1") for c in own])
    after = acquisitions.select(site, F.col(ts).alias("_later"), *BLOCK, F.col("width").alias("_width"),
                                *[F.col(c).alias(f"{c}2") for c in own])
    paired = before.join(dates, [site, ts]).join(after, [site, "_later", *BLOCK])
    sides = F.format_string("block widths differ: %d and %d", F.col("width"), F.col("_width"))
    same = F.when(F.col("width") == F.col("_width"), F.col("width")).otherwise(F.raise_error(sides).cast("int"))
    # Written once: every figure of a scene reads the pairs again.
    return checkpoint(paired.withColumn("width", same).drop("_width"))


def detect_change_over_stack(acquisitions: DataFrame, site: str, ts: str, bands: Sequence[str] = ("r", "g", "b"),
                             model=None, register: bool = True, min_confidence: float = 0.70,
                             min_coverage: float = 0.75) -> tuple[DataFrame, DataFrame]:
    """(evidence, result): every acquisition of a site compared with the next one.

    ``acquisitions``: one row per site and date with one array per band,
    ``width``, and optionally qa, sar, view and incidence; or one row per site,
    date and block of a larger scene (block numbers as in ``operators.scenes``).
    ``evidence`` has one row per pair of dates, ``result`` the earliest
    supported date per site.
    """
    own = [c for c in (*bands, "qa", "sar", "view", "incidence") if c in acquisitions.columns]
    if is_blocked(acquisitions):
        pairs = _block_pairs(acquisitions, site, ts, own)
    else:
        paired = timeline.scene_pairs(acquisitions, site, ts, own)
        pairs = paired.select(site, ts, F.col(f"next.{ts}").alias("_later"), "width",
                              *[F.col(c).alias(f"{c}1") for c in own], *[F.col(f"next.{c}").alias(f"{c}2") for c in own])
    _, events = detect_change(pairs, [site, ts, "_later"], bands, model, register)
    scored = events.select(site, ts, F.struct(F.col("_later").alias(ts), "confidence", "qa_coverage").alias("next"))
    evidence = timeline.date_confidence(scored, site, ts, min_confidence, min_coverage)
    return evidence, timeline.earliest_supported(acquisitions, evidence, site)


def assemble(events: DataFrame, model_name: str = "difference-map", model_version: str = "1.0.0",
             weights_sha256: str = "0" * 64, code_sha: str = "unversioned") -> DataFrame:
    """Nested event records: STAC feature, provenance and debug metrics.

    Needs event_id, t1/t2 ids and datetimes, bbox (from tile metadata),
    change_type, change_morphology, mask_href, offsets, and the metrics.
    """
    lon0, lat0, lon1, lat1 = (F.element_at("bbox", i) for i in (1, 2, 3, 4))
    ring = F.array(F.array(lon0, lat0), F.array(lon1, lat0), F.array(lon1, lat1), F.array(lon0, lat1),
                   F.array(lon0, lat0))
    feature = F.struct(
        F.lit("Feature").alias("type"), F.lit("1.0.0").alias("stac_version"), F.col("event_id").alias("id"),
        F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"),
        F.col("bbox"),
        F.struct(F.col("t2_datetime").alias("datetime"), F.col("t1_datetime").alias("start_datetime"),
                 F.col("t2_datetime").alias("end_datetime"), F.col("change_type").alias("change:type"),
                 F.col("change_morphology").alias("change:morphology"), F.col("confidence").alias("change:confidence"),
                 F.lit(None).cast("string").alias("change:earliest_supported_date")).alias("properties"),
        F.array().cast("array<string>").alias("links"),
        F.struct(F.struct(F.col("mask_href").alias("href"),
                          F.lit("image/tiff; application=geotiff; profile=cloud-optimized").alias("type"),
                          F.array(F.lit("data"), F.lit("change-mask")).alias("roles")).alias("change_mask"))
        .alias("assets"))
    provenance = F.struct(
        F.lit(model_name).alias("model_name"), F.lit(model_version).alias("model_version"),
        F.lit(weights_sha256).alias("weights_sha256"), F.lit(code_sha).alias("code_git_sha"),
        F.col("t1_scene_id"), F.col("t2_scene_id"), F.lit("1.0.0").alias("qa_mask_version"), F.col("sar_fused"),
        stages(F.col("sar_fused")).alias("suppression_stages_fired"),
        F.lit("standardization").alias("radiometric_method"),
        F.array("offset_dx", "offset_dy").alias("registration_offset_px"),
        F.col("latency_ms").cast("int").alias("inference_latency_ms"))
    debug = F.struct("raw_change_prob", "qa_coverage", "sar_agreement", "seasonal_delta", "registration_confidence")
    return events.select(
        "event_id", F.col("mask_href").alias("change_mask"), "change_type", "change_morphology", "confidence",
        F.lit(None).cast("string").alias("earliest_supported_date"), F.col("bbox").alias("bbox_wgs84"),
        feature.alias("stac_change_event"), provenance.alias("provenance"), debug.alias("debug"))
