"""Per-pixel and per-tile queries over flat pixels and scene pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import views as v
from checks.registry import check, half_even
from scenelake.functions import qa, spectral
from scenelake.lookups import QA_BITS, REPORT_CATEGORIES
from scenelake.operators import radiometry
from scenelake.operators.blocks import bitemporal_join, pyramid, roll_up, unroll
from scenelake.operators.ranks import grouped_cdf
from scenelake.plans import change_event as ce, rgb_report as rgb
from scenelake.sources import rasters
from scenelake.sources.rasters import scale_reflectance

IDS = "tile okey line".split()

# ---- flat pixels -----------------------------------------------------------

ND = "(({a} - {b}) / ({a} + {b} + 1e-8))"


def _bounded(a: str, b: str) -> str:
    return f"greatest(-1.0, least(1.0, CASE WHEN {a} + {b} <> 0 THEN {ND.format(a=a, b=b)} ELSE 0.0 END))"


@check("ndvi", "tile:l okey:l line:l ndvi:6", f"SELECT *, {_bounded('nir', 'red')} AS ndvi FROM pixel_flat", v.PIXEL_FLAT)
def _(s, sf):
    return v.pixel_flat(s, sf).withColumn("ndvi", spectral.ndvi(F.col("nir"), F.col("red")))


@check("ndwi", "tile:l okey:l line:l ndwi:6", f"SELECT *, {_bounded('green', 'nir')} AS ndwi FROM pixel_flat", v.PIXEL_FLAT)
def _(s, sf):
    return v.pixel_flat(s, sf).withColumn("ndwi", spectral.ndwi(F.col("green"), F.col("nir")))


@check("spectral_indices", "tile:l okey:l line:l ndvi:6 ndwi:6", """
SELECT *, CASE WHEN n >= 3 THEN (i - red) / (i + red + 1e-6) ELSE 0.0 END AS ndvi,
       CASE WHEN n >= 3 THEN (green - i) / (green + i + 1e-6) ELSE 0.0 END AS ndwi
FROM (SELECT *, line % 4 + 1 AS n, CASE WHEN line % 4 + 1 >= 4 THEN nir ELSE blue END AS i FROM pixel_flat)""", v.PIXEL_FLAT)
def _(s, sf):
    veg, water = spectral.band_indices(F.col("line") % 4 + 1, F.col("red"), F.col("green"), F.col("blue"), F.col("nir"))
    return v.pixel_flat(s, sf).withColumn("ndvi", veg).withColumn("ndwi", water)


@check("cloud_mask_rgb", "tile:l okey:l line:l cloud:b", """
SELECT *, (red + green + blue) / 3.0 > 0.78 AND greatest(red, green, blue) - least(red, green, blue) < 0.12 AS cloud
FROM pixel_flat""", v.PIXEL_FLAT)
def _(s, sf):
    return v.pixel_flat(s, sf).withColumn("cloud", spectral.is_cloud_rgb(F.col("red"), F.col("green"), F.col("blue")))


@check("cloud_mask_scl", "tile:l okey:l line:l cloud:b", "SELECT *, scl IN (3, 8, 9, 10) AS cloud FROM pixel_flat", v.PIXEL_FLAT)
def _(s, sf):
    return v.pixel_flat(s, sf).withColumn("cloud", spectral.is_cloud_scl(F.col("scl")))


FLAG_SPEC = " ".join(f"{f}:b" for f in qa.FLAGS)
BAD = " OR ".join(f"((qa & {QA_BITS[f]}) > 0)" for f in ("cloud", "cloud_shadow", "snow", "haze", "saturated", "cirrus"))
BITS_SQL = ", ".join(f"(qa & {bit}) > 0 AS {f}" for f, bit in QA_BITS.items()) + f", ((qa & 1) > 0) AND NOT ({BAD}) AS usable"
SCL_SQL = ("scl <> 0 AS valid_data, scl IN (8, 9) AS cloud, scl = 3 AS cloud_shadow, scl = 11 AS snow, false AS haze, "
           "scl = 6 AS water, scl = 1 AS saturated, scl = 10 AS cirrus, scl IN (2, 4, 5, 6, 7) AS usable")


@check("qa_decode_bits", f"tile:l okey:l line:l qa:l {FLAG_SPEC}", f"SELECT tile, okey, line, qa, {BITS_SQL} FROM pixel_flat", v.PIXEL_FLAT)
def _(s, sf):
    return v.pixel_flat(s, sf).withColumns(qa.decode_bits(F.col("qa")))


@check("qa_decode_scl", f"tile:l okey:l line:l scl:l {FLAG_SPEC}", f"SELECT tile, okey, line, scl, {SCL_SQL} FROM pixel_flat", v.PIXEL_FLAT)
def _(s, sf):
    return v.pixel_flat(s, sf).withColumns(qa.decode_scl(F.col("scl")))


@check("bitflags", "tile:l okey:l line:l flags:l", "SELECT *, (qa & 6) AS flags FROM pixel_flat", v.PIXEL_FLAT)
def _(s, sf):
    return v.pixel_flat(s, sf).withColumn("flags", F.col("qa").bitwiseAND(F.lit(6)))


@check("qa_summary", "tile:l valid:6 cloud:6 shadow:6 usable:6", f"""
SELECT tile, avg(CAST(valid_data AS INTEGER)) AS valid, avg(CAST(cloud AS INTEGER)) AS cloud,
       avg(CAST(cloud_shadow AS INTEGER)) AS shadow, avg(CAST(usable AS INTEGER)) AS usable
FROM (SELECT tile, {BITS_SQL} FROM pixel_flat) GROUP BY tile""", v.PIXEL_FLAT)
def _(s, sf):
    return v.pixel_flat(s, sf).withColumns(qa.decode_bits(F.col("qa"))).groupBy("tile").agg(*qa.qa_summary())


# Tiles alternate between both encodings, so that the test has something to find.
MIXED = ", mixed AS (SELECT tile, CASE WHEN tile % 2 = 0 THEN qa ELSE scl END AS m FROM pixel_flat)"


@check("qa_encoding_detect", "tile:l is_scl:b", """
SELECT tile, max(m) <= 11 AND min(m) >= 0 AND count(DISTINCT m) >= 2
       AND (bool_or(m IN (4, 6, 7)) OR (bool_or(m = 5) AND bool_or(m IN (8, 9, 10)))) AS is_scl
FROM mixed GROUP BY tile""", v.PIXEL_FLAT + MIXED)
def _(s, sf):
    px = v.pixel_flat(s, sf).withColumn("m", F.when(F.col("tile") % 2 == 0, F.col("qa")).otherwise(F.col("scl")))
    return ce.qa_encoding(px, ["tile"], "m")


@check("cloud_pct", "tile:l cloud_pct:6",
       "SELECT tile, avg(CASE WHEN scl IN (3, 8, 9, 10) THEN 1.0 ELSE 0.0 END) * 100.0 AS cloud_pct FROM pixel_flat GROUP BY tile",
       v.PIXEL_FLAT)
def _(s, sf):
    return v.pixel_flat(s, sf).groupBy("tile").agg(
        (F.avg(spectral.is_cloud_scl(F.col("scl")).cast("double")) * 100.0).alias("cloud_pct"))


STATS_SQL = """
vals AS (SELECT tile, unnest([red, green, nir]) AS v FROM pixel_flat),
ext AS (SELECT tile, min(v) AS lo, max(v) AS hi FROM vals GROUP BY tile),
stats AS (SELECT vals.tile, count(*) AS n, stddev_pop(v) AS std, min(v) AS v_min, max(v) AS v_max,
       avg(CASE WHEN v = lo THEN 1.0 ELSE 0.0 END) AS share_min, avg(CASE WHEN v = hi THEN 1.0 ELSE 0.0 END) AS share_max
FROM vals JOIN ext USING (tile) GROUP BY vals.tile)
"""


@check("tile_stats", "tile:l n:l std:6 v_min:6 v_max:6 share_min:6 share_max:6", "SELECT * FROM stats",
       v.PIXEL_FLAT + "," + STATS_SQL)
def _(s, sf):
    return radiometry.tile_stats(v.pixel_flat(s, sf), ["tile"], ["red", "green", "nir"])


@check("tile_valid", "tile:l is_valid:b", """
SELECT tile, std >= CASE WHEN v_max <= 1.0 THEN 78.5 / 255.0 ELSE 78.5 END AND share_min <= 0.03 AND share_max <= 0.95
       AS is_valid FROM stats""", v.PIXEL_FLAT + "," + STATS_SQL)
def _(s, sf):
    st = radiometry.tile_stats(v.pixel_flat(s, sf), ["tile"], ["red", "green", "nir"])
    lo = radiometry.is_valid_tile(F.col("std"), F.col("v_max"), F.col("share_min"), F.lit(0.0), 78.5, 0.03)
    hi = radiometry.is_valid_tile(F.col("std"), F.col("v_max"), F.lit(0.0), F.col("share_max"), 78.5, 0.95)
    return st.withColumn("is_valid", lo & hi)


@check("percentile_stretch", "tile:l okey:l line:l dn:2 stretched:6", """
SELECT *, CASE WHEN hi > lo THEN greatest(0.0, least(1.0, (dn - lo) / (hi - lo))) ELSE 0.0 END AS stretched
FROM pixel_flat JOIN (SELECT tile, quantile_cont(dn, 0.02) AS lo, quantile_cont(dn, 0.98) AS hi FROM pixel_flat GROUP BY tile)
USING (tile)""", v.PIXEL_FLAT)
def _(s, sf):
    return radiometry.percentile_stretch(v.pixel_flat(s, sf), ["tile"], "dn")


@check("scale_reflectance", "tile:l okey:l line:l reflectance:6", "SELECT *, dn / 10000.0 AS reflectance FROM pixel_flat", v.PIXEL_FLAT)
def _(s, sf):
    return v.pixel_flat(s, sf).withColumn("reflectance", scale_reflectance(F.col("dn")))


@check("cdf", "tile:l green:6 n:l q:6", """
SELECT tile, green, n, sum(n) OVER (PARTITION BY tile ORDER BY green) / sum(n) OVER (PARTITION BY tile) AS q
FROM (SELECT tile, green, count(*) AS n FROM pixel_flat GROUP BY tile, green)""", v.PIXEL_FLAT)
def _(s, sf):
    return grouped_cdf(v.pixel_flat(s, sf), ["tile"], "green")


@check("histogram_match", "tile:l okey:l line:l green:6 matched:6", """
SELECT p.tile, okey, line, p.green, matched FROM pixel_flat p JOIN mapping m ON p.tile = m.tile AND p.green = m.v""",
       v.PIXEL_FLAT + """,
sc AS (SELECT tile, v, sum(n) OVER (PARTITION BY tile ORDER BY v) / sum(n) OVER (PARTITION BY tile) AS q
       FROM (SELECT tile, green AS v, count(*) AS n FROM pixel_flat GROUP BY tile, green)),
rc AS (SELECT tile, v, sum(n) OVER (PARTITION BY tile ORDER BY v) / sum(n) OVER (PARTITION BY tile) AS q
       FROM (SELECT tile, dn / 1e5 AS v, count(*) AS n FROM pixel_flat GROUP BY tile, dn / 1e5)),
br AS (SELECT sc.tile, sc.v, sc.q, max(CASE WHEN rc.q <= sc.q THEN rc.q END) AS q0, min(CASE WHEN rc.q >= sc.q THEN rc.q END) AS q1
       FROM sc JOIN rc USING (tile) GROUP BY sc.tile, sc.v, sc.q),
mapping AS (SELECT br.tile, br.v, CASE WHEN a.v IS NULL THEN b.v WHEN b.v IS NULL THEN a.v WHEN q1 = q0 THEN a.v
       ELSE a.v + (b.v - a.v) * (br.q - q0) / (q1 - q0) END AS matched
       FROM br LEFT JOIN rc a ON a.tile = br.tile AND a.q = q0 LEFT JOIN rc b ON b.tile = br.tile AND b.q = q1)""")
def _(s, sf):
    px = v.pixel_flat(s, sf)
    ref = px.select("tile", (F.col("dn") / 1e5).alias("green"))
    return radiometry.histogram_match(px, ref, ["tile"], "green")


# ---- scene pairs -----------------------------------------------------------


def _changes(s, sf, **kw):
    return rgb.change_pixels(v.pairs(s, sf), ["scene"], register=False, **kw)


CLOUD = "({r} + {g} + {b}) / 3.0 > 0.78 AND greatest({r}, {g}, {b}) - least({r}, {g}, {b}) < 0.12"
CHANGE_PX = v.PAIR_PX + f""",
ev0 AS (SELECT *, {CLOUD.format(r='r1', g='g1', b='b1')} AS cloud1, {CLOUD.format(r='r2', g='g2', b='b2')} AS cloud2,
  sqrt((r2 - r1) * (r2 - r1) + (g2 - g1) * (g2 - g1) + (b2 - b1) * (b2 - b1)) AS raw,
  (g2 - r2) / (g2 + r2 + 1e-6) - (g1 - r1) / (g1 + r1 + 1e-6) AS delta_veg,
  (b2 - r2) / (b2 + r2 + 1e-6) - (b1 - r1) / (b1 + r1 + 1e-6) AS delta_water,
  (r2 + g2 + b2) / 3.0 AS brightness2 FROM pair_px),
ev1 AS (SELECT *, CASE WHEN cloud1 OR cloud2 THEN 0.0 ELSE raw END AS distance FROM ev0),
ev AS (SELECT *, distance > 0.22 AS changed FROM ev1)"""


@check("bitemporal_join", "scene:l y:l x:l r1:6 g1:6 b1:6 r2:6 g2:6 b2:6", "SELECT * FROM pair_px", v.PAIR_PX)
def _(s, sf):
    pairs = bitemporal_join(v.epoch_blocks(s, sf, 0), v.epoch_blocks(s, sf, 1), ["scene"], ["r", "g", "b"])
    return unroll(pairs, ["scene"], [f"{b}{n}" for n in (1, 2) for b in "rgb"])


@check("pseudo_index_delta", "scene:l y:l x:l delta_veg:6 delta_water:6", "SELECT * FROM ev", CHANGE_PX)
def _(s, sf):
    return _changes(s, sf)


@check("spectral_distance", "scene:l y:l x:l distance:6", "SELECT * FROM ev", CHANGE_PX)
def _(s, sf):
    return _changes(s, sf)


@check("mask_union", "scene:l y:l x:l clear:b", "SELECT *, NOT (cloud1 OR cloud2) AS clear FROM ev", CHANGE_PX)
def _(s, sf):
    return _changes(s, sf).withColumn("clear", ~(F.col("cloud1") | F.col("cloud2")))


@check("change_binary", "scene:l y:l x:l changed:b", "SELECT * FROM ev", CHANGE_PX)
def _(s, sf):
    return _changes(s, sf)


# Scene months vary, so that some scenes are filtered and some are not.
PHENO = CHANGE_PX + """,
ph AS (SELECT * EXCLUDE (changed), distance > 0.22 AND NOT (abs(scene % 12 - (scene * 5) % 12) > 2 AND delta_veg > -0.12 AND delta_veg < 0.0)
       AS changed FROM ev)"""


def _dates():
    month = lambda c: F.concat(F.lit("2024-"), F.lpad((c + 1).cast("string"), 2, "0"), F.lit("-05"))
    return month(F.col("scene") % 12), month((F.col("scene") * 5) % 12)


@check("phenology_suppress", "scene:l y:l x:l changed:b", "SELECT * FROM ph", PHENO)
def _(s, sf):
    before, after = _dates()
    return _changes(s, sf, before=before, after=after)


SUMMARY = """
SELECT scene, count(*) AS n_pixels, count_if(changed) AS n_changed,
  """ + half_even('count_if(changed) / count(*) * 100.0', 2) + """ AS change_ratio_pct,
  """ + half_even('count_if(changed) * 0.01::DOUBLE', 2) + """ AS area_ha, """ + half_even('count_if(changed) * 100.0', 2) + """ AS area_sq_m,
  coalesce(avg(CASE WHEN changed THEN delta_veg END), 0.0) AS mean_delta_veg,
  coalesce(avg(CASE WHEN changed THEN delta_water END), 0.0) AS mean_delta_water,
  coalesce(avg(CASE WHEN changed THEN brightness2 END), 0.0) AS mean_brightness2,
  CASE WHEN count_if(changed) = 0 THEN 0.95 WHEN count_if(changed) = count(*) THEN NULL
       ELSE greatest(0.72, least(0.96, 1.0 / (1.0 + exp(-0.8 * (avg(CASE WHEN changed THEN distance END)
            / (avg(CASE WHEN NOT changed THEN distance END) + 1e-6) - 1.5))))) END AS confidence
FROM {src} GROUP BY scene"""
STD = """
SELECT scene, coalesce(stddev_pop(c), 0.0) AS std_changed FROM (SELECT scene, unnest([r2, g2, b2]) AS c, changed FROM {src}) WHERE changed GROUP BY scene"""
CLASSED = """
rep0 AS ({summary}), sd AS ({std}),
rep AS (SELECT rep0.*, coalesce(std_changed, 0.0) AS std_changed,
  CASE WHEN mean_delta_water > 0.18 THEN 'flood' WHEN mean_delta_veg < -0.15 THEN 'vegetation'
       WHEN mean_brightness2 > 0.40 AND mean_delta_veg < -0.05 THEN 'construction'
       WHEN mean_brightness2 < 0.25 AND coalesce(std_changed, 0.0) > 0.10 THEN 'solar' ELSE 'other' END AS category
  FROM rep0 LEFT JOIN sd USING (scene))"""
REP = CHANGE_PX + "," + CLASSED.format(summary=SUMMARY.format(src="ev"), std=STD.format(src="ev"))
REP_PH = PHENO + "," + CLASSED.format(summary=SUMMARY.format(src="ph"), std=STD.format(src="ph"))


def _report(s, sf):
    return rgb.classify(rgb.change_summary(_changes(s, sf), ["scene"]))


@check("change_area", "scene:l n_pixels:l n_changed:l change_ratio_pct:2 area_ha:2 area_sq_m:2", "SELECT * FROM rep", REP)
def _(s, sf):
    return _report(s, sf)


@check("masked_means", "scene:l mean_delta_veg:6 mean_delta_water:6 mean_brightness2:6 std_changed:6", "SELECT * FROM rep", REP)
def _(s, sf):
    return _report(s, sf)


@check("snr_confidence", "scene:l confidence:6", "SELECT * FROM rep", REP)
def _(s, sf):
    return _report(s, sf)


@check("change_classify", "scene:l category:s", "SELECT * FROM rep", REP)
def _(s, sf):
    return _report(s, sf)


def _case(field: int) -> str:
    arms = " ".join(f"WHEN '{code}' THEN " + (f"'{row[field]}'" if isinstance(row[field], str) else str(row[field]))
                    for code, row in REPORT_CATEGORIES.items())
    return f"CASE category {arms} END"


@check("change_report", "scene:l change_type:s label:s confidence_score:2 area_ha:2 area_sq_m:2 change_ratio_pct:2 mean_delta_veg:6 "
       "mean_delta_water:6", f"SELECT *, {_case(0)} AS change_type, {_case(1)} AS label, confidence AS confidence_score FROM rep", REP_PH)
def _(s, sf):
    before, after = _dates()
    return rgb.change_report(v.pairs(s, sf), ["scene"], before=before, after=after, register=False)


@check("change_report_registered", "scene:l change_type:s confidence_score:2 area_ha:2 n_changed:l")
def _(s, sf):
    before, after = _dates()
    return rgb.change_report(v.pairs(s, sf), ["scene"], before=before, after=after)


@check("mask_rgba", "scene:l y:l x:l R:l G:l B:l A:l",
       "SELECT scene, y, x, " + ", ".join(f"CASE WHEN changed THEN {_case(i)} ELSE 0 END AS {c}" for c, i in zip("RGBA", (2, 3, 4, 5)))
       + " FROM ev JOIN rep USING (scene)", REP)
def _(s, sf):
    return rgb.mask_rgba(_changes(s, sf), _report(s, sf), ["scene"])


@check("heatmap_rgba", "scene:l y:l x:l R:l G:l B:l A:l", """
SELECT scene, y, x, floor(d * 255) AS R, floor((1.0 - abs(d - 0.5) * 2) * 200) AS G, floor((1.0 - d) * 255) AS B, floor(d * 190) AS A
FROM (SELECT ev.scene, y, x, greatest(0.0, least(1.0, distance / (p + 1e-6))) AS d
      FROM ev JOIN (SELECT scene, quantile_cont(distance, 0.99) AS p FROM ev GROUP BY scene) USING (scene))""", CHANGE_PX)
def _(s, sf):
    return rgb.heatmap_rgba(_changes(s, sf), ["scene"])


@check("pyramid", "scene:l level:l y:l x:l distance:6", """
SELECT scene, level, y >> level AS y, x >> level AS x, avg(distance) AS distance
FROM (SELECT *, unnest([1, 2, 3, 4]) AS level FROM ev) GROUP BY ALL""", CHANGE_PX)
def _(s, sf):
    return pyramid(_changes(s, sf), ["scene"], "distance")


# The stored mask and its overviews, read back from disk.
@check("mask_sink", "tile_id:l level:l y:l x:l mask:6", """
SELECT scene AS tile_id, level, y >> level AS y, x >> level AS x, avg(CASE WHEN changed THEN 1.0 ELSE 0.0 END) AS mask
FROM (SELECT *, unnest([0, 1, 2, 3, 4]) AS level FROM ev) GROUP BY ALL""", CHANGE_PX)
def _(s, sf):
    from uuid import uuid4
    from scenelake.session import ensure_checkpoint_dir
    path = f"{ensure_checkpoint_dir(s)}/mask-{uuid4().hex}"
    px = _changes(s, sf).select(F.col("scene").alias("tile_id"), "y", "x", F.col("changed").cast("double").alias("mask"))
    blocks = roll_up(px, ["tile_id"], ["mask"]).withColumns(
        {"block_row": F.lit(0), "block_col": F.lit(0), "block_size": F.lit(v.SCENE_WIDTH)})
    rasters.write_mask(blocks, path, min_size=8)
    return rasters.read_mask(s, path)


ALIGN = v.PAIR_PX + ", " + ", ".join(f"""
st_{b} AS (SELECT scene, avg({b}1) AS m1, stddev_pop({b}1) AS s1, avg({b}2) AS m2, stddev_pop({b}2) AS s2 FROM pair_px GROUP BY scene)"""
                                     for b in "rgb") + """,
al AS (SELECT p.scene, y, x, r1, g1, b1, """ + ", ".join(
    f"CASE WHEN {b}.s1 > 1e-4 AND {b}.s2 > 1e-4 THEN (({b}2 - {b}.m2) / {b}.s2) * {b}.s1 + {b}.m1 ELSE {b}2 END AS {b}a" for b in "rgb"
).replace("r.", "st_r.").replace("g.", "st_g.").replace("b.", "st_b.") + """
  FROM pair_px p JOIN st_r ON p.scene = st_r.scene JOIN st_g ON p.scene = st_g.scene JOIN st_b ON p.scene = st_b.scene)"""


def aligned(pairs):
    return radiometry.radiometric_align(pairs, ["scene"], [(f"{b}1", f"{b}2", f"{b}a") for b in "rgb"])


@check("radiometric_align", "scene:l y:l x:l ra:6 ga:6 ba:6", "SELECT * FROM al", ALIGN)
def _(s, sf):
    return unroll(aligned(v.pairs(s, sf)), ["scene"], ["ra", "ga", "ba"])


SIX = [f"{b}{e}" for b in "rgb" for e in (1, 2)]


@check("domain_standardize", "scene:l y:l x:l " + " ".join(f"{c}_adapted:6" for c in SIX), "SELECT p.scene, y, x, " + ", ".join(
    f"greatest(0.0, least(1.0, CASE WHEN s_{c} > 1e-6 THEN ({c} - m_{c}) / s_{c} * 0.10 + 0.15 ELSE {c} END)) AS {c}_adapted" for c in SIX)
    + " FROM pair_px p JOIN (SELECT scene, " + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in SIX)
    + " FROM pair_px GROUP BY scene) t ON p.scene = t.scene", v.PAIR_PX)
def _(s, sf):
    rows = radiometry.domain_standardize(v.pairs(s, sf), ["scene"], SIX, [f"{c}_adapted" for c in SIX])
    return unroll(rows, ["scene"], [f"{c}_adapted" for c in SIX])


PROB = ALIGN + """,
df AS (SELECT scene, y, x, (abs(ra - r1) + abs(ga - g1) + abs(ba - b1)) / 3.0 AS d FROM al),
pr AS (SELECT df.scene, y, x, CASE WHEN top > 1e-4 THEN greatest(0.0, least(1.0, d / top)) ELSE 0.0 END AS prob
       FROM df JOIN (SELECT scene, max(d) AS top FROM df GROUP BY scene) t ON df.scene = t.scene)"""


def scored(s, sf):
    return ce.raw_change_prob(aligned(v.pairs(s, sf)), ["r", "g", "b"], after="a")


@check("raw_change_prob", "scene:l y:l x:l prob:6", "SELECT * FROM pr", PROB)
def _(s, sf):
    return unroll(scored(s, sf), ["scene"], ["prob"])
