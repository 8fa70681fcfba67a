"""STAC metadata: item parsing, provider normalisation, catalogue search."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from scenelake.functions.mathx import bbox_centroid
from scenelake.functions.text import normalize_crs, normalize_platform
from scenelake.lookups import DEFAULT_BBOX, PROVIDERS, RASTER_EXTENSIONS

# Only the fields that are read; anything else in an item is ignored.
ITEM_SCHEMA = """
id string, bbox array<double>,
assets map<string, struct<`eo:platform`: string, `sar:platform`: string>>,
properties struct<
  datetime: string, acquisition_datetime: string, start_datetime: string,
  platform: string, constellation: string, `eo:platform`: string, `sar:platform`: string, sensor: string,
  instruments: array<string>,
  `sat:incidence_angle`: string, `view:incidence_angle`: string, incidence_angle: string,
  `sar:incidence_angle`: string,
  `view:off_nadir`: string, `view:sun_elevation`: string, view_angle: string,
  `sat:orbit_state`: string, `sat:relative_orbit`: string, orbit: string, orbit_state: string,
  `proj:epsg`: string, `proj:wkt2`: string, crs: string,
  `proj:transform`: array<double>, transform: array<double>>
"""


def _prop(name: str) -> Column:
    return F.col("item.properties")[name]


def _text(*names: str) -> Column:
    """First property that is present and not empty."""
    return F.coalesce(*[F.when(_prop(n) != "", _prop(n)) for n in names])


def _number(*names: str) -> Column:
    """First property that is present, not empty and not zero, as a number."""
    def kept(n: str) -> Column:
        value = _prop(n).try_cast("double")
        return F.when((_prop(n) != "") & ((value != 0.0) | value.isNull()), _prop(n))

    return F.coalesce(*[kept(n) for n in names]).try_cast("double")


def parse_items(raw: DataFrame, json: str = "json", keep: Sequence[str] = ()) -> DataFrame:
    """JSON item texts to flat scene metadata."""
    parsed = raw.select(*keep, F.from_json(F.col(json), ITEM_SCHEMA).alias("item"))
    assets = F.map_values(F.col("item.assets"))
    named = F.filter(F.transform(assets, lambda a: F.coalesce(
        F.when(a["eo:platform"] != "", a["eo:platform"]), F.when(a["sar:platform"] != "", a["sar:platform"]))),
        lambda p: p.isNotNull())
    from_assets = F.when(F.size(named) > 0, F.get(named, F.lit(0)))
    first_instrument = F.when(F.size(_prop("instruments")) > 0, F.get(_prop("instruments"), F.lit(0)))
    platform = F.coalesce(
        _text("platform", "constellation", "eo:platform", "sar:platform", "sensor"), from_assets,
        F.when(first_instrument != "", first_instrument), F.lit("unknown"))
    return parsed.select(
        *keep, F.coalesce("item.id", F.lit("unknown_item")).alias("id"),
        _text("datetime", "acquisition_datetime", "start_datetime").alias("datetime"),
        normalize_platform(platform).alias("platform"),
        _number("sat:incidence_angle", "view:incidence_angle", "incidence_angle", "sar:incidence_angle")
        .alias("incidence_angle"),
        _number("view:off_nadir", "view:sun_elevation", "view_angle").alias("view_angle"),
        F.coalesce(*[F.when((_prop(n) != "") & (_prop(n) != "0"), _prop(n))
                     for n in ("sat:orbit_state", "sat:relative_orbit", "orbit", "orbit_state")]).alias("orbit"),
        normalize_crs(_text("proj:epsg", "proj:wkt2", "crs")).alias("crs"),
        F.coalesce(_prop("proj:transform"), _prop("transform")).alias("transform"),
        F.coalesce("item.bbox", F.array(*[F.lit(0.0)] * 4)).alias("bbox"))


def read_items(spark, path: str) -> DataFrame:
    """One item per JSON file (or per line when the files hold lines of items)."""
    return parse_items(spark.read.text(path, wholetext=True).withColumnRenamed("value", "json"))


PAYLOAD_SCHEMA = """
id string, datetime string, bbox array<double>, cloud_cover double, bands array<string>, orbit string, epsg int,
visual_href string, nir_href string, assets map<string, map<string, string>>
"""


def provider_table(spark) -> DataFrame:
    rows = [(s, p[0], p[1], p[2], p[3], p[4], p[5]) for s, p in PROVIDERS.items()]
    return spark.createDataFrame(rows, "source string, platform string, instrument string, gsd_meters double, "
                                       "default_cloud double, default_bands array<string>, processing_level string")


def ingest(payloads: DataFrame, json: str = "payload", source: str = "source", keep: Sequence[str] = ()
           ) -> tuple[DataFrame, DataFrame]:
    """Normalise provider payloads: (scenes, quarantine of unknown sources).

    Payloads must carry their own id and time; rows without keep NULL there.
    The provider table has four fixed rows.
    """
    providers = F.broadcast(provider_table(payloads.sparkSession).withColumnRenamed("source", source))
    quarantine = payloads.join(providers, source, "left_anti")
    p = F.from_json(F.col(json), PAYLOAD_SCHEMA)
    rows = payloads.withColumn("p", p).join(providers, source)
    rows = rows.withColumn("bbox", F.coalesce("p.bbox", F.array(*[F.lit(v) for v in DEFAULT_BBOX])))
    lat, lon = bbox_centroid(F.col("bbox"))
    text_map = "map<string, map<string, string>>"
    default_assets = F.when(F.col(source) == "Sentinel-2", F.create_map(
        F.lit("visual"), F.create_map(F.lit("href"), F.coalesce("p.visual_href", F.lit("")), F.lit("type"),
                                      F.lit("image/tiff; application=geotiff; profile=cloud-optimized")),
        F.lit("nir"), F.create_map(F.lit("href"), F.coalesce("p.nir_href", F.lit("")), F.lit("type"),
                                   F.lit("image/tiff; application=geotiff")))).otherwise(F.create_map().cast(text_map))
    s2 = F.col(source) == "Sentinel-2"
    scenes = rows.select(
        *keep, source, F.col("p.id").alias("id"), "platform", "instrument",
        F.col("p.datetime").alias("datetime_acquired"), "bbox",
        F.struct(lat.alias("lat"), lon.alias("lon")).alias("centroid"),
        F.when(F.col("default_cloud").isNull(), F.lit(0.0)).otherwise(F.coalesce("p.cloud_cover", "default_cloud"))
        .alias("cloud_cover"), "gsd_meters", F.coalesce("p.bands", "default_bands").alias("bands"),
        "processing_level", F.when(s2, F.coalesce("p.orbit", F.lit("descending"))).alias("orbit_direction"),
        F.when(s2, F.coalesce("p.epsg", F.lit(4326))).alias("epsg"),
        F.coalesce("p.assets", default_assets).alias("assets"))
    return scenes, quarantine


def has_raster_extension(path: Column) -> Column:
    text = F.lower(path)
    test = F.lit(False)
    for ext in RASTER_EXTENSIONS:
        test = test | text.endswith(ext)
    return test


def catalog_search(scenes: DataFrame, bbox: Sequence[float], start: str, end: str, max_cloud: float = 30.0
                   ) -> DataFrame:
    """Scenes that intersect a box, fall between two dates and are clear enough.

    The three predicates are plain comparisons, so a scene table written with
    min_lon..max_lat columns prunes files by their statistics.
    """
    west, south, east, north = (F.lit(float(v)) for v in bbox)
    return scenes.where(
        (F.col("min_lon") <= east) & (F.col("max_lon") >= west) & (F.col("min_lat") <= north)
        & (F.col("max_lat") >= south) & F.col("acquired").between(F.to_date(F.lit(start)), F.to_date(F.lit(end)))
        & (F.col("cloud_cover") <= max_cloud))
