"""Natural-language search: parse, gate, retrieve, re-rank.

Everything works on a table of queries; one job answers all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from scenelake.functions.labels import relevance_pct
from scenelake.functions.mathx import clip, round_to
from scenelake.functions.text import WORD, hyphenated_words, title_case, years
from scenelake.lookups import (INDEXED_AREAS, PLACE_PREPOSITIONS, PLACE_STOPWORDS, TAXONOMY, TILE_PROFILES,
                               UNINDEXED_PLACES)
from scenelake.operators.components import spread_lookup
from scenelake.operators.phrases import ANYWHERE, TOKEN, WORDS, first_by, phrase_hits
from scenelake.operators.vectors import embedder, vector_topk


ENTRY = ("phrase string, how string, ordinal int, aoi string, aoi_name string, place string, category string")


def phrase_table(spark, areas=INDEXED_AREAS, places=UNINDEXED_PLACES, taxonomy=TAXONOMY) -> DataFrame:
    """The gazetteer and the taxonomy as one table of phrases (``ENTRY``).

    Rows with ``aoi`` name an indexed area, rows with ``place`` a place without
    imagery, rows with ``category`` a change category; ``ordinal`` decides which
    name comes first. Any table of this form may take its place.
    """
    aliases = [(alias, key, name) for key, name, _, _, names in areas for alias in names]
    rows = [(alias, WORDS, i, key, name, None, None) for i, (alias, key, name) in enumerate(aliases)]
    rows += [(alias, WORDS, i, None, None, name, None) for i, (alias, name) in enumerate(places)]
    rows += [(k, ANYWHERE if " " in k else TOKEN, 0, None, None, None, c) for c, keywords in taxonomy.items() for k in keywords]
    return spark.createDataFrame(rows, ENTRY)


def match_phrases(queries: DataFrame, text: str, phrases: DataFrame) -> DataFrame:
    """Per distinct text with a hit: first indexed area (aoi, aoi_name, alias), first known place, sorted categories."""
    area = F.when(F.col("aoi").isNotNull(), F.struct("aoi", "aoi_name", F.col("phrase").alias("alias")))
    return phrase_hits(queries, text, phrases).groupBy(text).agg(
        first_by(area, "ordinal").alias("area"), first_by(F.col("place"), "ordinal").alias("place"),
        F.array_sort(F.collect_set("category")).alias("categories"))


def place_heuristic(text: Column, strict: bool = False) -> Column:
    """One or two words after a place preposition, title-cased; NULL when none or a stop word.

    ``strict`` accepts capitalised words only, so that "near rivers" is no place.
    """
    word = r"[A-Z][A-Za-z\-]*" if strict else r"[A-Za-z\-]+"
    preps = "|".join(PLACE_PREPOSITIONS)
    pattern = rf"(?:^|[^{WORD}])(?i:{preps})\s+({word}(?:\s+{word})?)"
    found = F.regexp_extract(text, pattern, 1)
    return F.when((found != "") & ~F.lower(found).isin(PLACE_STOPWORDS), title_case(found))


def parse_queries(queries: DataFrame, text: str = "query", strict_places: bool = False, phrases: DataFrame | None = None
                  ) -> DataFrame:
    """Add keywords, years, change types, place, AOI and whether imagery exists.

    Names and keywords come from ``phrases`` (by default ``phrase_table``); every
    distinct text is searched once.
    """
    kept = queries.columns
    matched = match_phrases(queries, text, phrase_table(queries.sparkSession) if phrases is None else phrases)
    matched = matched.select(text, F.col("area").alias("_area"), F.col("place").alias("_known"), F.col("categories").alias("_categories"))
    df = spread_lookup(queries, matched, [text], "left").withColumn("_clean", F.trim(F.col(text)))
    clean = F.col("_clean")
    none = F.array().cast("array<string>")
    # One generated row per query: the optimizer cannot copy the parse into a
    # later filter on its outcome, so the patterns run once.
    parse = F.struct(
        hyphenated_words(clean).alias("keywords"), years(clean).alias("years"), F.coalesce("_categories", none).alias("change_types"),
        F.col("_area"), F.coalesce(F.col("_known"), place_heuristic(clean, strict_places)).alias("_place"))
    df = df.select(*kept, F.inline_outer(F.array(parse)))
    other = F.when(F.col("_area").isNull(), F.col("_place"))
    return (df.withColumn("aoi", F.col("_area.aoi")).withColumn("aoi_name", F.col("_area.aoi_name"))
            .withColumn("requested_location", F.coalesce(title_case(F.col("_area.alias")), other))
            .withColumn("is_supported", other.isNull()).drop("_area", "_place"))


def coverage_gate(parsed: DataFrame) -> DataFrame:
    """Coverage state, message and the list of indexed areas per parsed query."""
    where = F.coalesce("aoi_name", "requested_location", F.lit("Indexed Catalogs"))
    message = F.concat(F.lit("Satellite imagery for '"), F.col("requested_location"),
                       F.lit("' is not currently available in the local indexed catalog."))
    return (parsed.withColumn("coverage", F.when(F.col("is_supported"), "AVAILABLE").otherwise("UNAVAILABLE"))
            .withColumn("message", F.when(~F.col("is_supported"), message))
            .withColumn("location", F.when(F.col("is_supported"), where).otherwise(F.col("requested_location")))
            .withColumn("available_aois", F.array(*[F.lit(a[1]) for a in INDEXED_AREAS])))


def profile_table(spark) -> DataFrame:
    """The fixed tile profiles as a table."""
    return spark.createDataFrame(
        TILE_PROFILES, "tile_id string, aoi string, primary_types array<string>, category string, "
                       "description string, year int")


def hybrid_rank(hits: DataFrame, parsed: DataFrame, profiles: DataFrame, k: int) -> DataFrame:
    """Re-rank vector hits by place, change types and year.

    hits(query_id, tile_id, score, vec_rank); parsed(query_id, aoi, change_types,
    years); profiles(tile_id, aoi, primary_types, category, description, year).
    """
    q = parsed.select("query_id", F.col("aoi").alias("q_aoi"), "change_types", "years")
    joined = (hits.join(q, "query_id").join(profiles, "tile_id", "left")
              .where(F.col("q_aoi").isNull() | (F.coalesce("aoi", F.lit("")) == F.col("q_aoi"))))
    no_types = F.array().cast("array<string>")
    overlap = F.size(F.array_intersect("change_types", F.coalesce("primary_types", no_types)))
    semantic = (F.when(F.size("change_types") == 0, 75.0).when(overlap > 0, 95.0 + overlap * 2.5).otherwise(35.0))
    temporal = (F.when(F.size("years") == 0, 80.0)
                .when(F.array_contains("years", F.coalesce("year", F.lit(2026))), 100.0).otherwise(60.0))
    vector = relevance_pct(F.col("score"))
    final = (F.when(F.col("q_aoi").isNotNull(),
                    vector * 0.25 + semantic * 0.50 + F.lit(100.0) * 0.15 + temporal * 0.10)
             .otherwise(vector * 0.45 + semantic * 0.40 + temporal * 0.15))
    ranked = (joined.withColumn("overlap", overlap).withColumn("vector_score", vector)
              .withColumn("relevance", round_to(clip(final, 45.0, 99.4), 1)))
    order = W.partitionBy("query_id").orderBy(F.desc("relevance"), "vec_rank")
    return (ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "tile_id", "rank", "vec_rank", "vector_score", "overlap", "relevance",
                    F.coalesce("category", F.lit("")).alias("category"),
                    F.coalesce("description", F.lit("")).alias("details")))


def catalog_fallback(points: DataFrame, profiles: DataFrame) -> DataFrame:
    """Profile rows with a fixed score, only while the index has no points."""
    empty = points.agg((F.count("*") == 0).alias("is_empty")).scalar()
    return profiles.where(empty).select(
        "tile_id", F.concat(F.lit("Scene "), F.initcap(F.replace("tile_id", F.lit("_"), F.lit(" ")))).alias("title"),
        F.concat(F.col("year").cast("string"), F.lit("-08-14")).alias("acquisition_date"),
        F.lit("Sentinel-2 MSI").alias("sensor"), F.lit(85.0).alias("relevance"), F.lit(0.92).alias("confidence"),
        "category", F.col("description").alias("details"))


def semantic_search(queries: DataFrame, points: DataFrame, profiles: DataFrame, k: int = 10,
                    prefilter: bool = False, embed: str = "hashed") -> DataFrame:
    """Answer queries(query_id, query) over points(tile_id, embedding).

    Unsupported places get no hits. By default the AOI filter follows the vector
    top-k; ``prefilter`` ranks inside each requested AOI instead, which keeps recall.
    """
    parsed = parse_queries(queries).where("is_supported")
    vectors = parsed.select("query_id", "aoi", embedder(embed)(F.col("query")).alias("vector"))
    width = max(k, 10)
    if prefilter:
        # One search: every point stands in the bucket of all and, if it has a place, in that of its AOI.
        placed = points.join(profiles.select("tile_id", "aoi"), "tile_id", "left").where(
            F.col("aoi").isin([key for key, *_ in INDEXED_AREAS]))
        everywhere = points.select("tile_id", "embedding", F.lit("").alias("aoi"))
        hits = vector_topk(everywhere.unionByName(placed.select("tile_id", "embedding", "aoi")),
                           vectors.withColumn("aoi", F.coalesce("aoi", F.lit(""))), width, bucket="aoi")
    else:
        hits = vector_topk(points, vectors.drop("aoi"), width)
    return hybrid_rank(hits, parsed, profiles, k)


# Score of catalogue rows that stand in for an empty index: a relevance of 85.
FALLBACK_SCORE = 0.7


def fallback_hits(parsed: DataFrame, points: DataFrame, profiles: DataFrame) -> DataFrame:
    """Hits of every query on the catalogue rows, only while the index has no points.

    The catalogue is the small fixed table of profiles; it travels as one array.
    """
    empty = points.limit(1).agg((F.count("*") == 0).alias("e")).scalar()
    tiles = profiles.agg(F.array_sort(F.collect_list("tile_id")).alias("t")).scalar()
    rows = parsed.where(empty).select("query_id", F.posexplode(tiles).alias("_at", "tile_id"))
    return rows.select("query_id", "tile_id", F.lit(FALLBACK_SCORE).alias("score"), (F.col("_at") + 1).alias("vec_rank"))


def respond(parsed: DataFrame, hits: DataFrame, profiles: DataFrame, k: int = 10) -> DataFrame:
    """One response per parsed query: coverage, message, indexed areas and the ranked results.

    Queries for places without coverage keep their row with an empty result.
    """
    ranked = hybrid_rank(hits, parsed.where("is_supported"), profiles, max(k, 10))
    item = F.struct("rank", "tile_id", "relevance", "category", "details")
    found = ranked.groupBy("query_id").agg(
        F.count("*").alias("_n"), F.array_sort(F.collect_list(F.when(F.col("rank") <= k, item))).alias("_results"))
    n = F.coalesce("_n", F.lit(0))
    retrieved = F.concat(F.lit("Retrieved "), n.cast("string"), F.lit(" verified satellite observation scenes."))
    nothing = F.array().cast(found.schema["_results"].dataType)
    return coverage_gate(parsed).join(found, "query_id", "left").select(
        "query_id", "coverage", F.col("location").alias("requested_location"), F.coalesce("message", retrieved).alias("message"),
        "available_aois", "change_types", "years", F.coalesce("_results", nothing).alias("results"))


def execute_search(queries: DataFrame, points: DataFrame, profiles: DataFrame, k: int = 10, embed: str = "hashed"
                   ) -> DataFrame:
    """Parse, search, re-rank and answer queries(query_id, query); an empty index answers from the catalogue."""
    parsed = parse_queries(queries)
    good = parsed.where("is_supported")
    hits = vector_topk(points, good.select("query_id", embedder(embed)(F.col("query")).alias("vector")), max(k, 10))
    hits = hits.select("query_id", "tile_id", "score", "vec_rank").unionByName(fallback_hits(good, points, profiles))
    return respond(parsed, hits, profiles, k)


def text_search(items: DataFrame, text: str, columns: tuple[str, ...]) -> DataFrame:
    """Rows whose columns contain the text; every row when none does or the text is blank."""
    needle = text.lower()
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.lower(F.col(c)).contains(needle), F.lit(False))
    if not text.strip():
        return items
    any_hit = items.agg(F.coalesce(F.bool_or(hit), F.lit(False)).alias("any_hit")).scalar()
    return items.where(hit | ~any_hit)


def resolve_tiles(wanted: DataFrame, key: str, tiles: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """Tile record of each wanted id: by id, by its alias, else the first tile."""
    table = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    rows = wanted.withColumn("_alias", F.coalesce(F.try_element_at(table, F.col(key)), F.col(key)))
    by_id = tiles.select(F.col("tile_id").alias(key), F.col("tile_id").alias("_own"))
    by_alias = tiles.select(F.col("tile_id").alias("_alias"), F.col("tile_id").alias("_other"))
    first = tiles.agg(F.min("tile_id").alias("t")).scalar()
    return (rows.join(by_id, key, "left").join(by_alias, "_alias", "left")
            .withColumn("tile_id", F.coalesce("_own", "_other", first)).drop("_own", "_other", "_alias"))


def sort_hits(hits: DataFrame, by: str) -> DataFrame:
    """Order hits by relevance, confidence or acquisition date, best or latest first."""
    column = {"relevance": "relevance", "confidence": "confidence", "date": "acquisition_date"}[by]
    return hits.orderBy(F.desc(column))
