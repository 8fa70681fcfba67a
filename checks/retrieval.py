"""Search, vector index, catalogue and STAC queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import views as v
from checks.registry import check, half_even
from scenelake.functions import labels, mathx, text
from scenelake.lookups import (INDEXED_AREAS, KEYWORD_SLOTS, METADATA_ALIASES, PLACE_PREPOSITIONS, PLACE_STOPWORDS,
                               PLATFORM_ALIASES, PROVIDERS, TAXONOMY, UNINDEXED_PLACES)
from scenelake.operators import vectors
from scenelake.plans import search
from scenelake.sources import records, stac

# ---- query parsing --------------------------------------------------------------

W = r"[\p{L}\p{N}_]+"
HW = r"[\p{L}\p{N}_](?:[\p{L}\p{N}_\-]*[\p{L}\p{N}_])?"


def _phrase(alias: str) -> str:
    return rf"regexp_matches(q, '(^|[^\p{{L}}\p{{N}}_]){alias}($|[^\p{{L}}\p{{N}}_])')"


def _cat_case() -> str:
    arms = []
    for name, words in TAXONOMY.items():
        single = ", ".join(f"'{w}'" for w in words if " " not in w)
        test = f"len(list_intersect(keywords, [{single}])) > 0"
        for w in words:
            if " " in w:
                test += f" OR contains(q, '{w}')"
        arms.append(f"CASE WHEN {test} THEN '{name}' END")
    return "list_sort(list_filter([" + ", ".join(arms) + "], lambda c: c IS NOT NULL))"


ALIAS_CASE = "CASE " + " ".join(f"WHEN {_phrase(a)} THEN '{a}'" for area in INDEXED_AREAS for a in area[4]) + " END"
AOI_CASE = "CASE " + " ".join(
    f"WHEN alias IN ({', '.join(repr(a) for a in area[4])}) THEN '{area[0]}'" for area in INDEXED_AREAS) + " END"
NAME_CASE = "CASE aoi " + " ".join(f"WHEN '{a[0]}' THEN '{a[1]}'" for a in INDEXED_AREAS) + " END"
OTHER_CASE = "CASE " + " ".join(f"WHEN {_phrase(a)} THEN '{n}'" for a, n in UNINDEXED_PLACES) + " END"
PREP = "|".join(PLACE_PREPOSITIONS)
FOUND = rf"regexp_extract(trim(query), '(?i)(?:^|[^\p{{L}}\p{{N}}_])(?:{PREP})\s+([A-Za-z\-]+(?:\s+[A-Za-z\-]+)?)', 1)"
STOP = ", ".join(f"'{w}'" for w in PLACE_STOPWORDS)
# Title case: every run of letters starts with a capital.
TITLE = ("array_to_string(list_transform(string_split({x}, ' '), lambda p: array_to_string(list_transform(string_split(p, '-'), "
         "lambda w: upper(w[1:1]) || lower(w[2:])), '-')), ' ')")

PARSED = v.QUERY_TEXT + f""",
p0 AS (SELECT query_id, query, lower(trim(query)) AS q, regexp_extract_all(lower(trim(query)), '{HW}') AS keywords,
         list_sort(list_distinct(list_transform(list_filter(regexp_extract_all(lower(query), '{W}'), lambda w: regexp_full_match(w, '20[12][0-9]')), lambda w: CAST(w AS INTEGER)))) AS years FROM query_text),
p1 AS (SELECT *, {_cat_case()} AS change_types, {ALIAS_CASE} AS alias, {OTHER_CASE} AS known, {FOUND} AS found FROM p0),
p2 AS (SELECT *, {AOI_CASE} AS aoi, CASE WHEN alias IS NULL THEN coalesce(known, CASE WHEN found <> '' AND lower(found) NOT IN ({STOP}) THEN {TITLE.format(x='found')} END) END AS other FROM p1),
parsed AS (SELECT *, {NAME_CASE} AS aoi_name, coalesce({TITLE.format(x='alias')}, other) AS requested_location, other IS NULL AS is_supported FROM p2)"""


def parsed(s, sf, **kw):
    return search.parse_queries(v.query_texts(s, sf), **kw)


def joined(name):
    return F.array_join(F.col(name).cast("array<string>"), ",")


@check("query_parse", "query_id:l kw:s ys:s cats:s aoi:s aoi_name:s requested_location:s is_supported:b",
       "SELECT *, array_to_string(keywords, ',') AS kw, array_to_string(years, ',') AS ys, array_to_string(change_types, ',') AS cats FROM parsed", PARSED)
def _(s, sf):
    return parsed(s, sf).withColumn("kw", joined("keywords")).withColumn("ys", joined("years")).withColumn("cats", joined("change_types"))


# Whole conversation turns as natural-language input, in four languages.
@check("tokenize", "conv_id:l turn:l n_hyphenated:l n_words:l joined:s", rf"""
SELECT conv_id, turn, len(regexp_extract_all(lower(text), '{HW}')) AS n_hyphenated, len(regexp_extract_all(lower(text), '{W}')) AS n_words,
       array_to_string(regexp_extract_all(lower(text), '{W}'), ' ') AS joined FROM conversations""")
def _(s, sf):
    c = v.table(s, sf, "conversations")
    return c.withColumn("n_hyphenated", F.size(text.hyphenated_words(F.col("text")))).withColumn(
        "n_words", F.size(text.words(F.col("text")))).withColumn("joined", F.array_join(text.words(F.col("text")), " "))


@check("years", "query_id:l ys:s", "SELECT *, array_to_string(years, ',') AS ys FROM parsed", PARSED)
def _(s, sf):
    return v.query_texts(s, sf).withColumn("ys", F.array_join(text.years(F.col("query")).cast("array<string>"), ","))


@check("distinct_years", "years:s n:l", "SELECT array_to_string(years, ',') AS years, count(*) AS n FROM parsed GROUP BY 1", PARSED)
def _(s, sf):
    return parsed(s, sf).groupBy(joined("years").alias("years")).agg(F.count("*").alias("n"))


@check("keyword_match", "query_id:l category:s", "SELECT query_id, unnest(change_types) AS category FROM parsed", PARSED)
def _(s, sf):
    return parsed(s, sf).select("query_id", F.explode("change_types").alias("category"))


@check("category_set", "cats:s n:l", "SELECT array_to_string(change_types, ',') AS cats, count(*) AS n FROM parsed GROUP BY 1", PARSED)
def _(s, sf):
    return parsed(s, sf).groupBy(joined("change_types").alias("cats")).agg(F.count("*").alias("n"))


@check("gazetteer_match", "query_id:l alias:s known:s", "SELECT * FROM parsed", PARSED)
def _(s, sf):
    rows = v.query_texts(s, sf)
    found = search.match_phrases(rows, "query", search.phrase_table(s))
    return rows.join(found.select("query", F.col("area.alias").alias("alias"), F.col("place").alias("known")), "query", "left")


@check("first_match", "query_id:l place:s", "SELECT query_id, coalesce(aoi_name, known) AS place FROM parsed", PARSED)
def _(s, sf):
    rows = v.query_texts(s, sf)
    found = search.match_phrases(rows, "query", search.phrase_table(s))
    return rows.join(found.select("query", F.coalesce("area.aoi_name", "place").alias("place")), "query", "left")


@check("place_heuristic", "query_id:l place:s", f"""
SELECT query_id, CASE WHEN found <> '' AND lower(found) NOT IN ({STOP}) THEN {TITLE.format(x='found')} END AS place FROM parsed""", PARSED)
def _(s, sf):
    return v.query_texts(s, sf).withColumn("place", search.place_heuristic(F.trim("query")))


@check("coverage_gate", "query_id:l coverage:s location:s message:s n_aois:l", """
SELECT query_id, CASE WHEN is_supported THEN 'AVAILABLE' ELSE 'UNAVAILABLE' END AS coverage,
       CASE WHEN is_supported THEN coalesce(aoi_name, 'Indexed Catalogs') ELSE requested_location END AS location,
       CASE WHEN NOT is_supported THEN 'Satellite imagery for ''' || requested_location || ''' is not currently available in the local indexed catalog.' END AS message,
       3 AS n_aois FROM parsed""", PARSED)
def _(s, sf):
    return search.coverage_gate(parsed(s, sf)).withColumn("n_aois", F.size("available_aois"))


# ---- embeddings -------------------------------------------------------------------

SLOTS = "CASE tok " + " ".join(f"WHEN '{k}' THEN {i}" for k, i in KEYWORD_SLOTS.items()) + " END"


def _embed_sql(src: str, key: str) -> str:
    """Vector entries of the texts of ``src(key, text)``."""
    return rf"""
tk AS (SELECT {key}, unnest(regexp_extract_all(lower(text), '{W}')) AS tok FROM {src}),
th AS (SELECT {key}, tok, CAST(('0x' || sha256(tok)[1:8]) AS BIGINT) % 512 AS h, {SLOTS} AS k FROM tk),
en AS (SELECT {key}, h AS idx, 1.0::DOUBLE AS w FROM th UNION ALL SELECT {key}, (h * 3 + 7) % 512, 0.5::DOUBLE FROM th
       UNION ALL SELECT {key}, (12 * k) % 512, 3.5::DOUBLE FROM th WHERE k IS NOT NULL UNION ALL SELECT {key}, (12 * k + 1) % 512, 2.8::DOUBLE FROM th WHERE k IS NOT NULL
       UNION ALL SELECT {key}, (12 * k + 2) % 512, 2.1::DOUBLE FROM th WHERE k IS NOT NULL),
sm AS (SELECT {key}, idx, sum(w) AS w FROM en GROUP BY {key}, idx
       UNION ALL SELECT {key}, 0, 1.0::DOUBLE FROM {src} WHERE len(regexp_extract_all(lower(text), '{W}')) = 0),
emb AS (SELECT {key}, idx, w / sqrt(sum(w * w) OVER (PARTITION BY {key})) AS w FROM sm)"""


def _entries(df, key, vec):
    return df.select(key, F.posexplode_outer(vec).alias("idx", "w")).where("w <> 0")


@check("text_embed", "doc_id:l idx:l w:6", "SELECT * FROM emb", _embed_sql("documents", "doc_id"))
def _(s, sf):
    d = v.table(s, sf, "documents").select("doc_id", vectors.text_embed(F.col("text")).alias("vec"))
    return _entries(d, "doc_id", F.col("vec"))


def _image_sql() -> str:
    k = {n: i * 12 for n, i in KEYWORD_SLOTS.items()}
    rules = [("vegetation", "CASE WHEN veg > 0.05 THEN veg * 4.0 END"), ("agriculture", "CASE WHEN veg > 0.05 THEN veg * 3.0 END"),
             ("water", "CASE WHEN wet THEN 4.0 END"), ("river", "CASE WHEN wet THEN 3.0 END"), ("flood", "CASE WHEN wet THEN 2.0 END"),
             ("construction", "CASE WHEN built THEN 4.0 END"), ("urban", "CASE WHEN built THEN 3.5 END"), ("building", "CASE WHEN built THEN 3.0 END"),
             ("solar", "CASE WHEN dark THEN 4.0 END"), ("industrial", "CASE WHEN dark THEN 3.0 END")]
    arms = " UNION ALL ".join(f"SELECT scene, {k[n]} AS idx, CAST({e} AS DOUBLE) AS w FROM ru" for n, e in rules)
    return v.PAIR_PX + f""",
vv AS (SELECT scene, y, x, unnest([r2, g2, b2]) AS v, (y // 2) * 4 + x // 2 AS cell FROM pair_px),
ch AS (SELECT scene, avg(r2) AS r, avg(g2) AS g, avg(b2) AS b, (stddev_pop(r2) + stddev_pop(g2) + stddev_pop(b2)) / 3.0 AS contrast FROM pair_px GROUP BY scene),
ru AS (SELECT scene, (g - r) / (g + r + 1e-6) AS veg, (b - r) / (b + r + 1e-6) > 0.05 OR b > r + 0.05 AS wet,
         (r + g + b) / 3.0 > 0.45 AND contrast > 0.15 AS built, (r + g + b) / 3.0 < 0.25 AND contrast > 0.18 AS dark FROM ch),
gr AS (SELECT scene, 40 + 2 * cell AS idx, avg(v) AS w FROM vv GROUP BY scene, cell UNION ALL SELECT scene, 41 + 2 * cell, stddev_pop(v) FROM vv GROUP BY scene, cell),
rw AS (SELECT * FROM ({arms}) a WHERE w IS NOT NULL AND idx NOT BETWEEN 40 AND 71 UNION ALL SELECT * FROM gr),
img AS (SELECT scene, idx, w / sqrt(sum(w * w) OVER (PARTITION BY scene)) AS w FROM rw)"""


def scene_images(s, sf):
    return vectors.image_embed(v.epoch_blocks(s, sf, 1), "scene", F.lit(8))


@check("image_embed", "scene:l idx:l w:6", "SELECT * FROM img WHERE w <> 0", _image_sql())
def _(s, sf):
    return _entries(scene_images(s, sf), "scene", F.col("embedding"))


# ---- vector search -------------------------------------------------------------------

TOPK = v.TILE_VECTOR + """,
cs AS (SELECT q.vec_id AS query_id, t.tile_id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(t.embedding AS DOUBLE[])), 9) + 0.0 AS score
       FROM tile_vector q, tile_vector t),
hit AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, tile_id) AS vec_rank FROM cs),
top AS (SELECT * FROM hit WHERE vec_rank <= 10)"""


def _points(s, sf):
    return v.tile_vectors(s, sf).select("tile_id", "embedding")


def _self_queries(s, sf):
    return v.tile_vectors(s, sf).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


def _hits(s, sf):
    return vectors.vector_topk(_points(s, sf), _self_queries(s, sf))


@check("vector_topk", "query_id:l tile_id:s score:6 vec_rank:l", "SELECT * FROM top", TOPK)
def _(s, sf):
    return _hits(s, sf)


@check("vector_topk_ann", "query_id:l tile_id:s score:6 vec_rank:l")
def _(s, sf):
    return vectors.vector_topk_ann(_points(s, sf), _self_queries(s, sf))


@check("relevance_pct", "query_id:l tile_id:s pct:1",
       f"SELECT query_id, tile_id, {half_even('greatest(0.0, least(100.0, (score + 1.0) / 2.0 * 100.0))', 1)} AS pct FROM top", TOPK)
def _(s, sf):
    return _hits(s, sf).withColumn("pct", labels.relevance_pct(F.col("score")))


# The later image of every scene looks for the most similar earlier images.
@check("image_search", "query_id:l tile_id:l score:6 vec_rank:l", """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, tile_id) AS vec_rank FROM (
  SELECT a.scene AS query_id, b.scene AS tile_id, round(sum(a.w * b.w), 9) + 0.0 AS score FROM img a JOIN img1 b ON a.idx = b.idx GROUP BY 1, 2)) WHERE vec_rank <= 10""",
       _image_sql() + "," + _image_sql().split(",\nvv AS", 1)[1].join(["vv AS", ""]).replace("r2", "r1").replace("g2", "g1").replace("b2", "b1")
       .replace("vv", "vv1").replace("ch AS", "ch1 AS").replace("FROM ch)", "FROM ch1)").replace("ru AS", "ru1 AS").replace("FROM ru", "FROM ru1")
       .replace("gr AS", "gr1 AS").replace("FROM gr)", "FROM gr1)").replace("rw AS", "rw1 AS").replace("FROM rw)", "FROM rw1)").replace("img AS", "img1 AS"))
def _(s, sf):
    early = vectors.image_embed(v.epoch_blocks(s, sf, 0), "scene", F.lit(8)).withColumnRenamed("scene", "tile_id")
    late = scene_images(s, sf).select(F.col("scene").alias("query_id"), F.col("embedding").alias("vector"))
    return vectors.vector_topk(early, late)


RANKED = TOPK + "," + PARSED + f""",
jo AS (SELECT t.query_id, t.tile_id, t.vec_rank, {half_even('greatest(0.0, least(100.0, (score + 1.0) / 2.0 * 100.0))', 1)} AS vector_score, q.aoi AS q_aoi,
         CASE WHEN primary_types IS NULL THEN 0 ELSE len(list_intersect(change_types, primary_types)) END AS overlap, len(change_types) AS nt,
         CASE WHEN len(years) = 0 THEN 80.0 WHEN list_contains(years, coalesce(year, 2026)) THEN 100.0 ELSE 60.0 END AS temporal, category, description
       FROM top t JOIN parsed q ON t.query_id = q.query_id LEFT JOIN tile_profile p ON t.tile_id = p.tile_id
       WHERE q.is_supported AND (q.aoi IS NULL OR p.aoi = q.aoi)),
fin AS (SELECT *, CASE WHEN nt = 0 THEN 75.0 WHEN overlap > 0 THEN 95.0 + overlap * 2.5 ELSE 35.0 END AS semantic FROM jo),
rel AS (SELECT *, {half_even("""greatest(45.0, least(99.4, CASE WHEN q_aoi IS NOT NULL THEN vector_score * 0.25::DOUBLE + semantic * 0.50::DOUBLE + 100.0::DOUBLE * 0.15::DOUBLE + temporal * 0.10::DOUBLE
         ELSE vector_score * 0.45::DOUBLE + semantic * 0.40::DOUBLE + temporal * 0.15::DOUBLE END))""", 1)} AS relevance FROM fin),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, vec_rank) AS rank FROM rel)"""


def _ranked(s, sf):
    good = parsed(s, sf).where("is_supported")
    return search.hybrid_rank(_hits(s, sf), good, v.tile_profiles(s, sf), 10)


@check("hybrid_rank", "query_id:l tile_id:s rank:l relevance:1 overlap:l category:s details:s",
       "SELECT query_id, tile_id, rank, relevance, overlap, coalesce(category, '') AS category, coalesce(description, '') AS details FROM rk", RANKED)
def _(s, sf):
    return _ranked(s, sf)


@check("rank_hits", "query_id:l tile_id:s rank:l", "SELECT * FROM rk", RANKED)
def _(s, sf):
    return _ranked(s, sf)


@check("category_overlap", "query_id:l tile_id:s overlap:l", "SELECT * FROM rk", RANKED)
def _(s, sf):
    return _ranked(s, sf)


@check("aoi_filter", "query_id:l n_hits:l", "SELECT query_id, count(*) AS n_hits FROM jo WHERE q_aoi IS NOT NULL GROUP BY query_id", RANKED)
def _(s, sf):
    good = parsed(s, sf).where("is_supported and aoi is not null")
    return search.hybrid_rank(_hits(s, sf), good, v.tile_profiles(s, sf), 10).groupBy("query_id").agg(F.count("*").alias("n_hits"))


@check("execute_search", "query_id:l coverage:s requested_location:s message:s n_aois:l n_results:l best:s", """
SELECT p.query_id, CASE WHEN is_supported THEN 'AVAILABLE' ELSE 'UNAVAILABLE' END AS coverage,
       CASE WHEN is_supported THEN coalesce(aoi_name, 'Indexed Catalogs') ELSE requested_location END AS requested_location,
       CASE WHEN is_supported THEN 'Retrieved ' || coalesce(n, 0) || ' verified satellite observation scenes.'
            ELSE 'Satellite imagery for \'\'' || requested_location || '\'\' is not currently available in the local indexed catalog.' END AS message,
       3 AS n_aois, coalesce(n, 0) AS n_results, best
FROM parsed p LEFT JOIN (SELECT query_id, count(*) AS n, arg_min(tile_id, rank) AS best FROM rk GROUP BY query_id) r ON p.query_id = r.query_id""".replace("\\'", "'"), RANKED)
def _(s, sf):
    found = search.respond(parsed(s, sf), _hits(s, sf), v.tile_profiles(s, sf))
    return found.withColumns({"n_aois": F.size("available_aois"), "n_results": F.size("results"), "best": F.get("results", F.lit(0))["tile_id"]})


# Conversation turns of users as text queries over the images of all scenes.
@check("semantic_search", "query_id:s tile_id:s rank:l relevance:1")
def _(s, sf):
    q = v.table(s, sf, "conversations").where("role = 'user'").select(
        F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("query_id"), F.col("text").alias("query"))
    points = scene_images(s, sf).select(F.concat(F.lit("tile_"), F.col("scene").cast("string")).alias("tile_id"), "embedding")
    return search.semantic_search(q, points, v.tile_profiles(s, sf), prefilter=True)


@check("sort_hits", "query_id:l tile_id:s relevance:1", "SELECT * FROM rk", RANKED)
def _(s, sf):
    return search.sort_hits(_ranked(s, sf), "relevance")


@check("profile_lookup", "tile_id:s aoi:s year:l", """
SELECT t.tile_id, coalesce(p.aoi, '') AS aoi, coalesce(p.year, 2026) AS year FROM tile_vector t LEFT JOIN tile_profile p USING (tile_id)""", v.TILE_VECTOR)
def _(s, sf):
    p = v.tile_profiles(s, sf).select("tile_id", "aoi", "year")
    return _points(s, sf).join(p, "tile_id", "left").select(
        "tile_id", F.coalesce("aoi", F.lit("")).alias("aoi"), F.coalesce("year", F.lit(2026)).alias("year"))


# Log of versions: every event writes a version of one of 500 tiles; titles may be absent.
UPSERT = """
lg AS (SELECT 'tile_' || (event_id * 7 % 500) AS tile_id, CASE WHEN event_id % 3 > 0 THEN 'T' || event_id END AS title,
         CASE WHEN event_id % 4 > 0 THEN value END AS confidence, CAST(NULL AS VARCHAR) AS sensor, event_id AS seq FROM events),
latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tile_id ORDER BY seq DESC) AS rn FROM lg) WHERE rn = 1)"""


def _points_log(s, sf):
    e = v.table(s, sf, "events")
    n = F.col("event_id")
    return vectors.upsert_points(e.select(
        F.concat(F.lit("tile_"), (n * 7 % 500).cast("string")).alias("tile_id"),
        F.when(n % 3 > 0, F.concat(F.lit("T"), n.cast("string"))).alias("title"), F.when(n % 4 > 0, F.col("value")).alias("confidence"),
        F.lit(None).cast("string").alias("sensor"), n.alias("seq")), "seq")


@check("vector_upsert", "tile_id:s title:s confidence:6 sensor:s", """
SELECT tile_id, coalesce(title, tile_id) AS title, coalesce(confidence, 0.90) AS confidence, 'Sentinel-2' AS sensor FROM latest""", UPSERT)
def _(s, sf):
    return _points_log(s, sf)


@check("index_count", "n_points:l", "SELECT count(*) AS n_points FROM latest", UPSERT)
def _(s, sf):
    return vectors.index_count(_points_log(s, sf))


# SHA-1 is built into DuckDB; version and variant bits are set by hand.
@check("uuid5", "tile_id:s point_id:s", """
SELECT tile_id, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || (['8','9','a','b'])[CAST(('0x' || h[17:17]) AS INTEGER) % 4 + 1] || h[18:20] || '-' || h[21:32] AS point_id
FROM (SELECT tile_id, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(tile_id)) AS h FROM tile_vector)""", v.TILE_VECTOR)
def _(s, sf):
    return _points(s, sf).withColumn("point_id", text.uuid5_dns(F.col("tile_id")))


@check("sha256", "doc_id:l digest:s bucket:l", """
SELECT doc_id, sha256(text) AS digest, CAST(('0x' || sha256(text)[1:8]) AS BIGINT) % 512 AS bucket FROM documents""")
def _(s, sf):
    return v.table(s, sf, "documents").select("doc_id", F.sha2("text", 256).alias("digest"), text.sha256_bucket(F.col("text"), 512).alias("bucket"))


@check("catalog_fallback", "tile_id:s title:s relevance:1",
       "SELECT tile_id, 'Scene Tile ' || vec_id AS title, 85.0 AS relevance FROM tile_profile JOIN tile_vector USING (tile_id)", v.TILE_VECTOR)
def _(s, sf):
    return search.catalog_fallback(_points(s, sf).where("tile_id is null"), v.tile_profiles(s, sf))


@check("id_alias_lookup", "wanted:s tile_id:s", """
SELECT wanted, coalesce(a.tile_id, b.tile_id, 'tile_0') AS tile_id FROM (SELECT CASE event_id % 5 WHEN 0 THEN 'tile_tumakuru_ind_01' WHEN 1 THEN 'missing_' || event_id ELSE 'tile_' || (event_id % 600) END AS wanted FROM events) w
LEFT JOIN tile_vector a ON a.tile_id = wanted LEFT JOIN tile_vector b ON b.tile_id = CASE wanted WHEN 'tile_tumakuru_ind_01' THEN 'tile_tumakuru_02' ELSE wanted END""", v.TILE_VECTOR)
def _(s, sf):
    n = F.col("event_id")
    want = v.table(s, sf, "events").select(F.when(n % 5 == 0, "tile_tumakuru_ind_01").when(n % 5 == 1, F.concat(F.lit("missing_"), n.cast("string")))
                                           .otherwise(F.concat(F.lit("tile_"), (n % 600).cast("string"))).alias("wanted"))
    return search.resolve_tiles(want, "wanted", _points(s, sf).select("tile_id"), METADATA_ALIASES)


HIT_JSON = """
SELECT tile_id, '{"id":"' || tile_id || '","title":"Scene ' || vec_id || '","thumbnail":"","latitude":' || lat || ',"longitude":' || lon || ',"acquisitionDate":"' || year || '-01-01","sensor":"Sentinel-2","relevanceScore":' || (50.5 + label) ||
 ',"confidence":0.5,"category":"","details":"d","coordinates":"' || printf('%.4f', lat) || '° N, ' || printf('%.4f', lon) || '° E","bbox":[' || lon || ',' || lat || ']}' AS json
FROM (SELECT *, 10.5 + label AS lat, 70.25 + label AS lon FROM tile_vector)"""


@check("hit_to_json", "tile_id:s json:s", HIT_JSON, v.TILE_VECTOR)
def _(s, sf):
    t = v.tile_vectors(s, sf)
    lat, lon = F.col("label") + 10.5, F.col("label") + 70.25
    return records.hit_to_json(t.select(
        "tile_id", F.concat(F.lit("Scene "), F.col("vec_id").cast("string")).alias("title"), F.lit("").alias("thumbnail"), lat.alias("latitude"), lon.alias("longitude"),
        F.concat(F.col("year").cast("string"), F.lit("-01-01")).alias("acquisition_date"), F.lit("Sentinel-2").alias("sensor"), (F.col("label") + 50.5).alias("relevance"),
        F.lit(0.5).alias("confidence"), F.lit(None).cast("string").alias("category"), F.lit("d").alias("details"), F.array(lon, lat).alias("bbox")))


@check("fmt_coords", "event_id:l c:s", "SELECT event_id, printf('%.4f', 12.0 + (user_id % 40) / 16.0) || '° N, ' || printf('%.4f', 75.0 + (user_id % 60) / 16.0) || '° E' AS c FROM events")
def _(s, sf):
    e = v.table(s, sf, "events")
    return e.withColumn("c", labels.format_coordinates(F.col("user_id") % 40 / 16.0 + 12.0, F.col("user_id") % 60 / 16.0 + 75.0))


@check("text_search_fallback", "doc_id:l", "SELECT doc_id FROM documents WHERE contains(lower(text), 'here') OR contains(lower(source), 'here')")
def _(s, sf):
    return search.text_search(v.table(s, sf, "documents"), "HERE", ("text", "source"))


@check("text_search_no_match", "doc_id:l", "SELECT doc_id FROM documents")
def _(s, sf):
    return search.text_search(v.table(s, sf, "documents"), "no such words anywhere", ("text", "source"))


# ---- STAC ------------------------------------------------------------------------------

_ALIASES = "CASE p " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in PLATFORM_ALIASES.items()) + " ELSE p END"
STAC_SQL = f"""
SELECT *, {_ALIASES} AS platform FROM (SELECT event_id, 'item_' || event_id AS id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS datetime,
  CASE event_id % 3 WHEN 0 THEN replace(trim(lower((['S2A', 'Landsat_8', ' lc09 ', 'PlanetScope'])[user_id % 4 + 1])), '_', '-') WHEN 1 THEN 'sentinel-2b' ELSE 'oli' END AS p,
  nullif(CAST(event_id % 40 AS DOUBLE), 0.0) AS incidence_angle,
  CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 10 = 1 THEN 55.5 ELSE user_id % 30 + 0.5 END AS view_angle,
  CASE WHEN event_id % 2 = 0 THEN 'ascending' WHEN user_id = 0 THEN NULL ELSE CAST(user_id AS VARCHAR) END AS orbit,
  (['EPSG:32644', 'EPSG:32643', 'EPSG:3857', 'EPSG:4326'])[event_id % 4 + 1] AS crs,
  CASE WHEN event_id % 6 = 0 THEN 0.0 ELSE user_id END AS west, CASE WHEN event_id % 6 = 0 THEN 0.0 ELSE user_id + 0.75 END AS north FROM events)"""


def _stac(s, sf):
    return stac.parse_items(v.stac_items(s, sf), keep=["event_id"])


@check("stac_parse", "event_id:l id:s datetime:s platform:s incidence_angle:6 view_angle:6 orbit:s crs:s west:6 north:6", STAC_SQL)
def _(s, sf):
    return _stac(s, sf).withColumn("west", F.col("bbox")[0]).withColumn("north", F.col("bbox")[3])


@check("platform_norm", "event_id:l platform:s", f"SELECT event_id, {_ALIASES} AS platform FROM (SELECT event_id, replace(trim(lower(event_type || '_S2A ')), '_', '-') AS p FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, (['s2b', 's1a', 'landsat-9', 'landsat-8'])[user_id % 4 + 1] FROM events WHERE event_id % 2 = 1)")
def _(s, sf):
    e = v.table(s, sf, "events")
    raw = F.when(F.col("event_id") % 2 == 0, F.concat("event_type", F.lit("_S2A "))).otherwise(v._choose([" S2B", "s1a", "LC09", "Landsat8"], F.col("user_id") % 4))
    return e.withColumn("platform", text.normalize_platform(raw))


@check("crs_norm", "event_id:l crs:s", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'EPSG:' || event_id WHEN 1 THEN 'EPSG:4326' ELSE 'WKT ' || event_id END AS crs FROM events")
def _(s, sf):
    n = F.col("event_id").cast("string")
    raw = F.when(F.col("event_id") % 3 == 0, n).when(F.col("event_id") % 3 == 1, F.lit("")).otherwise(F.concat(F.lit("WKT "), n))
    return v.table(s, sf, "events").withColumn("crs", text.normalize_crs(raw))


@check("json_get", "event_id:l k:l missing:s", "SELECT event_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k, 'none' AS missing FROM events")
def _(s, sf):
    p = F.try_parse_json("props")
    return v.table(s, sf, "events").withColumn("k", F.try_variant_get(p, "$.k", "bigint")).withColumn(
        "missing", F.coalesce(F.try_variant_get(p, '$.properties["view:off_nadir"]', "string"), F.lit("none")))


@check("map_get", "event_id:l got:s", "SELECT event_id, CASE WHEN event_type = 'error' THEN 'bad' ELSE 'fine' END AS got FROM events")
def _(s, sf):
    m = F.create_map(F.lit("error"), F.lit("bad"))
    return v.table(s, sf, "events").withColumn("got", F.coalesce(F.try_element_at(m, "event_type"), F.lit("fine")))


@check("bbox_centroid", "event_id:l lat:6 lon:6", "SELECT event_id, (user_id * 2 + 1.25) / 2.0 AS lat, (user_id * 2 + 0.25) / 2.0 AS lon FROM events WHERE event_id % 6 <> 0 UNION ALL SELECT event_id, 0.0, 0.0 FROM events WHERE event_id % 6 = 0")
def _(s, sf):
    lat, lon = mathx.bbox_centroid(F.col("bbox"))
    return _stac(s, sf).withColumn("lat", lat).withColumn("lon", lon)


SOURCES = [*PROVIDERS, "Sentinel-9"]


def payloads(s, sf):
    """One provider payload per event; cloud, bands, bbox and orbit are each absent for some."""
    e = v.table(s, sf, "events")
    n, u = F.col("event_id"), F.col("user_id").cast("string")
    js = F.concat(F.lit('{"id":"p'), n.cast("string"), F.lit('","datetime":"'), F.date_format("ts", "yyyy-MM-dd"), F.lit('"'),
                  F.when(n % 4 > 0, F.concat(F.lit(',"cloud_cover":'), (n % 100).cast("string"))).otherwise(F.lit("")),
                  F.when(n % 3 == 0, F.lit(',"bands":["B1","B2"]')).otherwise(F.lit("")),
                  F.when(n % 2 == 0, F.concat(F.lit(',"bbox":['), u, F.lit(".0,1.0,"), u, F.lit(".5,2.0]"))).otherwise(F.lit("")), F.lit("}"))
    return e.select("event_id", v._choose(SOURCES, n % 5).alias("source"), js.alias("payload"))


PAYLOAD_SQL = f"""
pay AS (SELECT event_id, {v._sql_choose(SOURCES, 'event_id % 5')} AS source, 'p' || event_id AS id, strftime(ts, '%Y-%m-%d') AS datetime_acquired,
  CASE WHEN event_id % 4 > 0 THEN CAST(event_id % 100 AS DOUBLE) END AS cc, CASE WHEN event_id % 3 = 0 THEN 2 END AS nb,
  CASE WHEN event_id % 2 = 0 THEN user_id ELSE 77.0 END AS west, CASE WHEN event_id % 2 = 0 THEN (user_id + user_id + 0.5) / 2.0 ELSE (77.0 + 77.2) / 2.0 END AS lon FROM events)"""


def _ingest_case(field: int) -> str:
    return "CASE source " + " ".join(
        f"WHEN '{k}' THEN {repr(p[field]) if p[field] is not None else 'NULL'}" for k, p in PROVIDERS.items()) + " END"


INGEST_SQL = PAYLOAD_SQL + f""",
ing AS (SELECT event_id, source, id, datetime_acquired, {_ingest_case(0)} AS platform, {_ingest_case(1)} AS instrument, {_ingest_case(2)} AS gsd_meters,
  CASE WHEN source = 'Sentinel-1' THEN 0.0 ELSE coalesce(cc, {_ingest_case(3)}) END AS cloud_cover,
  coalesce(nb, CASE source {' '.join(f"WHEN '{k}' THEN {len(p[4])}" for k, p in PROVIDERS.items())} END) AS n_bands, west, lon,
  CASE WHEN source = 'Sentinel-2' THEN 'descending' END AS orbit, CASE WHEN source = 'Sentinel-2' THEN 2 ELSE 0 END AS n_assets FROM pay WHERE source <> 'Sentinel-9')"""
INGEST_SPEC = "event_id:l source:s id:s datetime_acquired:s platform:s instrument:s gsd_meters:2 cloud_cover:2 n_bands:l west:6 lon:6 orbit:s n_assets:l"


def _ingested(s, sf):
    scenes, _ = stac.ingest(payloads(s, sf), keep=["event_id"])
    return (scenes.withColumn("n_bands", F.size("bands")).withColumn("west", F.col("bbox")[0]).withColumn("lon", F.col("centroid.lon"))
            .withColumn("orbit", F.col("orbit_direction")).withColumn("n_assets", F.size("assets")))


def _provider_check(key: str, source: str):
    @check(key, INGEST_SPEC, f"SELECT * FROM ing WHERE source = '{source}'", INGEST_SQL)
    def _(s, sf):
        return _ingested(s, sf).where(F.col("source") == source)


for _key, _source in (("s2", "Sentinel-2"), ("s1", "Sentinel-1"), ("landsat", "Landsat-8/9"), ("bhuvan", "ISRO-Bhuvan")):
    _provider_check(f"stac_ingest_{_key}", _source)


@check("stac_ingest_route", "source:s state:s n:l", """
SELECT source, CASE WHEN source = 'Sentinel-9' THEN 'quarantine' ELSE 'ingested' END AS state, count(*) AS n FROM pay GROUP BY ALL""", PAYLOAD_SQL)
def _(s, sf):
    scenes, bad = stac.ingest(payloads(s, sf), keep=["event_id"])
    both = scenes.select("source", F.lit("ingested").alias("state")).unionByName(bad.select("source", F.lit("quarantine").alias("state")))
    return both.groupBy("source", "state").agg(F.count("*").alias("n"))


# Page addresses stand for file paths; endings vary by page.
@check("valid_extension", "page_id:l valid:b", """
SELECT page_id, page_id % 7 NOT IN (5, 6) AS valid FROM pages""")
def _(s, sf):
    p = v.table(s, sf, "pages")
    end = v._choose([".tif", ".TIFF", ".cog", ".json", ".GeoJSON", ".png", ".tif.bak"], F.col("page_id") % 7)
    return p.withColumn("valid", stac.has_raster_extension(F.concat("url", end)))


@check("catalog_search", "event_id:l", """
SELECT event_id FROM events WHERE user_id <= 40 AND user_id + 0.5 >= 10 AND user_id + 0.25 <= 45 AND user_id + 0.75 >= 5
  AND CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' AND value <= 30""")
def _(s, sf):
    e, u = v.table(s, sf, "events"), F.col("user_id")
    scenes = e.select("event_id", u.cast("double").alias("min_lon"), (u + 0.5).alias("max_lon"), (u + 0.25).alias("min_lat"), (u + 0.75).alias("max_lat"),
                      F.to_date("ts").alias("acquired"), F.col("value").alias("cloud_cover"))
    return stac.catalog_search(scenes, [10.0, 5.0, 40.0, 45.0], "2024-01-05", "2024-01-20")
