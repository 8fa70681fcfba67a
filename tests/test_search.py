"""Query parsing, embeddings and vector search against plain Python."""

import hashlib
import re
import uuid

import numpy as np
import pytest
from pyspark.sql import Row, functions as F

from scenelake.functions import text
from scenelake.lookups import KEYWORD_SLOTS
from scenelake.operators import phrases, vectors
from scenelake.plans import search


def parse(spark, queries, **kw):
    df = spark.createDataFrame(list(enumerate(queries)), "query_id int, query string")
    return search.parse_queries(df, **kw).orderBy("query_id").collect()


def test_places(spark):
    rows = parse(spark, ["Floods near Vijayawada in 2024", "buildings in Bangalore", "change around silver-lake town now", "forest in the", "solar parks 2026",
                         "loss near rivers", "in Goa and Tumkur"])
    assert [(r.aoi, r.requested_location, r.is_supported) for r in rows] == [
        ("krishna", "Vijayawada", True), (None, "Bengaluru", False), (None, "Silver-Lake Town", False), (None, None, True), (None, None, True),
        (None, "Rivers", False), ("tumakuru", "Tumkur", True)]
    assert [r.years for r in rows][:5] == [[2024], [], [], [], [2026]]
    strict = parse(spark, ["loss near rivers", "loss near Mysore"], strict_places=True)
    assert [r.requested_location for r in strict] == [None, "Mysore"]


def test_categories(spark):
    rows = parse(spark, ["new green cover and city growth", "High-tech shed", "waterbody", "nothing", "harbour solar array"])
    assert [r.change_types for r in rows] == [["URBAN_EXPANSION", "VEGETATION"], ["CONSTRUCTION_INDUSTRIAL"], ["WATER_FLOOD"], [], ["PORT_INFRASTRUCTURE", "SOLAR_ENERGY"]]


def test_unicode_words(spark):
    t = "Über die Wälder_2024 – naïve, état-major; 東京 x-y-"
    row = spark.createDataFrame([(t,)], "t string").select(text.words(F.col("t")).alias("w"), text.hyphenated_words(F.col("t")).alias("h")).first()
    assert row.w == re.findall(r"\w+", t.lower())
    assert row.h == re.findall(r"\b[\w\-]+\b", t.lower())


def test_uuid5_matches_the_standard_library(spark):
    names = ["tile_1", "tile_é", ""]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select(text.uuid5_dns(F.col("n")).alias("u")).collect()
    assert [r.u for r in rows] == [str(uuid.uuid5(uuid.NAMESPACE_DNS, n)) for n in names]


def plain_embed(t):
    vec = np.zeros(512)
    for w in re.findall(r"\w+", t.lower()):
        h = int(hashlib.sha256(w.encode()).hexdigest()[:8], 16) % 512
        if w in KEYWORD_SLOTS:
            for i, x in enumerate((3.5, 2.8, 2.1)):
                vec[(KEYWORD_SLOTS[w] * 12 + i) % 512] += x
        vec[h] += 1.0
        vec[(h * 3 + 7) % 512] += 0.5
    return vec / np.linalg.norm(vec) if vec.any() else np.eye(1, 512)[0]


def test_text_embedding(spark):
    texts = ["New construction near water, water and Settlement!", "", "… !", "été à Köln 2024"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(vectors.text_embed(F.col("t")).alias("v")).collect()
    for t, r in zip(texts, rows):
        assert np.allclose(r.v, plain_embed(t))


def test_image_embedding(spark):
    rng = np.random.default_rng(5)
    img = rng.random((10, 14, 3)) * np.array([0.3, 0.9, 0.6])
    row = dict(tile="t", width=14, **{b: img[..., i].ravel().tolist() for i, b in enumerate("rgb")})
    got = np.array(vectors.image_embed(spark.createDataFrame([Row(**row)]), "tile", F.lit(10)).first().embedding)
    r, g, b = (img[..., i] for i in range(3))
    vec = np.zeros(512)
    veg = (g.mean() - r.mean()) / (g.mean() + r.mean() + 1e-6)
    water = (b.mean() - r.mean()) / (b.mean() + r.mean() + 1e-6)
    if veg > 0.05:
        vec[14 * 12], vec[11 * 12] = veg * 4, veg * 3
    if water > 0.05 or b.mean() > r.mean() + 0.05:
        vec[60], vec[72], vec[108] = 4, 3, 2
    if img.mean() > 0.45 and (r.std() + g.std() + b.std()) / 3 > 0.15:
        vec[0], vec[24], vec[12] = 4, 3.5, 3
    k = 40
    for i in range(4):
        for j in range(4):
            cell = img[i * 10 // 4:(i + 1) * 10 // 4, j * 14 // 4:(j + 1) * 14 // 4]
            vec[k], vec[k + 1] = cell.mean(), cell.std()
            k += 2
    assert np.allclose(got, vec / np.linalg.norm(vec))


@pytest.mark.parametrize("side", [1, 2, 3])
def test_tiny_images_have_full_vectors(spark, side):
    row = dict(tile="t", width=side, **{b: [0.5] * side * side for b in "rgb"})
    got = vectors.image_embed(spark.createDataFrame([Row(**row)]), "tile", F.lit(side)).first().embedding
    assert len(got) == 512 and np.isclose(np.linalg.norm(got), 1.0)


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(11)
    base = rng.standard_normal((300, 16))
    base[100:200] = base[100]  # a third of all points are copies
    rows = [(f"t{i:03d}", [float(x) for x in v]) for i, v in enumerate(base)]
    queries = [(i, [float(x) for x in rng.standard_normal(16)]) for i in range(20)] + [(99, rows[100][1])]
    return (spark.createDataFrame(rows, "tile_id string, embedding array<double>").repartition(5),
            spark.createDataFrame(queries, "query_id int, vector array<double>"), base, queries)


def brute(base, queries, k):
    unit = base / np.linalg.norm(base, axis=1, keepdims=True)
    out = {}
    for q, vec in queries:
        s = np.round(unit @ (np.array(vec) / np.linalg.norm(vec)), 9)
        order = sorted(range(len(s)), key=lambda i: (-s[i], f"t{i:03d}"))[:k]
        out[q] = [f"t{i:03d}" for i in order]
    return out


def collected(df):
    out = {}
    for r in df.orderBy("query_id", "vec_rank").collect():
        out.setdefault(r.query_id, []).append(r.tile_id)
    return out


@pytest.mark.parametrize("values, cells", [(10**6, 10**6), (100, 60)])
def test_topk_in_blocks_of_queries_and_scores(points, monkeypatch, values, cells):
    p, q, base, queries = points
    monkeypatch.setattr(vectors, "SCORE_CELLS", cells)
    assert collected(vectors.vector_topk(p, q, 7, block_values=values)) == brute(base, queries, 7)
    assert vectors.vector_topk(p, q.limit(0), 7).count() == 0 == vectors.vector_topk(p.limit(0), q, 7).count()


def test_blocks_split_hot_buckets(points):
    p, q, base, queries = points
    hits = vectors._block_topk(p.withColumn("bucket", F.lit(0)), q.withColumn("bucket", F.lit(0)), 7, point_block=40, query_block=6)
    assert collected(vectors._ranked(hits, 7)) == brute(base, queries, 7)


def test_ann_recall(points):
    p, q, base, queries = points
    exact, approx = brute(base, queries, 5), collected(vectors.vector_topk_ann(p, q, 5))
    recall = np.mean([len(set(exact[k]) & set(approx.get(k, []))) / 5 for k in exact])
    assert recall >= 0.9


def test_prefilter_keeps_recall(spark):
    pts = spark.createDataFrame([(f"t{i}", [1.0, i / 1000.0]) for i in range(40)], "tile_id string, embedding array<double>")
    prof = spark.createDataFrame([("t39", "ennore", ["WATER_FLOOD"], "c", "d", 2024)], "tile_id string, aoi string, primary_types array<string>, category string, description string, year int")
    vectors.register_embedder("fixed", lambda c: F.array(F.lit(1.0), F.lit(0.0)))
    q = spark.createDataFrame([(1, "flood in Ennore 2024")], "query_id int, query string")
    assert search.semantic_search(q, pts, prof, 5, embed="fixed").count() == 0
    hit = search.semantic_search(q, pts, prof, 5, embed="fixed", prefilter=True).collect()
    assert [h.tile_id for h in hit] == ["t39"] and hit[0].relevance == 98.8


def test_catalog_fallback_and_text_search(spark):
    prof = search.profile_table(spark)
    none = spark.createDataFrame([], "tile_id string")
    assert search.catalog_fallback(none, prof).count() == 4
    assert search.catalog_fallback(prof.select("tile_id"), prof).count() == 0
    assert search.text_search(prof, "flood", ("category", "description")).count() == 1
    assert search.text_search(prof, "zzz", ("category", "description")).count() == 4


def test_execute_search_answers_every_query(spark):
    prof = search.profile_table(spark)
    vectors.register_embedder("fixed", lambda c: F.array(F.lit(1.0), F.lit(0.0)))
    q = spark.createDataFrame([(1, "flood near the Krishna delta"), (2, "new construction in New Delhi"), (3, "flood")],
                              "query_id long, query string")
    none = spark.createDataFrame([], "tile_id string, embedding array<double>")
    got = {r.query_id: r for r in search.execute_search(q, none, prof, 10, embed="fixed").collect()}
    assert [got[i].coverage for i in (1, 2, 3)] == ["AVAILABLE", "UNAVAILABLE", "AVAILABLE"]
    tiles = {r.tile_id: r.aoi for r in prof.collect()}
    assert {h.tile_id for h in got[3].results} == set(tiles) and got[2].results == []
    assert got[1].results and all(tiles[h.tile_id] == "krishna" for h in got[1].results)
    one = spark.createDataFrame([("other", [1.0, 0.0])], "tile_id string, embedding array<double>")
    full = {r.query_id: r for r in search.execute_search(q, one, prof, 10, embed="fixed").collect()}
    assert [h.tile_id for h in full[3].results] == ["other"] and full[1].results == []
    assert full[3].message == "Retrieved 1 verified satellite observation scenes."


def test_phrases_equal_plain_search(spark):
    """Whole words, tokens and substrings against Python's own search."""
    import random

    rng = random.Random(3)
    words = ["new", "green", "cover", "port", "built-up", "sea", "x_1", "ñandú", "2024", "evergreen", "covers"]
    texts = [rng.choice(["", " ", "!"]).join([""] * 2) + rng.choice([" ", "  ", "-", ", "]).join(rng.choices(words, k=rng.randint(0, 7))) for _ in range(150)]
    entries = ([(p, "words") for p in ("new", "green cover", "port", "built-up", "sea port", "new  green", "x_1", "ñandú", "cover, port")]
               + [(p, "token") for p in ("built-up", "port", "new-green", "2024")] + [(p, "anywhere") for p in ("green cover", "n c", "r p")])
    table = spark.createDataFrame(entries, "phrase string, how string")
    frame = spark.createDataFrame([(t,) for t in [*texts, texts[0], None]], "q string")
    got = sorted({tuple(r) for r in phrases.phrase_hits(frame, "q", table).select("q", "how", "phrase").collect()})
    want = set()
    for t in texts:
        low = t.strip(" ").lower()
        for p, how in entries:
            hit = {"words": re.search(rf"(?<!\w){re.escape(p)}(?!\w)", low), "token": p in re.findall(r"\b[\w\-]+\b", low), "anywhere": p in low}[how]
            if hit:
                want.add((t, how, p))
    assert got == sorted(want) and len(want) > 100


def test_a_hundred_thousand_names(spark):
    n = 100_000
    names = spark.range(n).select(
        F.concat(F.lit("town "), F.col("id").cast("string"), F.when(F.col("id") % 3 == 0, " east").otherwise("")).alias("phrase"),
        F.lit("words").alias("how"), F.col("id").cast("int").alias("ordinal"), F.lit(None).cast("string").alias("aoi"),
        F.lit(None).cast("string").alias("aoi_name"), F.concat(F.lit("Town No. "), F.col("id").cast("string")).alias("place"),
        F.lit(None).cast("string").alias("category"))
    queries = spark.createDataFrame([(0, "floods at Town 99999 East and town 4"), (1, "town 7x"), (2, "in town 3"), (3, None)], "query_id int, query string")
    parsed = search.parse_queries(queries, phrases=names)
    text = parsed._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in text and "Cartesian" not in text
    got = {r.query_id: r.requested_location for r in parsed.collect()}
    assert got == {0: "Town No. 4", 1: None, 2: "Town", 3: None}  # "town 3" is only listed with "east"


def test_phrases_that_cannot_be_looked_up(spark):
    queries = spark.createDataFrame([("a b",)], "q string")
    for phrase, how in ((" a", "words"), ("a-", "words"), ("ab", "anywhere")):
        with pytest.raises(Exception, match="looked up|not a phrase"):
            phrases.phrase_hits(queries, "q", spark.createDataFrame([(phrase, how)], "phrase string, how string")).collect()
