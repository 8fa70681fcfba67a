"""Memory of the vector search, on rows of the tests' own."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from scenelake.operators import vectors


def points_and_queries(spark, n, m):
    rng = np.random.default_rng(4)
    base, asked = np.round(rng.normal(size=(n, 6)), 1), np.round(rng.normal(size=(m, 6)), 1)
    base[n // 2:n // 2 + 20] = base[0]  # equal scores in several blocks
    p = spark.createDataFrame([(f"t{i:04d}", [*map(float, r)], "a" if i % 5 == 0 else "") for i, r in enumerate(base)],
                              "tile_id string, embedding array<double>, aoi string").repartition(3)
    q = spark.createDataFrame([(i, [*map(float, r)], "a" if i % 7 == 0 else "") for i, r in enumerate(asked)],
                              "query_id long, vector array<double>, aoi string").repartition(2)
    return base, asked, p, q


def test_a_key_of_the_pairing_holds_few_points(spark):
    """the join held all packed points of a bucket beside each part of the queries."""
    _, _, p, q = points_and_queries(spark, 600, 40)
    pairs = vectors._pairs(p, q, 30, "aoi")
    keys = ["_part", "bucket", "_group"]
    held = pairs.groupBy(*keys).agg(F.size(F.collect_set("tile_id")).alias("n")).agg(F.max("n").alias("n")).first().n
    assert held <= 2 * vectors.GROUP_BLOCKS  # of 96 full blocks in one bucket
    met = pairs.select("bucket", F.explode("query_id").alias("q"), "tile_id").select("bucket", "q", F.explode("tile_id").alias("t"))
    own = p.select("tile_id", F.col("aoi").alias("b")).join(q.select("query_id", F.col("aoi").alias("c")), F.col("b") == F.col("c"))
    assert met.count() == met.distinct().count() == own.count()


def test_best_points_of_many_blocks_are_merged(spark, monkeypatch):
    """every pair of blocks gave k rows per query to the shuffle; now blocks met in a row give them together."""
    base, asked, p, q = points_and_queries(spark, 600, 40)
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    want = {}
    for i, v in enumerate(unit(asked)):
        mine = [j for j in range(600) if (j % 5 == 0) == (i % 7 == 0)]
        score = np.round(unit(base) @ v, 9) + 0.0
        want[i] = [(f"t{j:04d}", round(score[j], 6)) for j in sorted(mine, key=lambda j: (-score[j], j))[:7]]
    for most in (vectors.FOUND_ROWS, 50):
        monkeypatch.setattr(vectors, "FOUND_ROWS", most)
        got = vectors.vector_topk(p, q, 7, block_values=30, bucket="aoi")
        found = {}
        for r in got.orderBy("query_id", "vec_rank").collect():
            found.setdefault(r.query_id, []).append((r.tile_id, round(r.score, 6)))
        assert found == want


def test_a_query_gets_k_hits_from_several_blocks():
    """hits of blocks met one after the other are cut to k per query, equal scores by id."""
    import pyarrow as pa

    parts = [pa.table({"q": [0, 0, 1], "score": [0.5, 0.4, 0.1], "tile_id": ["c", "d", "e"]}),
             pa.table({"q": [0, 1, 1], "score": [0.5, 0.3, 0.1], "tile_id": ["a", "b", "a"]})]
    assert [*zip(*vectors._best_hits(parts, 2).to_pydict().values())] == [(0, 0.5, "a"), (0, 0.5, "c"), (1, 0.3, "b"), (1, 0.1, "a")]


def test_blocks_are_packed_without_loss():
    import pyarrow as pa

    for matrix in (np.random.default_rng(1).normal(size=(7, 5)), np.zeros((3, 512)), np.array([[np.nan, -0.0]])):
        block = vectors._packed(matrix)
        assert vectors._unpacked(pa.py_buffer(block), len(matrix)).tobytes() == matrix.tobytes()
    assert len(vectors._packed(np.zeros((300, 512)))) < 300 * 512


def test_texts_are_embedded_a_few_at_a_time(spark):
    """a worker held the vectors of 10,000 texts several times over."""
    n = 2 * vectors.EMBED_ROWS + 7
    out = [*vectors._accumulate.func(iter([pd.Series([[i % 512] for i in range(n)]), pd.Series([], dtype=object)]))]
    assert sum(map(len, out)) == n and max(map(len, out)) <= vectors.EMBED_ROWS
    df = spark.range(n).coalesce(1).select("id", F.concat(F.lit("river "), F.col("id").cast("string")).alias("t"))
    assert df.select("id", vectors.text_embed(F.col("t")).alias("v")).where("size(v) = 512").count() == n
