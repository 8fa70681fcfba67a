"""Vector index operators: upsert, exact and approximate top-k, embeddings.

Points and queries are put into blocks of bounded size. A task scores a block
of queries against a block of points with matrix products and keeps k points
per query, so candidate pairs never become rows; blocks, and k rows per query
and block of points, are shuffled, and no vector passes through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from scenelake.functions.text import sha256_bucket, uuid5_dns, words
from scenelake.lookups import EMBEDDING_DIM, KEYWORD_SLOTS, KEYWORD_WEIGHTS, SLOT_WIDTH
from scenelake.operators.blocks import unroll

# Numbers (rows x dimension) and rows of one block, and scores a task holds at a time.
BLOCK_VALUES = 1_000_000
BATCH_BYTES = 8 << 20
POINT_BLOCK = 40_000
QUERY_BLOCK = 40_000
SCORE_CELLS = 2_000_000
# Blocks of points that a join holds at a time, hits a task keeps before it cuts them, texts embedded at a time.
GROUP_BLOCKS = 8
FOUND_ROWS = 500_000
EMBED_ROWS = 500
# Vector index where the 4 x 4 texture grid of an image embedding starts.
TEXTURE_START = 40


def upsert_points(log: DataFrame, seq: str) -> DataFrame:
    """Latest version of each tile, keyed by a name-based point id, with payload defaults."""
    rows = log.withColumn("point_id", uuid5_dns(F.col("tile_id")))
    fields = [c for c in log.columns if c != seq]
    latest = rows.groupBy("point_id").agg(F.max_by(F.struct(*fields), F.col(seq)).alias("p"))
    defaults = {"title": F.col("p.tile_id"), "thumbnail": F.lit(""), "latitude": F.lit(0.0), "longitude": F.lit(0.0),
                "acquisition_date": F.lit(""), "sensor": F.lit("Sentinel-2"), "confidence": F.lit(0.90)}
    return latest.select("point_id", *[
        F.coalesce(F.col("p")[c], defaults[c]).alias(c) if c in defaults else F.col("p")[c].alias(c) for c in fields])


def index_count(points: DataFrame) -> DataFrame:
    return points.agg(F.count("*").alias("n_points"))


def _unit(matrix: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(norm == 0, 1.0, norm)


def _dense(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _hit_schema(points: DataFrame, queries: DataFrame) -> T.StructType:
    return T.StructType([
        T.StructField("query_id", queries.schema["query_id"].dataType),
        T.StructField("tile_id", points.schema["tile_id"].dataType), T.StructField("score", T.DoubleType())])


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "tile_id")
    return hits.withColumn("vec_rank", F.row_number().over(order)).where(F.col("vec_rank") <= k)


def _best_of(vectors: np.ndarray, points: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, point, score) of the k best points of every query; equal scores prefer the earlier point.

    A few points bound the k-th score from below, so that most scores are only compared; at most ``SCORE_CELLS`` are held.
    """
    found = []
    step, some = max(1, SCORE_CELLS // max(1, len(points))), max(1, min(8, len(points) // (4 * k)))
    for start in range(0, len(vectors), step):
        raw = vectors[start:start + step] @ points.T
        few = raw[:, ::some]
        least = np.partition(few, few.shape[1] - k, axis=1)[:, few.shape[1] - k] if few.shape[1] > k else np.full(len(raw), -np.inf)
        least = np.where(np.isnan(few).any(axis=1), -np.inf, least - 2e-9)  # scores are rounded to nine digits
        q, at = np.divmod(np.flatnonzero(raw >= least[:, None]), len(points))
        score = np.round(raw[q, at], 9) + 0.0
        order = np.lexsort((at, -score, q))
        q, at, score = q[order], at[order], score[order]
        keep = np.arange(len(q)) - np.searchsorted(q, q) < k
        found.append((q[keep] + start, at[keep], score[keep]))
    return tuple(np.concatenate(parts) for parts in zip(*found))


def _block_topk(points: DataFrame, queries: DataFrame, k: int, point_block: int = POINT_BLOCK,
                query_block: int = QUERY_BLOCK, values: int = 4 * BLOCK_VALUES) -> DataFrame:
    """Top-k inside each ``bucket`` by blocks of bounded size.

    A bucket is split into point blocks and query blocks by hash, however many
    rows it holds, each of about so many rows and ``values`` numbers at most;
    every block pair is scored by matrix products and returns k rows per query.
    """
    def blocks(count: str, size: int) -> Column:
        rows = F.greatest(F.lit(1.0), F.least(F.lit(float(size)), F.floor(F.lit(float(values)) / F.col("_d"))))
        return F.ceil(F.col(count) / rows).cast("int")

    # One row per bucket; buckets are numbered by hash table and signature, 128 by default.
    sizes = points.groupBy("bucket").agg(F.count("*").alias("_n"), F.greatest(F.lit(1), F.max(F.size("embedding"))).alias("_d"))
    grid = F.broadcast(sizes.join(queries.groupBy("bucket").agg(F.count("*").alias("_m")), "bucket").select(
        "bucket", blocks("_n", point_block).alias("n_p"), blocks("_m", query_block).alias("n_q")))

    def place(df: DataFrame, own: str, other: str, own_n: str, other_n: str, ident: str, value: str) -> DataFrame:
        placed = df.join(grid, "bucket").withColumn(own, F.pmod(F.xxhash64(ident), F.col(own_n)).cast("int"))
        copies = F.explode(F.sequence(F.lit(0), F.col(other_n) - 1)).alias(other)
        return placed.select(F.col("bucket").alias("bucket"), ident, value, own, copies)

    p = place(points, "_p", "_q", "n_p", "n_q", "tile_id", "embedding")
    q = place(queries, "_q", "_p", "n_q", "n_p", "query_id", "vector")

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({c: pd.Series([], dtype=object) for c in ("query_id", "tile_id", "score")})
        left = left.sort_values("tile_id", kind="stable")
        a = _unit(np.stack(left["embedding"].to_numpy()).astype(np.float64))
        b = _unit(np.stack(right["vector"].to_numpy()).astype(np.float64))
        at_query, at_point, scores = _best_of(b, a, k)
        names, tiles = (df[c].to_numpy(dtype=object) for df, c in ((right, "query_id"), (left, "tile_id")))
        return pd.DataFrame({"query_id": pd.Series(names[at_query], dtype=object),
                             "tile_id": pd.Series(tiles[at_point], dtype=object), "score": scores})

    keys = ["bucket", "_p", "_q"]
    return p.groupBy(*keys).cogroup(q.groupBy(*keys)).applyInPandas(score, _hit_schema(points, queries))


def _packed(matrix: np.ndarray) -> bytes:
    """Doubles as bytes: their number, then all of them compressed."""
    return matrix.size.to_bytes(8, "little") + pa.compress(matrix.tobytes(), "lz4", asbytes=True)


def _unpacked(block: pa.Buffer, rows: int) -> np.ndarray:
    size = int.from_bytes(block[:8].to_pybytes(), "little") * 8
    return np.frombuffer(pa.decompress(block[8:], size, "lz4"), np.float64).reshape(rows, -1)


def _packs(df: DataFrame, ident: str, value: str, bucket: Column, block_values: int) -> DataFrame:
    """Rows of about ``block_values`` numbers: bucket, ids in ascending order and their unit vectors (``_packed``)."""
    kind = df.schema[ident].dataType
    schema = T.StructType([T.StructField("bucket", T.StringType()), T.StructField(ident, T.ArrayType(kind)), T.StructField(value, T.BinaryType())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[str, list] = {}

        def packed(name: str) -> pa.RecordBatch:
            parts = waiting.pop(name)
            ids, matrix = pa.concat_arrays([p for p, _ in parts]), np.concatenate([m for _, m in parts])
            order = pc.sort_indices(ids)
            return pa.RecordBatch.from_arrays([
                pa.array([name]), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids.take(order)),
                pa.array([_packed(matrix[order.to_numpy()])], pa.binary())], [f.name for f in schema])

        for batch in batches:
            for name in pc.unique(batch.column(2)).to_pylist():
                own = batch.filter(pc.equal(batch.column(2), name))
                matrix = _unit(_dense(own.column(1)))
                step = max(1, block_values // max(1, matrix.shape[1]))
                for start in range(0, len(matrix), step):
                    waiting.setdefault(name, []).append((own.column(0).slice(start, step), matrix[start:start + step]))
                    if sum(m.size for _, m in waiting[name]) >= block_values:
                        yield packed(name)
        for name in list(waiting):
            yield packed(name)

    return df.select(ident, value, bucket.cast("string").alias("bucket")).mapInArrow(pack, schema)


def _best_hits(found: list[pa.Table], k: int) -> pa.Table:
    """The k best hits of every query (its place in the block) among those of several blocks of points."""
    if len(found) < 2:
        return found[0]
    hits = pa.concat_tables(found)
    order = pc.sort_indices(hits, sort_keys=[("q", "ascending"), ("score", "descending"), ("tile_id", "ascending")], null_placement="at_start")
    hits = hits.take(order)
    q = hits["q"].to_numpy()
    return hits.filter(pa.array(np.arange(len(q)) - np.searchsorted(q, q) < k))


def _pairs(points: DataFrame, queries: DataFrame, block_values: int, bucket: str | None) -> DataFrame:
    """Every block of queries beside every block of points of its bucket.

    Points of a bucket are dealt into groups of about ``GROUP_BLOCKS`` blocks,
    queries into two parts a core: a key of the join is one part and one group,
    because a merge join holds the points of a key in memory.
    """
    parts = 2 * points.sparkSession.sparkContext.defaultParallelism
    own = F.lit("") if bucket is None else F.col(bucket)
    rows = F.floor(F.lit(float(GROUP_BLOCKS * block_values)) / F.greatest(F.lit(1), F.max(F.size("embedding"))))
    sizes = F.broadcast(points.groupBy(own.cast("string").alias("bucket")).agg(
        F.ceil(F.count("*") / F.greatest(F.lit(1), rows)).cast("int").alias("_groups")))
    at = F.monotonically_increasing_id()  # the task's number above 33 bits of the row's
    p = _packs(points, "tile_id", "embedding", own, block_values).withColumn(
        "_at", F.shiftright(at, 33) + at.bitwiseAND((1 << 33) - 1)).join(sizes, "bucket")
    q = _packs(queries, "query_id", "vector", own, block_values).withColumn("_block", at).join(sizes, "bucket")
    p = p.withColumn("_group", F.pmod("_at", "_groups").cast("int")).withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    q = q.withColumn("_part", F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int")).withColumn(
        "_group", F.explode(F.sequence(F.lit(0), F.col("_groups") - 1)))
    # The merge keeps both out of the driver.
    return q.drop("_groups").hint("merge").join(p.drop("_groups", "_at"), ["_part", "bucket", "_group"])


def vector_topk(points: DataFrame, queries: DataFrame, k: int = 10, block_values: int = BLOCK_VALUES,
                bucket: str | None = None) -> DataFrame:
    """Exact cosine top-k: points(tile_id, embedding), queries(query_id, vector).

    Both tables are packed into blocks of about ``block_values`` numbers; blocks
    of queries meet groups of blocks of points, and keep k points per query from
    the blocks that they meet one after the other. No vector passes through the
    driver. Where both have a column ``bucket``, a query searches the points of
    its own one.
    """
    schema = _hit_schema(points, queries)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, names, vectors, found = None, None, None, []

        def best() -> pa.RecordBatch:
            q, scores, tiles = (c.combine_chunks() for c in _best_hits(found, k).columns)
            return pa.RecordBatch.from_arrays([names.take(q), tiles, scores], [f.name for f in schema])

        for batch in batches:
            for i in range(batch.num_rows):
                if batch.column(4)[i].as_py() != block:
                    if found:
                        yield best()
                    block, names, found = batch.column(4)[i].as_py(), batch.column(0)[i].values, []
                    vectors = _unpacked(batch.column(1)[i].as_buffer(), len(names))
                tiles = batch.column(2)[i].values
                at_query, at_point, scores = _best_of(vectors, _unpacked(batch.column(3)[i].as_buffer(), len(tiles)), k)
                found.append(pa.table({"q": at_query, "score": scores, "tile_id": tiles.take(pa.array(at_point))}))
                if sum(map(len, found)) > FOUND_ROWS:
                    found = [_best_hits(found, k)]
        if found:
            yield best()

    # A batch for Python holds few pairs, however many rows Spark puts into one otherwise.
    points.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    pairs = _pairs(points, queries, block_values, bucket).select("query_id", "vector", "tile_id", "embedding", "_block")
    return _ranked(pairs.mapInArrow(score, schema), k)


def _signatures(df: DataFrame, ident: str, vector: str, tables: int, planes: int, seed: int, probes: int) -> DataFrame:
    """One row per hash table (and flipped bit when probing) with the bucket of the vector."""
    schema = T.StructType([df.schema[ident], df.schema[vector], T.StructField("bucket", T.LongType())])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _dense(batch.column(1))
            normals = np.random.default_rng(seed).standard_normal((x.shape[1], tables * planes))
            dots = (x @ normals).reshape(len(x), tables, planes)
            bits = (dots > 0).astype(np.int64)
            codes = (bits << np.arange(planes)).sum(axis=2)
            order = np.argsort(np.abs(dots), axis=2)
            variants = [codes] + [codes ^ (1 << order[:, :, i]) for i in range(probes)]
            for code in variants:
                for t in range(tables):
                    bucket = pa.array(code[:, t] + (t << planes), type=pa.int64())
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), bucket], schema=pa.schema(
                        [batch.schema.field(0), batch.schema.field(1), pa.field("bucket", pa.int64())]))

    return df.select(ident, vector).mapInArrow(sign, schema)


def vector_topk_ann(points: DataFrame, queries: DataFrame, k: int = 10, tables: int = 8, planes: int = 4,
                    probes: int = 2, seed: int = 7) -> DataFrame:
    """Approximate top-k: random-hyperplane buckets, exact scores inside a bucket.

    Queries also look into the ``probes`` nearest buckets of every table. Hot
    buckets are split, never cut.
    """
    p = _signatures(points, "tile_id", "embedding", tables, planes, seed, 0)
    q = _signatures(queries, "query_id", "vector", tables, planes, seed, probes)
    hits = _block_topk(p, q, k).groupBy("query_id", "tile_id").agg(F.max("score").alias("score"))
    return _ranked(hits, k)


def _unit_sums(codes: pd.Series) -> pd.Series:
    """Sum token weights into one unit vector per text, all texts at once; a text without words is the first axis.

    A code holds the token's hash and, above it, its keyword slot plus one.
    """
    n = len(codes)
    sizes = np.fromiter(map(len, codes), np.int64, n)
    code = np.concatenate([np.asarray(c, dtype=np.int64) for c in codes]) if n else np.zeros(0, np.int64)
    row = np.repeat(np.arange(n), sizes) * EMBEDDING_DIM
    h, slot = code % EMBEDDING_DIM, code // EMBEDDING_DIM
    named = slot > 0
    start = (slot[named] - 1) * SLOT_WIDTH
    at = [row + h, row + (h * 3 + 7) % EMBEDDING_DIM] + [row[named] + (start + i) % EMBEDDING_DIM for i in range(len(KEYWORD_WEIGHTS))]
    weights = np.repeat([1.0, 0.5, *KEYWORD_WEIGHTS], [len(a) for a in at])
    total = np.bincount(np.concatenate(at), weights, minlength=n * EMBEDDING_DIM).reshape(n, EMBEDDING_DIM)
    total[sizes == 0, 0] = 1.0
    return pd.Series(list(total / np.linalg.norm(total, axis=1, keepdims=True)))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _accumulate(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Vectors of few texts at a time: a batch of vectors is much larger than one of tokens."""
    for codes in batches:
        for start in range(0, len(codes), EMBED_ROWS):
            yield _unit_sums(codes[start:start + EMBED_ROWS])


def text_embed(text: Column) -> Column:
    """512-dim unit vector of a text: hashed tokens plus keyword slots. No shuffle."""
    slots = F.create_map(*[F.lit(x) for word, slot in KEYWORD_SLOTS.items() for x in (word, slot + 1)])

    def code(token: Column) -> Column:
        slot = F.when(token.isin(list(KEYWORD_SLOTS)), F.try_element_at(slots, token)).otherwise(F.lit(0))
        return sha256_bucket(token, EMBEDDING_DIM) + slot * EMBEDDING_DIM

    return _accumulate(F.transform(words(text), code))


def image_embed(blocks: DataFrame, key: str, height: Column, bands: Sequence[str] = ("r", "g", "b")) -> DataFrame:
    """512-dim unit vector of each block from channel rules and a 4 x 4 texture grid.

    All figures come from per-cell sums, so the pixels are aggregated once. The
    grid overwrites slots 40..71.
    """
    px = unroll(blocks.withColumn("_h", height).withColumn("_w", F.col("width")), [key, "_h", "_w"], bands)

    def cell(pos: str, size: str) -> Column:
        """Grid line i starts at i * size div 4."""
        first, *rest = [(F.col(pos) >= F.floor(F.col(size) * i / 4.0)).cast("int") for i in (1, 2, 3)]
        return first + rest[0] + rest[1]

    moments = [agg for b in bands for agg in (F.avg(b).alias(f"m_{b}"), F.var_pop(b).alias(f"v_{b}"))]
    cells = px.groupBy(key, (cell("y", "_h") * 4 + cell("x", "_w")).alias("cell")).agg(
        F.count("*").alias("n"), F.greatest(*[F.max(b) for b in bands]).alias("top"), *moments)
    mean = sum(F.col(f"m_{b}") for b in bands) / len(bands)
    spread = sum(F.col(f"v_{b}") + (F.col(f"m_{b}") - mean) * (F.col(f"m_{b}") - mean) for b in bands) / len(bands)
    cells = cells.withColumn("m", mean).withColumn("d", F.sqrt(spread))
    # At most 16 cells; images below four pixels a side leave some out.
    tile = cells.groupBy(key).agg(
        F.max("top").alias("top"), F.sum(F.col("m") * F.col("m") + F.col("d") * F.col("d")).alias("energy"), F.sum("n").alias("n"),
        F.collect_list(F.struct("cell", "n", "m", "d", *[f"{p}_{b}" for p in ("m", "v") for b in bands])).alias("cells"))
    tile = tile.withColumn("scale", F.when(F.col("top") > 1.0, 1.0 / 255.0).otherwise(1.0))

    def over_cells(value) -> Column:
        return F.aggregate("cells", F.lit(0.0), lambda acc, c: acc + c["n"] * value(c)) / F.col("n")

    def band_mean(b: str) -> Column:
        return over_cells(lambda c: c[f"m_{b}"])

    def band_std(b: str) -> Column:
        away = lambda c: c[f"m_{b}"] - F.col(f"raw_{b}")
        return F.sqrt(over_cells(lambda c: c[f"v_{b}"] + away(c) * away(c))) * F.col("scale")

    tile = tile.withColumns({f"raw_{b}": band_mean(b) for b in bands})
    tile = tile.withColumns({f"m_{b}": F.col(f"raw_{b}") * F.col("scale") for b in bands})
    std = {b: band_std(b) for b in bands}
    r, g, b = (F.col(f"m_{x}") for x in bands)
    tile = tile.select(
        key, "cells", "scale", "energy", ((g - r) / (g + r + 1e-6)).alias("veg"),
        (((b - r) / (b + r + 1e-6) > 0.05) | (b > r + 0.05)).alias("wet"),
        ((r + g + b) / 3.0).alias("bright"), (sum(std[x] for x in bands) / 3.0).alias("contrast"))
    veg = F.when(F.col("veg") > 0.05, F.col("veg")).otherwise(F.lit(0.0))
    wet = F.col("wet").cast("double")
    built = ((F.col("bright") > 0.45) & (F.col("contrast") > 0.15)).cast("double")
    dark = ((F.col("bright") < 0.25) & (F.col("contrast") > 0.18)).cast("double")
    rules = {"vegetation": veg * 4.0, "agriculture": veg * 3.0, "water": wet * 4.0, "river": wet * 3.0,
             "flood": wet * 2.0, "construction": built * 4.0, "urban": built * 3.5, "building": built * 3.0,
             "solar": dark * 4.0, "industrial": dark * 3.0}
    texture_end = TEXTURE_START + 32
    placed = sorted((KEYWORD_SLOTS[n] * SLOT_WIDTH, n) for n in rules
                    if not TEXTURE_START <= KEYWORD_SLOTS[n] * SLOT_WIDTH < texture_end)
    ruled = sum(rules[n] * rules[n] for _, n in placed)
    tile = tile.withColumn("norm", F.sqrt(ruled + F.col("energy") * F.col("scale") * F.col("scale")))

    # Segments in slot order: zeros, single rule slots, and the texture grid.
    unit = F.col("norm")
    places = F.map_from_entries(F.transform("cells", lambda c: F.struct(c["cell"].alias("k"), F.struct(c["m"].alias("m"), c["d"].alias("d")).alias("v"))))
    tile = tile.withColumn("places", places)

    def shade(i: Column, part: str) -> Column:
        return F.coalesce(F.try_element_at("places", i)[part], F.lit(0.0)) * F.col("scale") / unit

    texture = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.array(shade(i, "m"), shade(i, "d"))))
    segments, at = [], 0
    for slot, part, width in sorted([(slot, F.array(rules[n] / unit), 1) for slot, n in placed]
                                    + [(TEXTURE_START, texture, 32)], key=lambda t: t[0]):
        if slot > at:
            segments.append(F.array_repeat(F.lit(0.0), slot - at))
        segments.append(part)
        at = slot + width
    segments.append(F.array_repeat(F.lit(0.0), EMBEDDING_DIM - at))
    axis = F.concat(F.array(F.lit(1.0)), F.array_repeat(F.lit(0.0), EMBEDDING_DIM - 1))
    return tile.select(key, F.when(F.col("norm") > 0, F.concat(*segments)).otherwise(axis).alias("embedding"))


_EMBEDDERS = {}


def register_embedder(name: str, embed) -> None:
    """Offer another text embedder (Column -> Column of array<double>), for instance a pandas UDF."""
    _EMBEDDERS[name] = embed


def embedder(name: str = "hashed"):
    return text_embed if name == "hashed" else _EMBEDDERS[name]
