"""Sharding by Karmarkar-Karp differencing: shards of near-equal bytes from groups that must not be split.

A partial partition is a list of k sums. Differencing repeatedly takes the two
partial partitions of largest spread and adds them in opposite order, largest
to smallest. Groups of equal texts are dealt by hash into buckets of bounded
size; each bucket is differenced in its own task down to one partial
partition, whose k sums are differenced again with those of the other buckets.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from scenelake.llm.common import materialise

SHARDS = 24
ROW_BYTES = 8  # counted for a row besides its text
BUCKET_GROUPS = 4_000  # groups differenced in one task
FAN_IN = 512  # partial partitions differenced together
SPLIT = 64  # parts in which the rows of one group are numbered


def differencing(sums: np.ndarray) -> np.ndarray:
    """Final part (0 .. k - 1) of every slot of ``sums`` (items, k), by size descending in each row."""
    items, k = sums.shape
    if not items:
        return np.zeros((0, k), dtype=np.int64)
    order = np.argsort(-sums, axis=1, kind="stable")
    vectors = dict(enumerate(np.take_along_axis(sums, order, axis=1)))
    heap = [(int(v[-1] - v[0]), i) for i, v in vectors.items()]
    heapq.heapify(heap)
    merged = []  # (first, second, order) of node items + position
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        total = vectors.pop(a) + vectors.pop(b)[::-1]
        by_size = np.argsort(-total, kind="stable")
        node = items + len(merged)
        merged.append((a, b, by_size.astype(np.int16)))
        vectors[node] = total[by_size]
        heapq.heappush(heap, (int(vectors[node][-1] - vectors[node][0]), node))
    labels = {heap[0][1]: np.arange(k)}
    for position in range(len(merged) - 1, -1, -1):
        a, b, by_size = merged[position]
        part = labels.pop(items + position)
        labels[a], labels[b] = np.empty(k, dtype=np.int64), np.empty(k, dtype=np.int64)
        labels[a][by_size] = part
        labels[b][k - 1 - by_size] = part
    out = np.empty((items, k), dtype=np.int64)
    for i in range(items):
        out[i, order[i]] = labels[i]
    return out


def _bucket_parts(k: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("digest", kind="stable").reset_index(drop=True)
        sums = np.zeros((len(rows), k), dtype=np.int64)
        sums[:, 0] = rows["bytes"]
        rows["part"] = differencing(sums)[:, 0]
        rows["base"] = rows.groupby("part")["n"].cumsum() - rows["n"]
        return rows
    return run


def _combine(k: int, key: str):
    """Difference the partial partitions of several buckets; a bucket's missing parts are empty."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        buckets = np.sort(rows["bucket"].unique())
        sums = np.zeros((len(buckets), k), dtype=np.int64)
        sums[np.searchsorted(buckets, rows["bucket"]), rows["part"]] = rows["bytes"]
        labels = differencing(sums)
        return pd.DataFrame({"bucket": np.repeat(buckets, k), "part": np.tile(np.arange(k), len(buckets)),
                             key: int(rows[key].iloc[0]), "label": labels.ravel()})
    return run


def _place_buckets(partials: DataFrame, n_buckets: int, k: int) -> DataFrame:
    """(bucket, part, label): differencing over buckets, level by level of at most ``FAN_IN`` together."""
    placed = None
    current, left = partials.select("bucket", "part", "bytes"), n_buckets
    while True:
        above = current.withColumn("parent", (F.floor(F.col("bucket") / FAN_IN)).cast("long"))
        step = materialise(above.groupBy("parent").applyInPandas(
            _combine(k, "parent"), "bucket long, part long, parent long, label long"))
        if placed is None:
            placed = step
        else:
            up = step.select(F.col("bucket").alias("parent"), F.col("part").alias("label"),
                             F.col("parent").alias("_parent"), F.col("label").alias("_label"))
            placed = placed.join(up, ["parent", "label"]).select(
                "bucket", "part", F.col("_parent").alias("parent"), F.col("_label").alias("label"))
        left = math.ceil(left / FAN_IN)
        if left <= 1:
            return placed.select("bucket", "part", "label")
        current = current.join(step, ["bucket", "part"]).groupBy(
            F.col("parent").alias("bucket"), F.col("label").alias("part")).agg(F.sum("bytes").alias("bytes"))


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, digest, shard, slot.

    Rows of equal text (null like empty) stay together; sizes are UTF-8 bytes
    plus 8. Slots number the rows of a shard from 0 without gaps, by bucket,
    text and doc_id; repeated rows get slots of their own. An empty table gives
    an empty result; further columns are ignored.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # Half of a SHA-256 names a text.
    rows = materialise(docs.select(
        "doc_id", (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.unhex(F.substring(F.sha2(text, 256), 1, 32)).alias("digest")))
    # Rows of one large group are counted and numbered in parts.
    rows = rows.withColumn("split", F.pmod(F.xxhash64("doc_id"), F.lit(SPLIT)).cast("int"))
    parts = rows.groupBy("digest", "split").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    groups = parts.groupBy("digest").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))
    n_buckets = max(1, math.ceil(groups.count() / BUCKET_GROUPS))
    dealt = groups.withColumn("bucket", F.pmod(F.xxhash64("digest"), F.lit(n_buckets)).cast("long"))
    within = materialise(dealt.groupBy("bucket").applyInPandas(
        _bucket_parts(shards), "digest binary, n long, bytes long, bucket long, part long, base long"))
    partials = within.groupBy("bucket", "part").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n"))
    # At most one row per bucket and shard.
    before = Window.partitionBy("label").orderBy("bucket", "part").rowsBetween(Window.unboundedPreceding, -1)
    places = _place_buckets(partials, n_buckets, shards).join(partials, ["bucket", "part"]).select(
        "bucket", "part", F.col("label").alias("shard"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shard_base"))
    placed = within.join(places, ["bucket", "part"]).select(
        "digest", F.col("shard").cast("int").alias("shard"), (F.col("shard_base") + F.col("base")).alias("base"))
    # At most SPLIT rows per text.
    earlier = Window.partitionBy("digest").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("digest", "split", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start")).join(
        placed, "digest").select("digest", "split", "shard", (F.col("base") + F.col("start")).alias("start"))
    number = F.row_number().over(Window.partitionBy("digest", "split").orderBy("doc_id")) - 1
    return rows.withColumn("number", number).join(starts, ["digest", "split"]).select(
        "doc_id", "size", "text_crc32", "digest", "shard", (F.col("start") + F.col("number")).cast("long").alias("slot"))
