"""SimHash near-duplicates, linked by multi-index hashing.

Fingerprints of 64 bits are cut into three segments. If two of them differ in
at most four bits, then the first or the second segment differs in at most one
bit, or the third is equal (2 + 2 + 1 > 4). So every fingerprint is stored
under its three segment values, and looks into the Hamming ball of radius one
around its first two. Of two segments that differ in one bit, only the one
with the bit set needs to look: 24 rows per distinct fingerprint on average.

Rows of equal segment value meet in one group, where complete distances are
verified. Only the edges of a spanning forest leave a group, never all pairs:
a visited fingerprint removes everything it reaches from the set still to be
visited. Groups above ``GROUP`` rows are cut into blocks that meet pairwise.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from scenelake.llm.common import arrow_pass, materialise, utf8, split_join
from scenelake.llm.graph import components

SHINGLE = 4
SEED = 42
DISTANCE = 4
SEGMENTS = ((0, 21), (21, 21), (42, 22))  # (first bit, bits); the last one is matched exactly
GROUP = 4096
HOT_BROADCAST = 100_000  # rows of (segment value, blocks), 16 bytes each
PIECE = 1 << 22  # bytes of text tokenised at once


def _pieces(text: bytes):
    """The text in pieces that end between words."""
    start = 0
    while start < len(text):
        end = start + PIECE
        while end < len(text) and text[end] not in b"\t\n\x0b\x0c\r ":
            end += 1
        yield text[start:end]
        start = end


def fingerprint(text: bytes | None) -> int:
    """64-bit SimHash over all word shingles, repeats included."""
    if not text:
        return 0
    digest = partial(xxhash.xxh64_intdigest, seed=SEED)
    ones, total, carry = np.zeros(64, dtype=np.int64), 0, []
    for piece in _pieces(text):
        w = carry + piece.lower().split()
        shingles = map(b" ".join, zip(*[w[i:] for i in range(SHINGLE)]))
        hashes = np.fromiter(map(digest, shingles), dtype="<u8")
        for i in range(0, len(hashes), 1 << 15):
            bits = np.unpackbits(hashes[i:i + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones += bits.sum(axis=0, dtype=np.uint32)
        total += len(hashes)
        carry = w[-(SHINGLE - 1):]
    if not total:  # fewer words than a shingle
        return digest(b" ".join(carry)) if carry else 0
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and ``fp`` (the 64 bits as a long) of every row; null and wordless texts have 0."""

    def run(batches):
        for batch in batches:
            values = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values)], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return arrow_pass(docs.select("doc_id", utf8()), run, f"doc_id {kind}, fp long")


def _probes(value, base, masks):
    """The segment value with one of its set bits cleared, for each of them."""
    cleared = F.filter(masks, lambda mask: value.bitwiseAND(mask) != 0)
    return F.transform(cleared, lambda mask: F.struct(
        (base + value - mask).alias("bucket"), F.lit(False).alias("stored")))


def _table_rows(fps: DataFrame) -> DataFrame:
    """(bucket, fp, stored): stored rows and the probes of the Hamming balls."""
    entries = []
    for number, (first, width) in enumerate(SEGMENTS):
        value = F.shiftrightunsigned("fp", first).bitwiseAND((1 << width) - 1)
        base = F.lit(number << 22)
        entries.append(F.array(F.struct((base + value).alias("bucket"), F.lit(True).alias("stored"))))
        if number < len(SEGMENTS) - 1:
            masks = F.array(*[F.lit(1 << i) for i in range(width)])
            entries.append(_probes(value, base, masks))
    return fps.select("fp", F.explode(F.concat(*entries)).alias("e")).select(
        F.col("e.bucket").cast("long").alias("bucket"), "fp", F.col("e.stored").alias("stored"))


def forest(points: np.ndarray) -> list[tuple[int, int]]:
    """Spanning forest of the graph of distances up to ``DISTANCE`` among ``points`` (unsigned)."""
    edges, rest = [], np.unique(points)
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            near = np.bitwise_count(rest ^ at) <= DISTANCE
            if near.any():
                found = rest[near]
                rest = rest[~near]
                queue.extend(found)
                edges.extend((int(at), int(x)) for x in found)
    return edges


def _small_groups(group, fp):
    """Links inside groups of a few rows, all groups at once: each row with the next ones of its group."""
    a, b = [], []
    for lag in range(1, 8):
        if lag >= len(group):
            break
        near = np.flatnonzero((group[lag:] == group[:-lag]) & (np.bitwise_count(fp[lag:] ^ fp[:-lag]) <= DISTANCE)
                              & (fp[lag:] != fp[:-lag]))
        a.append(fp[near])
        b.append(fp[near + lag])
    return (np.concatenate(a), np.concatenate(b)) if a else (fp[:0], fp[:0])


def _link_groups(batches):
    """Links of rows that arrive sorted by group; a group that is not complete waits for the next batch."""
    names = ["a", "b"]

    def links(group, fp, stored):
        starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        sizes = np.diff(np.r_[starts, len(group)])
        row_size = np.repeat(sizes, sizes)
        small = row_size <= 8
        a, b = _small_groups(group[small], fp[small])
        more = []
        for start, size in zip(starts[sizes > 8], sizes[sizes > 8]):
            if stored[start:start + size].any():
                more.extend(forest(fp[start:start + size]))
        if more:
            pairs = np.array(more, dtype=np.uint64)
            a, b = np.concatenate([a, pairs[:, 0]]), np.concatenate([b, pairs[:, 1]])
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names)

    held = None
    for batch in batches:
        group = batch.column(0).to_numpy(zero_copy_only=False)
        fp = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
        stored = batch.column(2).to_numpy(zero_copy_only=False)
        if held is not None:
            group, fp, stored = (np.concatenate(x) for x in zip(held, (group, fp, stored)))
        cut = int(np.searchsorted(group, group[-1], "left")) if len(group) else 0
        held = group[cut:], fp[cut:], stored[cut:]
        if cut:
            yield links(group[:cut], fp[:cut], stored[:cut])
    if held is not None and len(held[0]):
        yield links(*held)


def links(fps: DataFrame) -> DataFrame:
    """(a, b): links between distinct fingerprints that keep every connection; ``fps(fp)`` must be distinct."""
    rows = _table_rows(fps)
    hot = materialise(rows.groupBy("bucket").count().where(F.col("count") > GROUP).select(
        "bucket", F.ceil(F.col("count") / GROUP).cast("int").alias("blocks")))
    hot = F.broadcast(hot) if hot.count() <= HOT_BROADCAST else hot
    rows = rows.join(hot, "bucket", "left")
    # Block i of a hot bucket meets block j in group (bucket, i, j).
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("long")
    meetings = F.when(F.col("blocks").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1),
        lambda j: F.shiftleft(F.least(own, j), 20) + F.greatest(own, j)))
    grouped = rows.select("bucket", "fp", "stored", F.explode(meetings).alias("meeting")).select(
        (F.shiftleft("bucket", 40) + F.col("meeting")).alias("group"), "fp", "stored")
    return arrow_pass(grouped.repartition("group").sortWithinPartitions("group"), _link_groups, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, fp, component_id (smallest doc_id of the class).

    Equal texts, repeated rows and all wordless texts share a fingerprint and so
    a class. A null doc_id belongs to its class but never names it; a class of
    null ids only has a null component_id. Other columns are ignored.
    """
    found = materialise(fingerprints(docs))
    rooted = _rooted(found.groupBy("fp").agg(F.min("doc_id").alias("least")))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    membership = split_join(rooted, named, "root").select("fp", "component_id")
    return found.join(membership, "fp").select("doc_id", "fp", "component_id")


def _rooted(classes: DataFrame) -> DataFrame:
    """(fp, least, root) of distinct fingerprints (fp, least); fingerprints that are linked share a root."""
    classes = materialise(classes)
    roots = components(links(classes.select("fp")))
    return classes.join(roots, classes["fp"] == roots["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of every class, all columns kept: the smallest by doc_id, then by digests of text and row, null ids last.

    The class of a row is that of its own text, whatever other rows have its
    id. Rows that are equal in all columns are one.
    """
    # The row travels as one value, so no name of its columns can clash with a helper's or needs reading as a path.
    whole = F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]).alias("row")
    rows = docs.select(whole).withColumn("digest", F.sha2(F.to_json("row"), 256))
    ident, text = F.col("row")["doc_id"], F.col("row")["text"]
    order = F.struct(ident.isNull().alias("unnamed"), ident.alias("id"), F.sha2(text, 256).alias("text"), F.col("digest").alias("row"))
    found = materialise(fingerprints(rows.select(order.alias("doc_id"), text.alias("text"))))
    rooted = _rooted(found.groupBy("fp").agg(F.min("doc_id").alias("least")))
    kept = rooted.groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.row").alias("digest"))
    return rows.join(kept, "digest", "left_semi").dropDuplicates(["digest"]).select("row.*")
