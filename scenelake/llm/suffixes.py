"""Exact removal of long repeats by refining intervals of sampled suffixes over all shards.

Merging Burrows-Wheeler transforms refines an interleave: suffixes that agree
on k symbols stand in one interval, and round after round the intervals are
split by more symbols, until they hold one suffix or agree on enough. Byte by
byte that takes as many rounds over all suffixes as the repeat is long. Here
the interleave is kept as its set of intervals (a key and a count), suffixes
are sampled, and a round reads many symbols at once:

* Sampled suffixes. Among the 337 substrings of 64 bytes in a 400-byte string
  the one with the smallest hash is its anchor (the leftmost of equal ones). It
  depends on the string alone, so equal strings have anchors at equal offsets.
  Neighbouring strings share anchors: a text has one run of strings per 130
  bytes or so.
* Round 1 agrees on the anchor's 64 bytes. Intervals of one suffix are done:
  none of their strings occurs twice.
* Round 2 agrees on the whole run. A run that occurs twice repeats throughout.
* Round 3 splits runs left over into pieces of up to 32 strings, round 4 single
  strings of pieces left over. A string that stands alone is kept; everything
  else is a repeat.

The rounds need no text but the edges: the strings of a piece share a core,
and differ in less than 32 bytes on either side. Shuffles carry hashes and
edges; texts are shuffled for the pieces and for the result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from scenelake.llm.common import ASCII_SPACE, arrow_pass, materialise, settle, utf8

LENGTH = 400
ANCHOR = 64
PIECE = 32
PASSAGE = 51  # words in a row that count as a repeated passage
PASSAGE_ANCHOR = 8
SEGMENT = 1 << 17  # strings of a long text handled at once

_MULTIPLIER = 0x9E3779B97F4A7C15
_SPACE = np.isin(np.arange(256), list(ASCII_SPACE))
_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)  # masks of the first n bytes
_HIGH = np.uint64(0xFFFFFFFF00000000)
_LOW = np.uint64(0xFFFFFFFF)


def _mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hasher:
    """Hashes of any substrings of a text from prefix sums, modulo 2**64."""

    def __init__(self, length: int, anchor: int):
        self.length, self.anchor, size = length, anchor, max(SEGMENT, length) + length + 2 * PIECE
        self.values = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_MULTIPLIER))
        one = np.ones(1, dtype=np.uint64)
        self.powers = np.concatenate([one, np.cumprod(np.full(size, _MULTIPLIER, dtype=np.uint64))])
        inverse = pow(_MULTIPLIER, -1, 1 << 64)
        self.inverses = np.concatenate([one, np.cumprod(np.full(size, inverse, dtype=np.uint64))])

    def prefixes(self, text: np.ndarray) -> np.ndarray:
        """``text``: bytes, or the hashes of words."""
        sums = np.zeros(len(text) + 1, dtype=np.uint64)
        np.cumsum((self.values[text] if text.dtype == np.uint8 else text) * self.powers[:len(text)], out=sums[1:])
        return sums

    def substrings(self, sums: np.ndarray, starts, ends) -> np.ndarray:
        return _mix((sums[ends] - sums[starts]) * self.inverses[starts])

    def runs(self, text: np.ndarray):
        """(first string, strings, offset of the anchor in the first one, key, run hash) of one segment."""
        sums = self.prefixes(text)
        n, width = len(text) - self.anchor + 1, self.length - self.anchor + 1
        keys = _mix((sums[self.anchor:] - sums[:-self.anchor]) * self.inverses[:n])
        ranked = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
        ranked[:n] = (keys & _HIGH) | np.arange(n, dtype=np.uint64)
        blocks = ranked.reshape(-1, width)
        # Minimum of every stretch: the end of one block and the beginning of the next.
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        strings = len(text) - self.length + 1
        anchors = (np.minimum(behind[:strings], ahead[width - 1:width - 1 + strings]) & _LOW).astype(np.int64)
        first = np.concatenate([[0], np.flatnonzero(anchors[1:] != anchors[:-1]) + 1])
        count = np.diff(np.append(first, strings))
        anchor = anchors[first]
        offset = anchor - first
        shape = _mix((offset * self.length * 2 + count).astype(np.uint64))
        run = _mix(self.substrings(sums, first, first + count + self.length - 1) ^ shape)
        return first, count, offset, keys[anchor], run

    def text_runs(self, text: np.ndarray):
        data = text
        for begin in range(0, len(data) - self.length + 1, SEGMENT):
            first, *rest = self.runs(data[begin:begin + SEGMENT + self.length - 1])
            yield first + begin, *rest

    def pieces(self, text: np.ndarray, first: int, count: int, offset: int):
        """(piece number, core hash, left edge, right edge) of the pieces of a run; edges as bytes of their symbols.

        Piece j has the strings whose anchor offset is in [32 j, 32 j + 31]; its
        core is what all of them contain, its edges reach as far as the run has strings.
        """
        anchor, last = first + offset, offset - count + 1
        begin = max(0, first - PIECE)
        sums = self.prefixes(text[begin:first + count + self.length + PIECE])
        for j in range(last // PIECE, offset // PIECE + 1):
            high, low = min(offset, PIECE * j + PIECE - 1), max(last, PIECE * j)
            core = anchor - PIECE * j, anchor - PIECE * j - PIECE + 1 + self.length
            digest = self.substrings(sums, np.array([core[0] - begin]), np.array([core[1] - begin]))
            mixed = _mix(digest + np.uint64(j))[0]
            yield (j, int(mixed.view(np.int64)), text[anchor - high:core[0]].tobytes(),
                   text[core[1]:anchor - low + self.length].tobytes())


def byte_symbols(text: bytes) -> np.ndarray:
    return np.frombuffer(text, dtype=np.uint8)


def word_symbols(text: bytes) -> np.ndarray:
    """Hashes of the words of a text, as they stand."""
    space = _SPACE[byte_symbols(text)]
    edges = np.flatnonzero(np.diff(np.r_[True, space, True]))
    start, length = edges[::2], edges[1::2] - edges[::2]
    eight = np.ndarray(len(text) + 1, dtype="<u8", buffer=text + bytes(8), strides=(1,))
    found = length.astype(np.uint64) * np.uint64(_MULTIPLIER)
    rows = np.arange(len(start))
    while len(rows):  # eight bytes of all words at a time
        part = np.take(eight, start[rows]) & _BYTES[np.minimum(length[rows], 8)]
        found[rows] = _mix(found[rows] * np.uint64(_MULTIPLIER) ^ part)
        start[rows] += 8
        length[rows] -= 8
        rows = rows[length[rows] > 0]
    return found


def _identified(docs: DataFrame) -> DataFrame:
    """doc_id, text, and the pair (h, size) that names a text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select("doc_id", F.coalesce(utf8(), F.lit(b"")).alias("text"), F.xxhash64(text).alias("h"),
                       F.octet_length(text).cast("int").alias("size"))


def _long(values) -> pa.Array:
    return pa.array(np.asarray(values, dtype=np.uint64).view(np.int64))


def _kinds(columns: list[np.ndarray]) -> list[np.ndarray]:
    """One row for equal (key, run) pairs, the last two columns, with the number of rows before them."""
    key, run = columns[-2:]
    order = np.lexsort((run, key))
    new = np.r_[True, (key[order][1:] != key[order][:-1]) | (run[order][1:] != run[order][:-1])]
    starts = np.flatnonzero(new)
    first = order[starts]
    return [*[c[first] for c in columns[:-2]], np.diff(np.r_[starts, len(order)]), key[first], run[first]]


def _runs(docs: DataFrame, length: int, anchor: int, symbols=byte_symbols, least: int | None = None) -> DataFrame:
    """Runs of all texts of at least ``least`` bytes; ``symbols`` makes bytes or words of a text.

    Equal runs of a batch are counted in one row, so a frequent passage is a few rows a task.
    """
    names = ["h", "size", "first", "strings", "offset", "n", "key", "run"]

    def run(batches):
        hasher = Hasher(length, anchor)
        for batch in batches:
            parts = []
            for text, h, size in zip(*(batch.column(i).to_pylist() for i in range(3))):
                for first, count, offset, key, whole in hasher.text_runs(symbols(text)):
                    n = len(first)
                    parts.append((np.full(n, h, np.int64), np.full(n, size, np.int32), first.astype(np.int32),
                                  count.astype(np.int32), offset.astype(np.int32), key, whole))
            if parts:
                columns = _kinds([np.concatenate(c) for c in zip(*parts)])
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns[:6]), *map(_long, columns[6:])], names)

    return arrow_pass(docs.where(F.col("size") >= (least or length)).select("text", "h", "size"), run,
                      "h long, size int, first int, strings int, offset int, n long, key long, run long")


def _pieces(rows: DataFrame, length: int, anchor: int) -> DataFrame:
    """Pieces of the listed runs of each text; ``last_start`` is where a string with nothing of the left edge starts."""
    names = ["h", "size", "key", "core", "left", "right", "n", "last_start"]

    def run(batches):
        hasher, done = Hasher(length, anchor), set()
        for batch in batches:
            out = []
            for text, h, size, listed in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3, 4))):
                if listed is None or (h, size) in done:  # one of several equal texts speaks for all
                    continue
                done.add((h, size))
                data = byte_symbols(text)
                for one in listed:
                    for j, core, left, right in hasher.pieces(data, one["first"], one["strings"], one["offset"]):
                        # A string with t bytes of the left edge starts t bytes before this place.
                        start = one["first"] + one["offset"] - PIECE * j
                        out.append((h, size, one["key"], core, left, right, one["n"], start))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (
                    pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int32()))], names)

    return arrow_pass(rows, run, "h long, size int, key long, core long, left binary, right binary, n long, last_start int")


def _removals(text: bytes, alone: list[dict] | None, length: int) -> list[tuple[int, int]]:
    """Byte spans covered by strings that do not stand alone."""
    strings = len(text) - length + 1
    if strings < 1:
        return []
    repeated = np.zeros(strings + 2, dtype=np.int8)
    repeated[1:-1] = 1
    for mark in alone or ():
        repeated[mark["first"] + 1:mark["first"] + mark["strings"] + 1] = 0
    edges = np.flatnonzero(np.diff(repeated))
    spans: list[list[int]] = []
    for start, end in zip(edges[::2].tolist(), edges[1::2].tolist()):
        if spans and start <= spans[-1][1]:
            spans[-1][1] = end - 1 + length
        else:
            spans.append([start, end - 1 + length])
    return [tuple(s) for s in spans]


def _kinds_of_runs(runs: DataFrame) -> DataFrame:
    """Rounds 1 and 2: a row per kind of run, with the number of kinds and of runs under its key.

    Batches have counted equal runs already, so what meets under a key is its different surroundings; the window spills.
    """
    where = F.struct("h", "size", "first", "strings", "offset")
    kinds = runs.repartition("key").groupBy("key", "run").agg(F.sum("n").alias("n"), F.min(where).alias("one"))
    under = Window.partitionBy("key")
    return kinds.withColumns({"n_key": F.sum("n").over(under), "kinds": F.count("*").over(under)}).where(
        (F.col("n_key") == 1) | (F.col("kinds") > 1)).select("one.*", "key", "n", "kinds")


def _standing_alone(texts: DataFrame, length: int, anchor: int) -> DataFrame:
    """(h, size, marks): strings of each text that start nowhere else, as (first, strings)."""
    kinds = _kinds_of_runs(_runs(texts, length, anchor))
    # A run alone is marked; one run of each kind that shares its key with other kinds goes on. Bounded by the text.
    found = materialise(kinds.groupBy("h", "size").agg(
        F.collect_list(F.when(F.col("kinds") == 1, F.struct("first", "strings"))).alias("alone"),
        F.collect_list(F.when(F.col("kinds") > 1, F.struct("first", "strings", "offset", "key", "n"))).alias("listed")))
    listed = found.where(F.size("listed") > 0).select("h", "size", "listed")
    with_lists = texts.join(listed.hint("shuffle_hash"), ["h", "size"], "left").select(
        "doc_id", "text", "h", "size", "listed")
    pieces = _pieces(with_lists, length, anchor).repartition("key", "core").groupBy("key", "core", "left", "right").agg(
        F.sum("n").alias("n"), F.min(F.struct("h", "size", "last_start")).alias("one"))
    pieces = pieces.withColumn("kinds", F.count("*").over(Window.partitionBy("key", "core")))
    # Rounds 3 and 4: whole pieces where nothing shares the core, else their single strings.
    left, right = F.octet_length("left"), F.octet_length("right")
    whole = F.array(F.struct(
        F.lit(-1).alias("t"), left.alias("back"), (left + right - (PIECE - 2)).alias("strings"),
        F.lit(b"").alias("before"), F.lit(b"").alias("after")))
    single = F.transform(F.sequence(F.lit(PIECE - 1) - right, left), lambda t: F.struct(
        t.alias("t"), t.alias("back"), F.lit(1).alias("strings"), F.substring("left", left - t + 1, t).alias("before"),
        F.substring("right", F.lit(1), F.lit(PIECE - 1) - t).alias("after")))
    strings = pieces.where((F.col("kinds") > 1) | (F.col("n") == 1)).select(
        "key", "core", "n", "one", F.explode(F.when(F.col("kinds") == 1, whole).otherwise(single)).alias("s"))
    more = strings.groupBy("key", "core", "s.t", "s.before", "s.after").agg(
        F.sum("n").alias("n"), F.min(F.struct("one", "s.back", "s.strings")).alias("m")).where(F.col("n") == 1).select(
        "m.one.h", "m.one.size", F.struct((F.col("m.one.last_start") - F.col("m.back")).alias("first"),
                                          F.col("m.strings").alias("strings")).alias("mark")).groupBy("h", "size").agg(
        F.collect_list("mark").alias("more"))
    return found.select("h", "size", "alone").join(more, ["h", "size"], "left").select(
        "h", "size", F.concat("alone", F.coalesce("more", F.array().cast(found.schema["alone"].dataType))).alias("marks"))


def fresh_passages(texts: DataFrame, words: int = PASSAGE, anchor: int = PASSAGE_ANCHOR) -> DataFrame:
    """(h, size, fresh): how many passages of ``words`` words of each text start nowhere else.

    The first two rounds on words instead of bytes; then the passages of runs
    that share an anchor with others are counted one by one.
    """
    found = settle(_kinds_of_runs(_runs(texts, words, anchor, word_symbols, 2 * words - 1)))
    alone = found.where("kinds = 1").select("h", "size", F.col("strings").cast("long").alias("fresh"))
    listed = found.where("kinds > 1").groupBy("h", "size").agg(F.collect_list(F.struct("first", "strings", "n")).alias("listed"))
    rows = texts.where(F.col("size") >= 2 * words - 1).join(listed.hint("shuffle_hash"), ["h", "size"]).select("text", "h", "size", "listed")

    def run(batches):
        hasher, done = Hasher(words, anchor), set()
        for batch in batches:
            out = []
            for text, h, size, runs in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if (h, size) in done:  # one of several equal texts speaks for all
                    continue
                done.add((h, size))
                symbols = word_symbols(text)
                for one in runs:
                    part = symbols[one["first"]:one["first"] + one["strings"] + words - 1]
                    starts = np.arange(one["strings"])
                    found = hasher.substrings(hasher.prefixes(part), starts, starts + words)
                    out.append((np.full(len(found), h), np.full(len(found), size, np.int32), np.full(len(found), one["n"]), found))
            if out:
                h, size, n, found = (np.concatenate(c) for c in zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(size), pa.array(n), _long(found)], ["h", "size", "n", "passage"])

    single = arrow_pass(rows, run, "h long, size int, n long, passage long").groupBy("passage").agg(
        F.sum("n").alias("n"), F.min(F.struct("h", "size")).alias("one")).where("n = 1")
    fresh = alone.unionAll(single.select("one.h", "one.size", F.lit(1).cast("long").alias("fresh")))
    return settle(fresh.groupBy("h", "size").agg(F.sum("fresh").alias("fresh")))


def remove_repeats(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, passage: int = PASSAGE) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, spans (array of start and end), kept_sha256, has_passage.

    A byte is removed if a string of ``length`` bytes that covers it also starts
    anywhere else, in the same text or another, overlaps included. Null texts
    are empty; texts shorter than ``length`` keep everything; of repeated rows
    and equal texts no copy is spared. ``has_passage`` tells whether ``passage``
    words in a row also stand elsewhere, whatever their bytes and whatever
    stands between them; it removes nothing. Further columns are ignored.
    """
    texts = _identified(docs)
    fresh = fresh_passages(texts, passage)
    marked = _standing_alone(texts, length, anchor).join(fresh, ["h", "size"], "full")
    # Texts too short to repeat anything meet nothing, however many rows share one of them.
    least = min(length, 2 * passage - 1)
    # A further key, a hash of the others, has the marks dealt anew, so that a text of many copies can be split.
    again = F.xxhash64("h", "size")
    rows = texts.where(F.col("size") >= least).withColumn("again", again).join(
        marked.withColumn("again", again).hint("shuffle_hash"), ["h", "size", "again"], "left").drop("again")
    short = texts.where(F.col("size") < least).withColumns({c: F.lit(None).cast(rows.schema[c].dataType) for c in ("marks", "fresh")})
    rows = rows.unionByName(short).select("doc_id", "text", "h", "size", "marks", "fresh")

    def run(batches):
        for batch in batches:
            out = []
            for text, marks_of, fresh_of in zip(*(batch.column(i).to_pylist() for i in (1, 4, 5))):
                spans = _removals(text, marks_of, length)
                kept, at = hashlib.sha256(), 0
                for start, end in spans:
                    kept.update(text[at:start])
                    at = end
                kept.update(text[at:])
                passages = len(text.split()) - passage + 1
                out.append((len(text), sum(e - s for s, e in spans), [list(s) for s in spans], kept.hexdigest(),
                            passages > (fresh_of or 0)))
            kinds = pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int64())), pa.string(), pa.bool_()
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(zip(*out), kinds)]],
                                             ["doc_id", "n_bytes", "n_removed", "spans", "kept_sha256", "has_passage"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return arrow_pass(rows, run, f"doc_id {kind}, n_bytes long, n_removed long, spans array<array<long>>, "
                                 "kept_sha256 string, has_passage boolean")
