"""Benchmark decontamination: Wu-Manber search for word windows of test items.

Symbols are words. All windows of one length m share a shift table over blocks
of up to three words: it says how far the search may jump because no window
has that block nearer to its end. A shift of zero leads to the bucket of that
last block, which is split by first word, and the candidates there are
compared word by word. An ordinary text is inspected about every eleventh
word.

Items are searched in blocks of bounded size: each block is broadcast, and a
pass over the documents adds its hits to those of the earlier blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from scenelake.llm.common import arrow_pass, keep_rows, materialise, utf8

WINDOW = 13
SUFFIX = 3
ITEM_BYTES = 4 << 20  # text of the items of one block
PIECE = 1 << 22  # bytes of a document tokenised at once
SHARE = 20  # a document is contaminated if SHARE * hit words >= words

# Word characters: digits, letters (A-Z lower-cased) and everything beyond ASCII.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
               for c in range(256))


def words(text: bytes | None) -> list[bytes]:
    return text.translate(_WORDS).split() if text else []


def _pieces(text: bytes) -> Iterator[list[bytes]]:
    line, start = text.translate(_WORDS), 0
    while start < len(line):
        end = line.find(b" ", start + PIECE)
        end = len(line) if end < 0 else end
        yield line[start:end].split()
        start = end


class _Length:
    """Shift table and suffix buckets of the windows of one length."""

    def __init__(self, m: int):
        self.m, self.block = m, min(SUFFIX, m)
        self.default = m - self.block + 1
        self.shift: dict[tuple, int] = {}
        self.buckets: dict[tuple, dict[bytes, list]] = {}

    def add(self, window: list[bytes], item: int) -> None:
        m, size = self.m, self.block
        bucket = self.buckets.setdefault(tuple(window[m - size:]), {}).setdefault(window[0], [])
        for known, items in bucket:
            if known == window:
                items.add(item)
                return
        bucket.append((window, {item}))
        for end in range(size, m + 1):
            block = tuple(window[end - size:end])
            self.shift[block] = min(self.shift.get(block, self.default), m - end)

    def search(self, text: list[bytes]) -> Iterator[tuple[int, set[int]]]:
        """(start, items) of every occurrence."""
        m, size, default, shift, buckets = self.m, self.block, self.default, self.shift, self.buckets
        end = m
        while end <= len(text):
            block = tuple(text[end - size:end])
            jump = shift.get(block, default)
            if jump:
                end += jump
                continue
            for window, items in buckets[block].get(text[end - m], ()):
                if text[end - m:end] == window:
                    yield end - m, items
            end += 1


class Searcher:
    """Windows of the items of one block; ``items``: (item_id as text or None, text bytes)."""

    def __init__(self, items: list[tuple[str | None, bytes]]):
        self.names = [name for name, _ in items]
        self.lengths: dict[int, _Length] = {}
        for number, (_, text) in enumerate(items):
            w = words(text)
            m = min(WINDOW, len(w))
            if m:
                table = self.lengths.setdefault(m, _Length(m))
                for i in range(len(w) - m + 1):
                    table.add(w[i:i + m], number)

    def find(self, text: bytes | None) -> tuple[int, list[list[int]], set[str]]:
        """(words, merged spans of hit words, item ids); an item without an id hits but is not named."""
        spans, found, total, carry = [], set(), 0, []
        for piece in _pieces(text) if text else ():
            w = carry + piece
            base = total - len(carry)
            for table in self.lengths.values():
                for start, items in table.search(w):
                    spans.append([base + start, base + start + table.m])
                    found |= items
            total += len(piece)
            carry = w[-(WINDOW - 1):]
        return total, merge(spans), {self.names[i] for i in found if self.names[i] is not None}


def merge(spans: list[list[int]]) -> list[list[int]]:
    merged: list[list[int]] = []
    for start, end in sorted(spans):
        if merged and start <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end])
    return merged


def contaminated(n_words: int, spans: list[list[int]]) -> bool:
    hit = sum(end - start for start, end in spans)
    return hit > 0 and SHARE * hit >= n_words


def item_blocks(benchmark: DataFrame) -> Iterator[list[tuple[str | None, bytes]]]:
    """Items in blocks of about ``ITEM_BYTES``, streamed, never all at once; items without words are left out."""
    block, size = [], 0
    for name, text in benchmark.select(F.col("item_id").cast("string"), utf8()).where(
            F.col("text").isNotNull()).toLocalIterator():
        block.append((name, bytes(text)))
        size += len(text)
        if size >= ITEM_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


def search(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, spans (array of start and end), items (array of ids).

    Null and empty texts have no words; an empty benchmark finds nothing;
    repeated rows and equal ids of items count once; further columns of either
    table are ignored.
    """
    sc = docs.sparkSession.sparkContext
    kind = docs.schema["doc_id"].dataType.simpleString()
    state = docs.select("doc_id", utf8(), F.lit(0).cast("long").alias("n_words"),
                        F.lit(None).cast("array<array<int>>").alias("spans"),
                        F.lit(None).cast("array<string>").alias("items"))
    schema = f"doc_id {kind}, text binary, n_words long, spans array<array<int>>, items array<string>"
    blocks = item_blocks(benchmark)
    block, first = next(blocks, []), True
    while True:
        upcoming = next(blocks, None)
        shared = sc.broadcast(block)

        def run(batches, shared=shared, last=upcoming is None):
            searcher = Searcher(shared.value)
            for batch in batches:
                n, spans, items = [], [], []
                for text, s, i in zip(*(batch.column(c).to_pylist() for c in (1, 3, 4))):
                    total, new, found = searcher.find(text)
                    n.append(total)
                    spans.append(merge((s or []) + new) if s else new)
                    items.append(sorted(found.union(i or ())))
                texts = pa.nulls(len(n), pa.binary()) if last else batch.column(1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), texts, pa.array(n, pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int32()))),
                     pa.array(items, pa.list_(pa.string()))], ["doc_id", "text", "n_words", "spans", "items"])

        state = arrow_pass(state if first else materialise(state), run, schema)
        if upcoming is None:
            return state.drop("text")
        block, first = upcoming, False


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of ``docs`` that are not contaminated, all columns kept.

    One block of items is judged in place; more blocks need the hits of all of
    them together, so rows are then matched by a digest of their text, since
    equal texts have equal verdicts.
    """
    blocks = item_blocks(benchmark)
    block = next(blocks, [])
    if next(blocks, None) is None:
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def judge(groups):
            searcher = Searcher(shared.value)
            for texts in groups:
                yield [not contaminated(*searcher.find(t)[:2]) for t in texts]

        return keep_rows(docs, judge)
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    keyed = docs.select(digest.alias("doc_id"), "text")
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s[1] - s[0])
    bad = search(keyed, benchmark).where((hit > 0) & (SHARE * hit >= F.col("n_words"))).select(
        F.col("doc_id").alias("_digest")).distinct()
    return docs.join(bad, digest == bad["_digest"], "left_anti")
