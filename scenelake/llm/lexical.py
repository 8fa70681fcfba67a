"""Ranked search: accumulators of short lists become one bounded iterator beside the long lists.

Documents are cut into segments (one Arrow batch each). A segment holds the
posting lists of the terms that a block of items asks for, in ascending order
of doc_id. Lengths, document frequencies and the two totals are summed over all
segments, so every segment scores with the same integers. Then each segment is
searched, item by item:

* Term at a time: the shortest lists are added up in accumulators.
* Document at a time: the accumulators, bounded by their largest value, and the
  long lists, bounded by what their largest count can give, advance together in
  windows of documents. Iterators whose bounds together stay below the 20th best
  score so far never propose a document; they are only probed, by binary search,
  for documents that the others proposed and that can still get in.

A task keeps its best documents of every item from segment to segment, so later
segments start with a high threshold. Spark merges the lists of all tasks.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from scenelake.llm.common import arrow_pass, materialise, utf8

TOP = 20
BLOCK_BYTES = 1 << 20  # item text that is searched for at once
PIECE = 4 << 20  # bytes of a long text that are split at once
SHORT = 0.5  # lists are added up in accumulators while their postings stay below this share of the segment's documents
WINDOW = 1024  # documents that the iterators advance by
MERGES = 32  # first groups of an item's lists from all tasks

_TERM = bytes(c for c in range(256) if c >= 0x80 or chr(c).isalnum())
# Everything that is no part of a term becomes a space; A-Z become small.
_TABLE = bytes(ord(chr(c).lower()) if c < 0x80 else c for c in range(256)).translate(
    bytes(c if c in _TERM else 0x20 for c in range(256)))
_LAST = np.iinfo(np.int64).max  # place of a null doc_id in the order


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """Terms of a text, in lists of bounded size; a term is never cut."""
    text, start = text.translate(_TABLE), 0
    while start < len(text):
        end = text.find(b" ", start + PIECE) if start + PIECE < len(text) else -1
        end = len(text) if end < 0 else end
        yield text[start:end].split()
        start = end


def blocks_of(items: DataFrame, size: int) -> Iterator[list[tuple]]:
    """Rows (item_id, counts of terms) in blocks of at most ``size`` bytes of text, or of one item."""
    block, used = [], 0
    for item_id, text in items.select("item_id", utf8()).toLocalIterator():
        text = bytes(text or b"")
        if block and used + len(text) > size:
            yield block
            block, used = [], 0
        block.append((item_id, Counter(t for part in terms_of(text) for t in part)))
        used += len(text)
    if block:
        yield block


def segments(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """One row per batch of documents: ids in ascending order, lengths, and the lists of the vocabulary's terms."""
    names = ["n_docs", "n_terms", "ids", "lengths", "terms", "sizes", "places", "counts"]
    kinds = [pa.int64(), pa.int64(), *[pa.list_(k) for k in (
        pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64())]]

    def run(batches):
        known = vocabulary.__contains__
        for batch in batches:
            ids = batch.column(0).fill_null(_LAST).to_numpy(zero_copy_only=False)
            order = np.argsort(ids, kind="stable")
            texts, lengths, found = batch.column(1), [], {}
            for place, at in enumerate(order.tolist()):
                counts, n = Counter(), 0
                for part in terms_of(texts[at].as_py() or b""):
                    n += len(part)
                    counts.update(filter(known, part))
                lengths.append(n)
                for term, count in counts.items():
                    found.setdefault(vocabulary[term], []).append((place, count))
            terms = sorted(found)
            postings = [p for t in terms for p in found[t]]
            row = (sum(n > 0 for n in lengths), sum(lengths), ids[order], lengths, terms, [len(found[t]) for t in terms],
                   [p[0] for p in postings], [p[1] for p in postings])
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names)

    return arrow_pass(docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8()), run,
                      "n_docs long, n_terms long, ids array<long>, lengths array<long>, terms array<int>, "
                      "sizes array<int>, places array<int>, counts array<long>")


def weights_of(frequencies: dict[int, int], n_docs: int) -> dict[int, int]:
    return {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) for t, df in frequencies.items()}


def normalisers(lengths: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """100 - 25 + (25 n N) div L of each document."""
    if len(lengths) and 25 * int(lengths.max()) * n_docs >= 1 << 63:
        return np.array([75 + 25 * int(n) * n_docs // n_terms for n in lengths], dtype=np.int64)
    return 75 + 25 * lengths * n_docs // max(n_terms, 1)


class Postings:
    """One term's list in a segment: places ascending, and what each posting adds to a score."""

    def __init__(self, places: np.ndarray, counts: np.ndarray, norms: np.ndarray, weight: int):
        self.places, self.counts, self.norms, self.weight = places, counts, norms, weight
        most, least = int(counts.max()), int(norms.min())
        self.bound = weight * (1_000_000_000 * most // (1000 * most + 12 * least))

    def scores(self, start: int, end: int) -> np.ndarray:
        counts, norms = self.counts[start:end], self.norms[self.places[start:end]]
        return self.weight * (1_000_000_000 * counts // (1000 * counts + 12 * norms))

    def window(self, low: int, high: int):
        start, end = np.searchsorted(self.places, (low, high))
        return self.places[start:end], self.scores(start, end)

    def probe(self, docs: np.ndarray) -> np.ndarray:
        """What the list adds to each of the given documents."""
        at = np.minimum(np.searchsorted(self.places, docs), len(self.places) - 1)
        counts = np.where(self.places[at] == docs, self.counts[at], 0)
        return self.weight * (1_000_000_000 * counts // (1000 * counts + 12 * self.norms[docs]))


class Accumulators:
    """Sums of the short lists as one more iterator."""

    def __init__(self, short: list[Postings], n_docs: int):
        self.sums = np.zeros(n_docs, dtype=np.int64)
        for postings in short:
            self.sums[postings.places] += postings.scores(0, len(postings.places))
        self.places = np.flatnonzero(self.sums)
        self.bound = int(self.sums.max())

    def window(self, low: int, high: int):
        start, end = np.searchsorted(self.places, (low, high))
        places = self.places[start:end]
        return places, self.sums[places]

    def probe(self, docs: np.ndarray) -> np.ndarray:
        return self.sums[docs]


class Best:
    """The ``top`` best documents so far: high scores first, then small ids."""

    def __init__(self, top: int):
        self.top, self.scores, self.ids = top, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    @property
    def threshold(self) -> int:
        """Documents with a lower score are out; one with this score may still win by its id."""
        return int(self.scores[-1]) if len(self.scores) == self.top else 1

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.append(self.scores, scores), np.append(self.ids, ids)
        order = np.lexsort((ids, -scores))[:self.top]
        self.scores, self.ids = scores[order], ids[order]


def search_segment(lists: list[Postings], ids: np.ndarray, best: Best) -> None:
    """Add the documents of a segment that belong to the best ones."""
    lists = sorted((p for p in lists if p.weight > 0), key=lambda p: len(p.places))
    n_docs, used, n_short = len(ids), 0, 0
    while n_short < len(lists) and used + len(lists[n_short].places) <= SHORT * n_docs:
        used += len(lists[n_short].places)
        n_short += 1
    iterators = [*lists[n_short:], *([Accumulators(lists[:n_short], n_docs)] if n_short else [])]
    iterators.sort(key=lambda i: i.bound)
    below = np.cumsum([i.bound for i in iterators])  # what an iterator and all with lower bounds can give together
    sums = np.zeros(WINDOW, dtype=np.int64)
    for low in range(0, n_docs, WINDOW):
        first = int(np.searchsorted(below, best.threshold))
        if first == len(iterators):
            return
        sums[:] = 0
        proposed = np.zeros(WINDOW, dtype=bool)
        for iterator in iterators[first:]:
            places, scores = iterator.window(low, low + WINDOW)
            sums[places - low] += scores
            proposed[places - low] = True
        docs = np.flatnonzero(proposed)
        for i in range(first - 1, -1, -1):
            docs = docs[sums[docs] + below[i] >= best.threshold]
            if not len(docs):
                break
            sums[docs] += iterators[i].probe(docs + low)
        docs = docs[sums[docs] >= best.threshold]
        if len(docs):
            best.add(sums[docs], ids[docs + low])


def _search_block(docs: DataFrame, block: list[tuple], first: int, top: int) -> DataFrame:
    vocabulary = {t: i for i, t in enumerate(sorted({t for _, counts in block for t in counts}))}
    index = materialise(segments(docs, vocabulary))
    total = index.agg(F.sum("n_docs"), F.sum("n_terms")).collect()[0]
    n_docs, n_terms = total[0] or 0, total[1] or 0
    each = F.explode(F.arrays_zip("terms", "sizes"))
    frequencies = {r[0]: r[1] for r in index.select(each.alias("e")).groupBy("e.terms").agg(F.sum("e.sizes")).collect()}
    weights = weights_of(frequencies, n_docs)
    asked = [[(vocabulary[t], q) for t, q in counts.items()] for _, counts in block]

    def run(batches):
        best = [Best(top) for _ in asked]
        for batch in batches:
            for at in range(batch.num_rows):
                ids, lengths, terms, sizes, places, counts = (
                    batch.column(c)[at].values.to_numpy(zero_copy_only=False) for c in range(6))
                norms = normalisers(lengths, n_docs, n_terms)
                ends = np.cumsum(sizes)
                span = {int(t): (int(e - s), int(e)) for t, s, e in zip(terms, sizes, ends)}
                for query, heap in zip(asked, best):
                    lists = [Postings(places[span[t][0]:span[t][1]], counts[span[t][0]:span[t][1]], norms, q * weights[t])
                             for t, q in query if t in span]
                    search_segment(lists, ids, heap)
        out = [(first + i, d, s) for i, heap in enumerate(best) for d, s in zip(heap.ids.tolist(), heap.scores.tolist())]
        if out:
            numbers, found, scores = (np.array(c, dtype=np.int64) for c in zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(numbers), pa.array(found, mask=found == _LAST), pa.array(scores)],
                                             ["number", "doc_id", "score"])

    return arrow_pass(index.select("ids", "lengths", "terms", "sizes", "places", "counts"), run,
                      "number long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: the ``top`` documents of each row of ``items``, scores above 0, ties by doc_id.

    Null, empty and term-free texts of items find nothing, those of documents
    are not found and do not count. Repeated rows count as often as they stand
    in either table; a null doc_id comes last among equal scores. Items are
    searched in blocks of ``BLOCK_BYTES``, each in one pass over the documents.
    """
    spark, kind = docs.sparkSession, items.schema["item_id"].dataType.simpleString()
    found, first = None, 0
    for block in blocks_of(items, BLOCK_BYTES):
        hits = _search_block(docs, block, first, top)
        order = [F.desc("score"), F.asc_nulls_last("doc_id")]
        group = F.pmod(F.xxhash64("doc_id"), F.lit(MERGES))
        hits = hits.withColumn("rank", F.row_number().over(Window.partitionBy("number", group).orderBy(*order)))
        hits = hits.where(F.col("rank") <= top).withColumn(
            "rank", F.row_number().over(Window.partitionBy("number").orderBy(*order))).where(F.col("rank") <= top)
        named = spark.createDataFrame([(first + i, item) for i, (item, _) in enumerate(block)], f"number long, item_id {kind}")
        hits = materialise(hits.join(F.broadcast(named), "number").select("item_id", "rank", "doc_id", "score"))
        found = hits if found is None else found.unionAll(hits)
        first += len(block)
    return found if found is not None else spark.createDataFrame(
        [], f"item_id {kind}, rank int, doc_id long, score long")
