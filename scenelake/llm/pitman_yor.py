"""Language model: a hierarchical Pitman-Yor process over word pairs, seating sampled by Gibbs.

Every word is a context with a restaurant of its own; its customers are the
words that follow it. All context restaurants share one parent, the restaurant
of single words: each table of a context sends one customer there. Its own
parent is uniform over the training words and one more, for all unseen ones.

Seating is kept as customers c and tables t per dish. Given the others, t of a
dish has weights ``S(c, t) q**t`` with generalised Stirling numbers S of the
discount d and ``q = x d P(word)``; the auxiliary ``x ~ Gamma(strength / d +
tables of the restaurant)`` makes the dishes of a restaurant independent, so a
Gibbs round draws x for every restaurant and t for every dish, side by side.
Words' probabilities are those at the beginning of the round. After a burn-in
the predictive probabilities of the following rounds are averaged.

How it is spread: pairs live in buckets by the hash of their context, frequent
contexts in several, as packed arrays; a word's row lives in a plain table. In a
round buckets ask for the words whose number of tables is open (pairs seen more
than once) and return their tables. At the end documents send their pairs to the
buckets, which return sums per document. No pair, context or word has to fit
anywhere whole; tasks stream the messages of a bucket.
"""

from __future__ import annotations

import itertools
import math
import pickle
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from scenelake.llm.common import arrow_pass, release, settle, utf8

ROUNDS = 3
BURN_IN = 1  # rounds whose probabilities are not averaged
STRENGTH = 1.0
BUCKET_TOKENS = 6 << 20
PIECE_BYTES = 10 << 20  # texts whose pairs are counted together before they travel
PIECE_DOCS = 1 << 16
SPLIT_BYTES = 2 << 20  # of the texts of a piece, split into words at once
HOT_WORDS = 1 << 16  # most contexts that may be split, so the list of them is bounded
LAYOUT_EVERY = 16  # one document in so many is read to plan where rows go; results don't depend on it
SLICE = 1 << 18  # pairs whose figures are worked out at once
EXACT = 64  # dishes of up to this many customers draw their tables exactly, larger ones by saddle point
HELD_OUT = 10

_STEP = np.uint64(0x9E3779B97F4A7C15)
_HASH = np.uint64((1 << 56) - 1)  # words are told apart by hashes of 56 bits, which travel as seven bytes
_END = np.uint64(0x1D3C5B7A9E2468)  # the end of a text
_MESSAGE = "bucket int, kind string, data binary"
_KINDS = pa.int32(), pa.string(), pa.binary()


def held_out(doc_id: str = "doc_id"):
    """crc32(doc_id as text) mod 10 is 0; a null id is not held out."""
    crc = F.crc32(F.col(doc_id).cast("string").cast("binary"))
    return F.coalesce(crc % HELD_OUT == 0, F.lit(False))


def pack(*arrays) -> bytes:
    """Arrays in the smallest unsigned type, compressed."""
    small = [a.astype(np.min_scalar_type(int(a.max()))) if a.dtype.kind in "iu" and a.size and a.min() >= 0 else a
             for a in map(np.asarray, arrays)]
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(small, protocol=5))


def unpack(data) -> list[np.ndarray]:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(data))


def _mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SPACE = np.isin(np.arange(256), list(b"\x09\x0a\x0b\x0c\x0d\x20"))
_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)  # masks of the first n bytes


def word_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of each word of a text; eight bytes of all words at a time."""
    data = np.frombuffer(text + bytes(8), dtype=np.uint8)
    space = _SPACE[data[:len(text)]]
    edges = np.flatnonzero(np.diff(np.r_[True, space, True]))
    start, length = edges[::2], edges[1::2] - edges[::2]
    eight = np.ndarray(len(text) + 1, dtype="<u8", buffer=data, strides=(1,))
    found = length.astype(np.uint64) * _STEP
    at, left, open_words = start.copy(), length.copy(), slice(None)
    while len(at):
        part = np.take(eight, at) & _BYTES[np.minimum(left, 8)]
        found[open_words] = _mix(found[open_words] * _STEP ^ part)
        more = np.flatnonzero(left > 8)
        open_words = more if isinstance(open_words, slice) else open_words[more]
        at, left = at[more] + 8, left[more] - 8
    return start, found & _HASH


def hash_of(word: bytes) -> int:
    return int(word_hashes(word)[1][0]) if word else int(_END)


@dataclass
class Piece:
    """Texts of some documents as numbers of words, in the order of their hashes."""

    hashes: np.ndarray  # of each number, ascending
    words: np.ndarray  # tokens of all documents, each closed by an end
    before: np.ndarray  # what stands before each token; a text begins after an end
    doc: np.ndarray  # of each token
    sizes: np.ndarray  # tokens of each document

    def keys(self) -> np.ndarray:
        keys = self.before.astype(np.int64)
        keys *= len(self.hashes)
        keys += self.words
        return keys


def _split(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens of the texts, and tokens of each text."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    joined = b"\n".join(texts)
    begins = np.cumsum(sizes + 1) - sizes - 1
    docs, hashes, low = [], [], 0
    while low < len(joined):
        high = low + SPLIT_BYTES
        if high < len(joined):  # a word is never cut
            while high < len(joined) and not _SPACE[joined[high]]:
                high += 1
        start, found = word_hashes(joined[low:high].lower())
        docs.append((np.searchsorted(begins, start + low, side="right") - 1).astype(np.int32))
        hashes.append(found)
        low = high
    del joined
    counts = sum((np.bincount(d, minlength=len(texts)) for d in docs), np.zeros(len(texts), dtype=np.int64))
    tokens = np.full(sum(map(len, docs)) + len(texts), _END, dtype=np.uint64)
    at = 0
    for doc, found in zip(docs, hashes):
        tokens[np.arange(at, at + len(doc)) + doc] = found
        at += len(doc)
    return tokens, counts + 1


def _numbered(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes, ascending, and the place of each token's among them, in fewer arrays than ``np.unique``."""
    order = np.argsort(tokens)
    tokens = tokens[order]
    new = np.r_[True, tokens[1:] != tokens[:-1]]
    tokens = tokens[new]
    words = np.empty(len(order), dtype=np.int32)
    words[order] = np.cumsum(new, dtype=np.int32) - np.int32(1)
    return tokens, words


def pieces(batches, at: int):
    """(piece, batches it covers) from an iterator of Arrow batches with texts in column ``at``."""
    texts, covered, used = [], [], 0

    def closed():
        tokens, sizes = _split(texts)
        texts.clear()
        hashes, words = _numbered(tokens)
        del tokens
        end = np.int32(np.searchsorted(hashes, _END))
        return Piece(hashes, words, np.r_[end, words[:-1]], np.repeat(np.arange(len(sizes), dtype=np.int32), sizes), sizes), covered

    for batch in batches:
        texts += [t.as_py() or b"" for t in batch.column(at)]
        used += batch.column(at).nbytes
        covered.append(batch)
        if used >= PIECE_BYTES or len(texts) >= PIECE_DOCS:
            yield closed()
            texts, covered, used = [], [], 0
            del batch
    if covered:
        yield closed()


@dataclass(frozen=True)
class Layout:
    """Where pairs live: number of buckets, and the contexts that are split over several."""

    buckets: int
    hot: np.ndarray  # sorted hashes
    parts: np.ndarray  # buckets of each

    def is_hot(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.hot):
            return np.zeros(len(hashes), dtype=bool)
        return self.hot[np.minimum(np.searchsorted(self.hot, hashes), len(self.hot) - 1)] == hashes

    def parts_of(self, hashes: np.ndarray) -> np.ndarray:
        parts, found = np.ones(len(hashes), dtype=np.uint64), self.is_hot(hashes)
        parts[found] = self.parts[np.searchsorted(self.hot, hashes[found])]
        return parts

    def bucket(self, context: np.ndarray, parts: np.ndarray, word: np.ndarray) -> np.ndarray:
        return (_mix(context + _mix(word) % parts) % np.uint64(self.buckets)).astype(np.int32)

    def buckets_of(self, hashes: np.ndarray, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """``bucket`` of pairs given as numbers of ``hashes``."""
        parts, found = self.parts_of(hashes), np.empty(len(context), dtype=np.int32)
        for low in range(0, len(context), SLICE):
            c, w = context[low:low + SLICE], word[low:low + SLICE]
            found[low:low + SLICE] = self.bucket(hashes[c], parts[c], hashes[w])
        return found


def plan(docs: DataFrame) -> Layout:
    """Buckets by the number of tokens; contexts with a notable part of a bucket are split. Results don't depend on it."""

    def run(batches):
        for batch in batches:
            size = sum(len(t.as_py() or b"") for t in batch.column(0))
            read = [t.as_py() or b"" for t in batch.column(0)[::LAYOUT_EVERY]]
            tokens = _split(read)[0]
            share = len(tokens) / max(1, sum(map(len, read)))  # tokens a byte
            hashes, counts = np.unique(tokens, return_counts=True)
            heavy = counts >= max(8, len(tokens) // HOT_WORDS)
            total = int(share * size) + batch.num_rows
            scaled = counts[heavy] * (total / max(1, len(tokens)))
            yield pa.RecordBatch.from_arrays([
                pa.array([None, *hashes[heavy].view(np.int64).tolist()], pa.int64()),
                pa.array([total, *scaled.astype(np.int64).tolist()], pa.int64())], ["h", "n"])

    counts = settle(arrow_pass(docs.select(utf8()), run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")))
    total = counts.where("h IS NULL").collect()
    total = total[0]["n"] if total else 0
    buckets = -(-total // BUCKET_TOKENS) or 1
    share = max(BUCKET_TOKENS // 4, total // HOT_WORDS)
    found = {np.int64(r["h"]).view(np.uint64): -(-r["n"] // share)
             for r in counts.where(F.col("h").isNotNull() & (F.col("n") >= share)).collect()} if buckets > 1 else {}
    hot = np.array(sorted(found), dtype=np.uint64)
    return Layout(buckets, hot, np.array([min(found[h], buckets) for h in hot], dtype=np.uint64))


def _message(bucket: int, kind: str, data: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((bucket, kind, data), _KINDS)], ["bucket", "kind", "data"])


def _pair_blob(piece: Piece, context: np.ndarray, word: np.ndarray, *more) -> bytes:
    """Pairs sorted by context, then word: hashes of the contexts with their runs, of the words, and word numbers."""
    first = np.flatnonzero(np.diff(context, prepend=-1))
    used = np.zeros(len(piece.hashes) + 1, dtype=np.int64)
    used[word + 1] = 1
    return pack(deltas(piece.hashes[context[first]]), np.diff(np.r_[first, len(context)]),
                deltas(piece.hashes[np.flatnonzero(used[1:])]), np.cumsum(used)[word], *more)


def deltas(hashes: np.ndarray) -> np.ndarray:
    """Ascending hashes as steps, byte by byte, so that leading zeros compress."""
    return np.diff(hashes, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T.copy()


def undeltas(planes: np.ndarray) -> np.ndarray:
    return np.cumsum(planes.T.copy().view("<u8").ravel().astype(np.uint64), dtype=np.uint64)


def _slices(buckets: np.ndarray):
    order = np.argsort(buckets.astype(np.int16) if len(buckets) and buckets.max() < 1 << 15 else buckets, kind="stable")
    cuts = np.flatnonzero(np.diff(buckets[order])) + 1
    for part in np.split(order, cuts) if len(order) else ():
        yield int(buckets[part[0]]), part


def _pairs(docs: DataFrame, layout: Layout) -> DataFrame:
    """Messages ``pairs``: the pairs of a piece with their number in training texts (0: in held-out ones only)."""

    def counted(piece, covered):
        size = np.int64(len(piece.hashes))
        held = np.concatenate([b.column(1).to_numpy(zero_copy_only=False) for b in covered])
        covered.clear()
        key = piece.keys()
        key *= 2
        key += held[piece.doc]
        piece.words = piece.before = piece.doc = None
        key.sort()
        trained = (key & 1 == 0).astype(np.int8)
        key >>= 1
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        count = np.add.reduceat(trained, starts, dtype=np.int64)
        key = key[starts]
        del starts, trained
        word = (key % size).astype(np.int32)
        key //= size
        context = key.astype(np.int32)
        del key
        for b, part in _slices(layout.buckets_of(piece.hashes, context, word)):
            yield _message(b, "pairs", _pair_blob(piece, context[part], word[part], count[part]))

    def run(batches):
        for taken in pieces(batches, 0):
            yield from counted(*taken)
            del taken

    return arrow_pass(docs.select(utf8(), held_out().alias("held")), run, _MESSAGE)


def _streamed(messages: DataFrame, function, schema: str, *order: str) -> DataFrame:
    """``function(bucket, iterator of (kind, arrays))`` for each bucket, messages in the order of their kinds."""

    def run(batches):
        rows = ((batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), batch.column(2)[i].as_py())
                for batch in batches for i in range(batch.num_rows))
        for bucket, group in itertools.groupby(rows, key=lambda r: r[0]):
            yield from function(bucket, ((kind, unpack(data)) for _, kind, data in group))

    dealt = messages.repartition("bucket").sortWithinPartitions("bucket", "kind", *order)
    return arrow_pass(dealt.select("bucket", "kind", "data"), run, schema)


class Pairs:
    """Distinct pairs of a bucket: sorted contexts and words, pairs sorted by (context, word), and their counts."""

    def __init__(self, contexts, runs, words, number, count):
        self.contexts, self.words = contexts, words
        self.context = np.repeat(np.arange(len(contexts), dtype=np.int32), runs)
        self.word, self.count = number.astype(np.int32), count.astype(np.int64)

    @classmethod
    def merged(cls, blobs: list[list[np.ndarray]]) -> Pairs:
        blobs = [[undeltas(b[0]), b[1], undeltas(b[2]), *b[3:]] for b in blobs]
        contexts = np.unique(np.concatenate([b[0] for b in blobs]))
        words = np.unique(np.concatenate([b[2] for b in blobs]))
        keys = np.empty(sum(len(b[3]) for b in blobs), dtype=np.int64)
        counts, at = np.empty(len(keys), dtype=np.result_type(*(b[4].dtype for b in blobs))), 0
        while blobs:
            blob = blobs.pop()
            keys[at:at + len(blob[3])] = locate(contexts, words, blob)
            counts[at:at + len(blob[3])] = blob[4]
            at += len(blob[3])
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        del order
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        counts, keys = np.add.reduceat(counts, starts, dtype=np.int64), keys[starts]
        del starts
        word = (keys % len(words)).astype(np.int32)
        keys //= len(words)
        return cls(contexts, np.bincount(keys, minlength=len(contexts)), words, word, counts)

    def blob(self) -> bytes:
        return pack(deltas(self.contexts), np.bincount(self.context, minlength=len(self.contexts)), deltas(self.words),
                    self.word, self.count)

    @classmethod
    def of(cls, arrays: list[np.ndarray]) -> Pairs:
        return cls(undeltas(arrays[0]), arrays[1], undeltas(arrays[2]), *arrays[3:])

    def keys(self) -> np.ndarray:
        keys = self.context.astype(np.int64)
        keys *= len(self.words)
        keys += self.word
        return keys


def locate(contexts: np.ndarray, words: np.ndarray, blob: list[np.ndarray]) -> np.ndarray:
    """Keys of a message's pairs among sorted contexts and words."""
    context = np.repeat(np.searchsorted(contexts, blob[0]), blob[1])
    return context * np.int64(len(words)) + np.searchsorted(words, blob[2])[blob[3]]


def _merge(bucket: int, messages):
    """Bucket states: ``pairs``, and ``sums`` for the discount."""
    pairs = Pairs.merged([blob for _, blob in messages])
    yield _message(bucket, "pairs", pairs.blob())
    yield _message(bucket, "sums", pack(np.array([(pairs.count == 1).sum(), (pairs.count == 2).sum()])))


def _opened(state: DataFrame) -> DataFrame:
    """Messages ``open``: the pairs with more than one customer, at one table each."""

    def run(batches):
        for batch in batches:
            for bucket, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                pairs = Pairs.of(unpack(data.as_py()))
                once = np.bincount(pairs.context[pairs.count == 1], minlength=len(pairs.contexts))
                more = np.flatnonzero(pairs.count > 1)
                contexts, context = np.unique(pairs.context[more], return_inverse=True)
                words, word = np.unique(pairs.word[more], return_inverse=True)
                yield _message(bucket, "open", pack(
                    deltas(pairs.contexts[contexts]), once[contexts], context, deltas(pairs.words[words]), word,
                    pairs.count[more], np.ones(len(more), dtype=np.int64)))

    return arrow_pass(state.where("kind = 'pairs'").select("bucket", "data"), run, _MESSAGE)


def _word_rows(state: DataFrame, kind: str) -> DataFrame:
    """(w, bucket, c, once, k) of a bucket's words: customers, pairs seen once, pairs."""
    names = ["w", "bucket", "c", "once", "k"]

    def run(batches):
        for batch in batches:
            for bucket, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                arrays = unpack(data.as_py())
                if kind == "open":
                    words = undeltas(arrays[3])
                    more = [np.zeros(len(words), dtype=np.int64)] * 3
                else:
                    pairs = Pairs.of(arrays)
                    words, n = pairs.words, len(pairs.words)
                    more = [np.bincount(pairs.word, weights, n).astype(np.int64) for weights in (
                        pairs.count, pairs.count == 1, pairs.count > 0)]
                yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(np.full(len(words), bucket, dtype=np.int32)),
                                                  *map(pa.array, more)], names)

    return arrow_pass(state.where(F.col("kind") == kind).select("bucket", "data"), run,
                      "w long, bucket int, c long, once long, k long")


def _replies(asked: DataFrame, columns: list[str]) -> DataFrame:
    """Messages ``reply``: a bucket's words with the given columns."""

    def run(batches):
        for batch in batches:
            buckets = batch.column(0).to_numpy()
            words = batch.column(1).to_numpy().view(np.uint64)
            values = [batch.column(i + 2).to_numpy() for i in range(len(columns))]
            for bucket, part in _slices(buckets):
                yield _message(bucket, "reply", pack(words[part], *[v[part] for v in values]))

    return arrow_pass(asked.select("bucket", "w", *columns), run, _MESSAGE)


def _log_stirling(discount: float, size: int) -> np.ndarray:
    """log S(c, t) of c customers at t tables: S(c + 1, t) = S(c, t - 1) + (c - d t) S(c, t)."""
    table = np.full((size + 1, size + 1), -np.inf)
    table[0, 0] = 0
    t = np.arange(1, size + 1)
    for c in range(size):
        stay = np.where(t <= c, np.log(np.maximum(c - discount * t, 1e-300)) + table[c, 1:], -np.inf)
        table[c + 1, 1:] = np.logaddexp(table[c, :-1], stay)
    return table


def _saddle(c: np.ndarray, log_q: np.ndarray, discount: float):
    """Mean, variance and curvature of the coefficient of z**(c - 1) in ``s**(d - 1) exp(q (1 - s**d) / d)``, s = 1 - z."""
    low, high = np.full(len(c), -700.0), np.full(len(c), -1e-12)  # of log s
    for _ in range(80):
        middle = (low + high) / 2
        above = np.log(-np.expm1(middle)) + np.logaddexp(
            np.log1p(-discount) - middle, log_q + (discount - 1) * middle) > np.log(c - 1)
        low, high = np.where(above, middle, low), np.where(above, high, middle)
    log_s = (low + high) / 2
    s, z = np.exp(log_s), -np.expm1(log_s)
    more = -np.exp(log_q) / discount * np.expm1(discount * log_s)
    flow = np.exp(log_q + (discount - 1) * log_s)
    slope = flow * z / ((1 - discount) / s + flow * s + flow * z * (1 - discount))  # of log s along log q
    curve = (1 - discount) * z / s ** 2 + flow * z + flow * z * z * (1 - discount) / s
    return more, more - flow * s * slope, np.log(curve)


def expected_tables(c: np.ndarray, q: np.ndarray, discount: float) -> tuple[np.ndarray, np.ndarray]:
    """Mean and variance of the tables of many customers: saddle point with its first correction. One table is certain."""
    step = 0.02
    below, (more, variance, curve), above = (_saddle(c, np.log(q) + h, discount) for h in (-step, 0.0, step))
    more = more - (above[2] - below[2]) / (4 * step)
    variance = variance - (above[2] - 2 * curve + below[2]) / (2 * step ** 2)
    return 1 + np.maximum(more, 0), np.maximum(variance, 1e-9)


def draw_tables(c: np.ndarray, q: np.ndarray, discount: float, stirling: np.ndarray, random) -> np.ndarray:
    """Tables of dishes with c customers, from weights S(c, t) q**t."""
    t = np.minimum(c, 1)
    for size in range(2, EXACT + 1):
        rows = np.flatnonzero(c == size)
        for part in np.array_split(rows, max(1, len(rows) * size // 2_000_000)):
            if len(part):
                weights = stirling[size, 1:size + 1] + np.log(q[part])[:, None] * np.arange(1, size + 1)
                weights = np.exp(weights - weights.max(axis=1, keepdims=True)).cumsum(axis=1)
                t[part] = 1 + (weights < random.random(len(part))[:, None] * weights[:, -1:]).sum(axis=1)
    rows = np.flatnonzero(c > EXACT)
    if len(rows):
        mean, variance = expected_tables(c[rows].astype(np.float64), q[rows], discount)
        # The further tables are a sum of independent trials; a binomial with their mean and variance stands for it.
        more = mean - 1
        trials = np.maximum(np.ceil(more), np.rint(more ** 2 / np.maximum(more - variance, 1e-12 * (more + 1e-12)))).clip(1, 2 ** 62)
        t[rows] = np.minimum(1 + random.binomial(trials.astype(np.int64), np.minimum(more / trials, 1)), c[rows])
    return t


def discount_of(once: int, twice: int) -> float:
    """Discount from the numbers of dishes with one and with two customers."""
    return min(max(once / (once + 2 * twice) if once else 0.5, 0.05), 0.95)


@dataclass(frozen=True)
class Root:
    """Totals of the restaurant of words in a round."""

    types: int
    customers: int
    tables: int
    discount: float

    def probability(self, k, t):
        """Of a word with k customers at t tables; arrays or columns."""
        new = (STRENGTH + self.discount * self.tables) / (self.types + 1)
        return (k - t * self.discount + new) / (STRENGTH + self.customers)


def _seats(bucket: int, messages, number: int, layout: Layout, hot: dict[int, int], root: Root, discount: float):
    """One Gibbs round over the open pairs of a bucket."""
    state, found = None, []
    for kind, arrays in messages:
        if kind == "open":
            state = arrays
        else:
            found.append(arrays)
    contexts, once, context, words, word, count, *earlier = state
    contexts, words = undeltas(contexts), undeltas(words)
    tables, random = earlier[-1].astype(np.int64), np.random.default_rng([bucket, number])
    p = np.zeros(len(words))
    for w, k, t in found:
        p[np.searchsorted(words, w)] = root.probability(k.astype(np.float64), t)
    seated = once + np.bincount(context, tables, len(contexts))
    x = random.standard_gamma(STRENGTH / discount + seated)
    for i in np.flatnonzero(layout.is_hot(contexts)):  # all parts of a split context draw the same value
        h = int(contexts[i])
        x[i] = np.random.default_rng([h, number]).standard_gamma(STRENGTH / discount + hot.get(h, 0))
    tables = draw_tables(count.astype(np.int64), x[context] * discount * p[word], discount, _log_stirling(discount, EXACT), random)
    yield _message(bucket, "open", pack(deltas(contexts), once, context, deltas(words), word, count, *earlier[number <= BURN_IN + 1:], tables))
    yield _message(bucket, "tables", pack(words, np.bincount(word, tables, len(words)).astype(np.int64)))


def _exploded(state: DataFrame, kind: str, names: tuple[str, str], first: int = 0, second: int = 1) -> DataFrame:
    """Two arrays of a kind of message as rows."""

    def run(batches):
        for batch in batches:
            for data in batch.column(0):
                arrays = unpack(data.as_py())
                yield pa.RecordBatch.from_arrays([pa.array(arrays[first].view(np.int64)), pa.array(arrays[second].astype(np.int64))],
                                                 list(names))

    return arrow_pass(state.where(F.col("kind") == kind).select("data"), run, f"{names[0]} long, {names[1]} long")


def _hot_totals(state: DataFrame, layout: Layout) -> tuple[dict[int, int], list[dict[int, int]]]:
    """Customers, and tables in each sample, of the split contexts, over all their buckets; at most ``HOT_WORDS`` rows."""
    if not len(layout.hot):
        return {}, [{}]
    names = ["h", "i", "n"]

    def run(batches):
        for batch in batches:
            for kind, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                arrays, out = unpack(data.as_py()), []
                contexts = undeltas(arrays[0])
                at = np.flatnonzero(layout.is_hot(contexts))
                if kind == "pairs":
                    pairs = Pairs.of(arrays)
                    out.append(np.bincount(pairs.context, pairs.count, len(contexts)))
                    out.append(np.bincount(pairs.context, pairs.count == 1, len(contexts)))
                else:
                    out += [None, None, *(np.bincount(arrays[2], t, len(contexts)) for t in arrays[6:])]
                for i, sums in enumerate(out):
                    if sums is not None:
                        yield pa.RecordBatch.from_arrays([pa.array(contexts[at].view(np.int64)), pa.array(np.full(len(at), i)),
                                                          pa.array(sums[at].astype(np.int64))], names)

    rows = arrow_pass(state.where(F.col("kind").isin("pairs", "open")).select("kind", "data"), run, "h long, i long, n long")
    found: dict[int, Counter] = {}
    for h, i, n in rows.groupBy("h", "i").agg(F.sum("n")).collect():
        found.setdefault(i, Counter())[int(np.int64(h).view(np.uint64))] = n
    customers, once = found.get(0, {}), found.get(1, {})
    samples = [{h: once[h] + found[i].get(h, 0) for h in once} for i in sorted(found) if i > 1]
    return dict(customers), samples or [dict(once)]


@dataclass(frozen=True)
class Model:
    """A sampled model: bucket states and words as written tables, and the totals."""

    layout: Layout
    state: DataFrame  # pairs and open pairs with the tables of every kept round
    words: DataFrame  # w, c, and k{i}, t{i} of every kept round
    roots: tuple[Root, ...]
    discount: float
    tokens: int
    types: int


def _root_draw(rows: DataFrame, root: Root, number: int) -> DataFrame:
    """Tables of the words in their own restaurant: ``t`` from ``k``."""
    x = float(np.random.default_rng([7, number]).standard_gamma(STRENGTH / root.discount + root.tables))
    q = x * root.discount / (root.types + 1)
    at, schema = rows.columns.index("k"), rows.schema.simpleString()[7:-1] + ",t:bigint"

    def run(batches):
        stirling = _log_stirling(root.discount, EXACT)
        for batch in batches:
            k, w = batch.column(at).to_numpy(), batch.column(0).to_numpy()
            random = np.random.default_rng([number, len(w), *(w[:1].view(np.uint64))])
            t = draw_tables(k, np.full(len(k), q), root.discount, stirling, random)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(t)], [*batch.schema.names, "t"])

    return arrow_pass(rows, run, schema)


def train(docs: DataFrame, rounds: int = ROUNDS) -> Model:
    """Count pairs of all documents, seat those of the training documents, and keep the rounds after the burn-in."""
    layout = plan(docs)
    state = settle(_streamed(_pairs(docs, layout), _merge, _MESSAGE))
    sums = _exploded_sums(state)
    discount = discount_of(*sums)
    words = settle(_word_rows(state, "pairs").groupBy("w").agg(
        F.sum("c").alias("c"), F.sum("once").alias("once"), F.sum("k").alias("k")).where("c > 0"))
    is_one = F.col("c") == 1
    total = words.agg(F.sum("c"), F.count("*"), F.count_if(is_one), F.sum("k"), F.count_if(F.col("k") == 1), F.count_if(F.col("k") == 2)).collect()[0]
    tokens, types, ones, customers, once, twice = (v or 0 for v in total)
    root = Root(types, customers, types, discount_of(once, twice))
    # A word with one customer sits at one table whatever happens; only the others go through the rounds.
    static = words.where(~is_one).select("w", "c", "once")
    current = words.where(~is_one).select("w", "k", F.lit(1).cast("long").alias("t"))
    pairs, seats, roots = state.where("kind = 'pairs'"), _opened(state), []
    for number in range(1, rounds + 1):
        asked = _word_rows(seats, "open").select("w", "bucket").join(current, "w")
        hot = _hot_totals(pairs.unionAll(seats), layout)[1][-1]
        step = lambda bucket, messages, n=number, h=hot, r=root: _seats(bucket, messages, n, layout, h, r, discount)
        seats = settle(_streamed(seats.where("kind = 'open'").unionAll(_replies(asked, ["k", "t"])), step, _MESSAGE))
        sent = _exploded(seats, "tables", ("w", "sent")).groupBy("w").agg(F.sum("sent").alias("sent"))
        seated = static.join(sent, "w", "left").select(
            "w", "c", "once", *[x for i in range(len(roots)) for x in (f"k{i}", f"t{i}")],
            (F.col("once") + F.coalesce("sent", F.lit(0))).alias("k"))
        drawn = settle(_root_draw(seated, root, number))
        customers, tables = ((v or 0) + ones for v in drawn.agg(F.sum("k"), F.sum("t")).collect()[0])
        root = Root(types, customers, tables, root.discount)
        current = drawn.select("w", "k", "t")
        if number > BURN_IN:
            static = drawn.withColumnsRenamed({"k": f"k{len(roots)}", "t": f"t{len(roots)}"})
            roots.append(root)
        del asked, sent, seated, drawn
        release(docs.sparkSession)  # the tables of the round before
    sole = words.where(is_one).select("w", "c", *[F.lit(1).cast("long").alias(x) for x in _samples(len(roots))])
    return Model(layout, pairs.unionAll(seats.where("kind = 'open'")), static.select("w", "c", *_samples(len(roots))).unionAll(sole),
                 tuple(roots), discount, tokens, types)


def _samples(n: int) -> list[str]:
    return [x for i in range(n) for x in (f"k{i}", f"t{i}")]


def _exploded_sums(state: DataFrame) -> tuple[int, int]:
    """Pairs with one and with two customers."""

    def run(batches):
        for batch in batches:
            for data in batch.column(0):
                once, twice = unpack(data.as_py())[0].tolist()
                yield pa.RecordBatch.from_arrays([pa.array([once], pa.int64()), pa.array([twice], pa.int64())], ["once", "twice"])

    rows = arrow_pass(state.where(F.col("kind") == "sums").select("data"), run, "once long, twice long")
    once, twice = rows.agg(F.sum("once"), F.sum("twice")).collect()[0]
    return once or 0, twice or 0


def _postings(docs: DataFrame, layout: Layout) -> DataFrame:
    """Messages of pieces: ``z`` pairs with documents and counts; ``y`` ids and sizes of the documents, sent along."""

    def posted(name, piece, covered):
        size, lengths = np.int64(len(piece.hashes)), piece.sizes
        ids = pa.concat_arrays([b.column(2) for b in covered])
        held = np.concatenate([b.column(1).to_numpy(zero_copy_only=False) for b in covered])
        covered.clear()
        stored = pa.RecordBatch.from_arrays([ids], ["doc_id"])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, stored.schema) as writer:
            writer.write_batch(stored)
        yield _message(int(name % layout.buckets), "y", pack(
            np.array([name]), np.frombuffer(sink.getvalue(), dtype=np.uint8), held.astype(np.uint8), lengths))
        docs_of = np.int64(len(lengths))
        key, pair = piece.keys(), None
        if int(size) ** 2 * int(docs_of) >= 1 << 63:  # number the pairs first
            pair, key = np.unique(key, return_inverse=True)
        key *= docs_of
        key += piece.doc
        piece.words = piece.before = piece.doc = None
        key.sort()
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        n = np.diff(np.r_[starts, len(key)]).astype(np.int32)
        key = key[starts]
        del starts
        doc = (key % docs_of).astype(np.int32)
        key //= docs_of
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        entries = np.r_[first, len(key)]  # of each pair, up to the next one's
        key = key[first] if pair is None else pair[key[first]]
        del first, pair
        word = (key % size).astype(np.int32)
        key //= size
        context = key.astype(np.int32)
        del key
        for b, part in _slices(layout.buckets_of(piece.hashes, context, word)):
            length = entries[part + 1] - entries[part]
            within = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
            at = np.repeat(entries[part], length) + within
            yield _message(b, "z", _pair_blob(piece, context[part], word[part], length, doc[at], n[at], np.array([name])))

    def run(batches):
        partition = TaskContext.get().partitionId() << 32
        for number, taken in enumerate(pieces(batches, 0)):
            yield from posted(np.int64(partition + number), *taken)
            del taken

    return arrow_pass(docs.select(utf8(), held_out().alias("held"), "doc_id"), run, _MESSAGE)


def _scores(bucket: int, messages, model: tuple, hot: tuple):
    """Sums per document and piece: log10 probabilities of the model and the base, known tokens."""
    layout, roots, discount, tokens, types = model
    customers_of, tables_of = hot
    pairs, seats, replies, values = None, None, [], None

    def valued():
        n = len(pairs.words)
        alone = (np.bincount(pairs.word, pairs.count, n) > 0).astype(np.float64)  # unless a reply says more
        seen, k, t = alone.copy(), np.tile(alone, (len(roots), 1)), np.tile(alone, (len(roots), 1))
        while replies:
            reply = replies.pop()
            at = np.searchsorted(pairs.words, reply[0])
            seen[at] = reply[1]
            for i in range(len(roots)):
                k[i, at], t[i, at] = reply[2 + 2 * i], reply[3 + 2 * i]
        where = np.flatnonzero(layout.is_hot(pairs.contexts))
        customers = np.bincount(pairs.context, pairs.count, len(pairs.contexts))
        customers[where] = [customers_of.get(int(h), 0) for h in pairs.contexts[where]]
        score = np.zeros(len(pairs.count))
        slices = [slice(low, low + SLICE) for low in range(0, len(score), SLICE)]
        more = np.flatnonzero(pairs.count > 1)
        for i, root in enumerate(roots):
            tables = np.minimum(pairs.count, 1)
            tables[more] = seats[6 + i]
            of_context = np.bincount(pairs.context, tables, len(pairs.contexts))
            of_context[where] = [tables_of[i].get(int(h), 0) for h in pairs.contexts[where]]
            parent, new = root.probability(k[i], t[i]), STRENGTH + discount * of_context
            for at in slices:
                score[at] += pairs.count[at] - discount * tables[at] + new[pairs.context[at]] * parent[pairs.word[at]]
        for at in slices:
            score[at] = np.log10(score[at] / len(roots) / (STRENGTH + customers[pairs.context[at]]))
        keys = pairs.keys()
        pairs.context = pairs.word = pairs.count = None  # their keys and values do from here on
        return keys, score, np.log10((seen + 0.1) / (tokens + 0.1 * (types + 1))), seen > 0

    for kind, arrays in messages:
        if kind == "pairs":
            pairs = Pairs.of(arrays)
        elif kind == "open":
            seats = arrays
        elif kind == "reply":
            replies.append(arrays)
        elif kind == "y":
            yield _part(arrays[0][0], "y", bucket, pack(*arrays[1:]))
        else:
            if values is None:
                values, seats = valued(), None
            keys, score, base, known = values
            key = locate(pairs.contexts, pairs.words, [undeltas(arrays[0]), arrays[1], undeltas(arrays[2]), arrays[3]])
            length, doc, n, name = arrays[4:]
            at, docs = np.repeat(np.searchsorted(keys, key), length), int(doc.max()) + 1
            word = np.repeat(key % len(pairs.words), length)
            sums = [np.bincount(doc, n * x, docs) for x in (score[at], base[word], known[word])]
            yield _part(name[0], "z", bucket, pack(sums[0], sums[1], sums[2].astype(np.int64)))


def _part(name: int, kind: str, bucket: int, data: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([int(name)], pa.int64()), pa.array([kind]), pa.array([bucket], pa.int32()),
                                       pa.array([data], pa.binary())], ["bucket", "kind", "source", "data"])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Null and empty texts are an end alone, which is one token. Training on an
    empty table leaves one outcome, of probability 1. Rows with one doc_id are
    scored by their own texts; a null doc_id is a training document; further
    columns are ignored. ``score`` covers the end of the text as well.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    columns = _samples(len(model.roots))
    # A bucket that has the only customer of a word needs no reply.
    asked = _word_rows(model.state, "pairs").select("w", "bucket", F.col("c").alias("own")).join(model.words, "w").where("own <> 1 OR c <> 1")
    replies = settle(_replies(asked, ["c", *columns]))
    release(docs.sparkSession)
    hot = _hot_totals(model.state, model.layout)
    arguments = model.layout, model.roots, model.discount, model.tokens, model.types
    messages = model.state.unionAll(replies).unionAll(_postings(docs, model.layout))
    parts = _streamed(messages, lambda bucket, rows: _scores(bucket, rows, arguments, hot),
                      "bucket long, kind string, source int, data binary")
    tokens = model.tokens
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def collect(piece: int, rows):
        ids = held = lengths = sums = None
        for what, arrays in rows:
            if what == "y":
                ids = pa.ipc.open_stream(arrays[0].tobytes()).read_all().column(0).combine_chunks()
                held, lengths = arrays[1].astype(bool), arrays[2].astype(np.int64)
                sums = np.zeros((3, len(held)))
            else:
                sums[:, :len(arrays[0])] += arrays
        yield pa.RecordBatch.from_arrays([
            ids, pa.array(held), pa.array(lengths), pa.array(np.rint(sums[2]).astype(np.int64)),
            pa.array(np.full(len(held), tokens, dtype=np.int64)), pa.array(sums[1]), pa.array(sums[0])], names)

    return _streamed(parts, collect, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, "
                                     "base_score double, score double", "source")
