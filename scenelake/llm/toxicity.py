"""Toxicity by compression distance: how much shorter does a window get with the toxic dictionary?

Two zstandard dictionaries are trained on labelled text, one on toxic and one
on ordinary documents. The toxic one holds the words that mark toxic
documents, the ordinary one the commonest ordinary words, both of the same
length. Every window of a text is compressed with either; the difference of
the two lengths is large where the window speaks the toxic dictionary. The
counts of windows beyond each difference are turned into a probability by a
logistic curve calibrated on labelled documents that trained no dictionary.

Windows are written twice before compression: a block of some 30 bytes is
stored raw unless it shrinks by more than two bytes, which hides a single
short match; the second copy is always one match, so the block is always
compressed and every saved byte of the first copy shows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from scenelake.llm.common import arrow_pass, in_held_out, keep_rows, materialise, utf8

# Bounds of the labelled sample: documents per class, and bytes of a document that trains dictionaries.
SAMPLE_TOXIC = 2500
SAMPLE_ORDINARY = 5000
SAMPLE_BYTES = 1 << 16

WINDOW = 28
DICTIONARY_BYTES = 4096
STEPS = range(1, 13)  # differences (bytes) whose window counts are features
CHUNK = 4096  # windows compressed at once
THRESHOLD = 0.3

_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
               for c in range(256))


def words(text: bytes | None) -> list[bytes]:
    return text.translate(_WORDS).split() if text else []


def windows(text: bytes | None, size: int = WINDOW) -> Iterator[bytes]:
    """Whole text as windows of about ``size`` bytes, cut at words; a longer word is cut inside."""
    found = words(text)
    if not found:
        return
    line = b" " + b" ".join(found) + b" "
    start, last = 0, len(line) - 1
    while start < last:
        end = start + size
        if end < len(line):
            space = line.rfind(b" ", start + size // 2, end)
            end = space + 1 if space > 0 else end
        yield line[start:end]
        start = end - 1 if line[end - 1:end] == b" " else end


def _parameters():
    # A match needs five bytes: shorter ones occur by chance.
    return zstandard.ZstdCompressionParameters(
        window_log=12, hash_log=11, chain_log=11, search_log=4, min_match=5, target_length=64,
        strategy=zstandard.STRATEGY_DFAST, write_content_size=0, write_dict_id=0)


def compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    parameters = _parameters()
    content = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    content.precompute_compress(compression_params=parameters)
    return zstandard.ZstdCompressor(dict_data=content, compression_params=parameters)


def differences(text: bytes | None, toxic, ordinary) -> tuple[np.ndarray, int]:
    """Windows by difference (last step and above together), and their number."""
    counts, total, chunk = np.zeros(max(STEPS) + 1, dtype=np.int64), 0, []

    def flush():
        a = np.fromiter(map(len, ordinary.multi_compress_to_buffer(chunk)), np.int64, len(chunk))
        b = np.fromiter(map(len, toxic.multi_compress_to_buffer(chunk)), np.int64, len(chunk))
        return np.bincount(np.clip(a - b, 0, max(STEPS)), minlength=len(counts))

    for window in windows(text):
        chunk.append(window + window)
        if len(chunk) == CHUNK:
            counts, total = counts + flush(), total + CHUNK
            chunk.clear()
    if chunk:
        counts, total = counts + flush(), total + len(chunk)
    return counts, total


def features(counts: np.ndarray, total: int) -> np.ndarray:
    beyond = counts[::-1].cumsum()[::-1][list(STEPS)]
    return np.concatenate([np.log1p(beyond), [math.log1p(total)]])


@dataclass
class Model:
    """Dictionaries and calibration; a few kilobytes whatever the corpus."""

    toxic: bytes
    ordinary: bytes
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # the last one is the constant

    def fields(self) -> tuple:
        """Plain values: a broadcast is unpickled where this class may not be importable."""
        return self.toxic, self.ordinary, self.mean, self.scale, self.weights

    def scorer(self):
        if not self.toxic:  # nothing to learn from
            return lambda text: 0.0
        pair = compressor(self.toxic), compressor(self.ordinary)

        def score(text: bytes | None) -> float:
            counts, total = differences(text, *pair)
            if not total:
                return 0.0
            z = (features(counts, total) - self.mean) / self.scale
            margin = float(z @ self.weights[:-1] + self.weights[-1])
            return 1 / (1 + math.exp(-max(-40.0, min(40.0, margin))))

        return score


def _distinct(texts: list[bytes]) -> list[bytes]:
    """Leave out near copies (one of four minimal shingle hashes seen before): their rare words would mark them."""
    seen, kept = set(), []
    for text in texts:
        w = words(text)
        shingles = [b" ".join(w[i:i + 5]) for i in range(max(1, len(w) - 4))]
        marks = {(seed, min(xxhash.xxh64_intdigest(s, seed) for s in shingles)) for seed in range(4)}
        if not marks & seen:
            kept.append(text)
        seen |= marks
    return kept


def _units(text: bytes) -> set[bytes]:
    """Distinct words with their spaces."""
    return {b" " + w + b" " for w in words(text)}


def _chance(toxic: int, ordinary: int, share: float) -> float:
    """Probability that at least ``toxic`` of the documents with a unit are toxic, if a document is with ``share``."""
    n = toxic + ordinary
    return sum(math.comb(n, i) * share ** i * (1 - share) ** (n - i) for i in range(toxic, n + 1))


def train_dictionaries(toxic: list[bytes], ordinary: list[bytes]) -> tuple[bytes, bytes]:
    """Units far more frequent in toxic documents than chance explains among so many; and the commonest ordinary ones."""
    toxic, ordinary = _distinct(toxic), _distinct(ordinary)
    if not toxic or not ordinary:
        return b"", b""
    docs_with = [Counter(u for t in texts for u in _units(t)) for texts in (toxic, ordinary)]
    least = max(3, 0.01 * len(toxic))
    share = len(toxic) / (len(toxic) + len(ordinary))

    def weight(unit: bytes) -> float:
        n, m = docs_with[0][unit], docs_with[1][unit]
        p, q = n / len(toxic), (m + 0.5) / (len(ordinary) + 1)
        return n * math.log(p / q) if p > 8 * q and _chance(n, m, share) * len(docs_with[0]) < 1 else 0.0

    marked = {u: weight(u) for u, n in docs_with[0].items() if n >= least}
    # The end of a dictionary is the cheapest to refer to: strongest units last.
    chosen = [u for u in sorted(marked, key=lambda u: (marked[u], u)) if marked[u] > 0]
    first = b"".join(chosen)
    common = sorted(docs_with[1], key=lambda u: (-docs_with[1][u], u))[:2000]
    second = b"".join(common[::-1])
    size = min(DICTIONARY_BYTES, len(first), len(second))
    return (first[-size:], second[-size:]) if chosen and size >= 8 else (b"", b"")


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    x = np.column_stack([x, np.ones(len(x))])
    penalty = ridge * np.diag([1.0] * (x.shape[1] - 1) + [1e-6])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + penalty, x.T @ (p - y) + penalty @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _calibrated(toxic: bytes, ordinary: bytes, x: np.ndarray, y: np.ndarray) -> Model:
    mean, scale = x.mean(axis=0), np.where(x.std(axis=0) > 0, x.std(axis=0), 1.0)
    return Model(toxic, ordinary, mean, scale, _logistic((x - mean) / scale, y))


def _untrained() -> Model:
    return Model(b"", b"", np.zeros(0), np.ones(0), np.zeros(1))


def fit(sample: list[tuple[bytes, int, int]]) -> Model:
    """``sample``: (text, label, fold); fold 0 calibrates, the others train the dictionaries."""
    train = [(t, y) for t, y, fold in sample if fold]
    toxic, ordinary = train_dictionaries([t for t, y in train if y], [t for t, y in train if not y])
    rest = [(t, y) for t, y, fold in sample if not fold]
    if not toxic or len({y for _, y in rest}) < 2:
        return _untrained()
    pair = compressor(toxic), compressor(ordinary)
    return _calibrated(toxic, ordinary, np.array([features(*differences(t, *pair)) for t, _ in rest]),
                       np.array([y for _, y in rest], float))


def _sampled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, toxic, h (hash of the text taken for the id) and fold of the bounded sample.

    Labels meet usable documents first, so labels without one take no place. Of
    several texts of an id the one with the smallest hash counts; each class
    takes the ids with the smallest hash.
    """
    usable = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~in_held_out()).groupBy(
        "doc_id").agg(F.max("toxic").alias("toxic"))
    fold = F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(3))
    size = F.octet_length("text")
    texts = docs.where((size > 0) & ((size <= SAMPLE_BYTES) | (fold == 0))).select("doc_id", F.xxhash64("text").alias("h"))
    found = texts.join(usable, "doc_id").groupBy("doc_id", "toxic").agg(F.min("h").alias("h"))
    ids = None
    for value, most in ((1, SAMPLE_TOXIC), (0, SAMPLE_ORDINARY)):
        part = found.where(F.col("toxic") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        ids = part if ids is None else ids.unionByName(part)
    return materialise(ids.withColumn("fold", fold))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on a bounded labelled sample of the rows that are not held out.

    A third of the sample calibrates, by whole texts of any length whose features
    are made in tasks; the dictionaries are trained on the others, on texts of up
    to ``SAMPLE_BYTES``.
    """
    ids = _sampled(docs, labels)
    # Bounded by the two sample sizes, so it may be broadcast.
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").where(F.xxhash64("text") == F.col("h")).dropDuplicates(["doc_id"])
    sample = sorted(rows.where("fold <> 0").select("doc_id", utf8(), "toxic").collect(), key=lambda r: r[0])
    toxic, ordinary = train_dictionaries(*[[bytes(r[1]) for r in sample if r[2] == y] for y in (1, 0)])
    if not toxic:
        return _untrained()

    def run(batches):
        pair = compressor(toxic), compressor(ordinary)
        for batch in batches:
            found = [features(*differences(t, *pair)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([[float(v) for v in f] for f in found],
                                                                                        pa.list_(pa.float64()))], ["doc_id", "toxic", "x"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rest = arrow_pass(rows.where("fold = 0").select("doc_id", utf8(), F.col("toxic").cast("int").alias("toxic")), run,
                      f"doc_id {kind}, toxic int, x array<double>").collect()
    rest.sort(key=lambda r: r["doc_id"])
    if len({r["toxic"] for r in rest}) < 2:
        return _untrained()
    return _calibrated(toxic, ordinary, np.array([r["x"] for r in rest]), np.array([r["toxic"] for r in rest], float))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    Texts without a word (null and empty ones too) score 0; repeated rows get
    equal scores; without labels of both classes every score is 0. Other
    columns of ``docs`` are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model.fields())

    def run(batches):
        one = Model(*shared.value).scorer()
        for batch in batches:
            found = [one(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array(found, pa.float64()),
                pa.array([int(s >= THRESHOLD) for s in found], pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return arrow_pass(docs.select("doc_id", in_held_out().alias("held_out"), utf8()), run,
                      f"doc_id {kind}, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """Rows of ``docs`` that are not predicted toxic, all columns kept."""
    shared = docs.sparkSession.sparkContext.broadcast(model.fields())

    def judge(groups):
        one = Model(*shared.value).scorer()
        for texts in groups:
            yield [one(t) < THRESHOLD for t in texts]

    return keep_rows(docs, judge)
