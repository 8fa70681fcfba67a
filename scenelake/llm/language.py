"""Language identification: multinomial naive Bayes over hashed character n-grams.

N-grams of one to three characters are hashed into 2**16 buckets. Counts per
language and bucket are summed by Spark over all labelled rows that are not
held out; the matrix of log probabilities (languages x buckets) is broadcast.
A batch of texts is scored as one sparse matrix: the bucket numbers of all its
n-grams lie in one array with row boundaries, and each language's sum is a
gather and a segmented addition.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from scenelake.llm.common import arrow_pass, in_held_out

BITS = 16
ORDERS = (1, 2, 3)
MOST_LANGUAGES = 500  # the matrix takes 256 kB per language
SMOOTHING = 0.5
CONTEXT = max(ORDERS) - 1
CHUNK = 1 << 18  # characters hashed at once

_FACTORS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)  # odd multipliers of the hash
_ASCII_LETTER = re.compile("[A-Za-z]")
_FOLD = np.array([c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 else 32 for c in range(128)], dtype=np.uint32)


def has_letter(text: str | None) -> bool:
    return bool(text) and (bool(_ASCII_LETTER.search(text)) or any(map(str.isalpha, text)))


def _codes(text: str) -> np.ndarray:
    """Lower-case code points; ASCII characters other than letters count as spaces."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return np.where(codes < 128, _FOLD[codes & 127], codes).astype(np.uint32)


def _chunks(texts: list[str | None]):
    """(row numbers, starts, codes): texts joined into arrays of bounded size.

    Each piece begins with two characters of context, spaces before the first
    one of a text, whose n-grams are not counted (``CONTEXT``); a long text is
    spread over several pieces without losing or repeating an n-gram.
    """
    rows, starts, parts, size = [], [], [], 0
    for number, text in enumerate(texts):
        codes = _codes(text) if text else np.zeros(0, np.uint32)
        for begin in range(0, max(len(codes), 1), CHUNK):
            context = codes[begin - CONTEXT:begin] if begin else np.full(CONTEXT, 32, np.uint32)
            piece = np.concatenate([context, codes[begin:begin + CHUNK]])
            rows.append(number)
            starts.append(size)
            parts.append(piece)
            size += len(piece)
            if size >= CHUNK:
                yield rows, starts, np.concatenate(parts)
                rows, starts, parts, size = [], [], [], 0
    if rows:
        yield rows, starts, np.concatenate(parts)


def _buckets(codes: np.ndarray, order: int) -> np.ndarray:
    """Bucket of the n-gram that ends at each position; the first ones reach back as far as there is text."""
    total = np.full(len(codes), order * 0x27D4EB2F & 0xFFFFFFFF, dtype=np.uint32)
    for back in range(order):
        total[back:] += codes[:len(codes) - back] * np.uint32(_FACTORS[back])
    total ^= total >> 15
    total *= np.uint32(0x2C1B3C6D)
    return total >> np.uint32(32 - BITS)


def count(docs: DataFrame) -> DataFrame:
    """(lang, bucket, n) over every labelled row that is not held out."""
    kept = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~in_held_out()).select("lang", "text")

    def run(batches):
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(0).to_pylist()
            by_lang: dict[str, list[str]] = {}
            for lang, text in zip(langs, batch.column(1).to_pylist()):
                by_lang.setdefault(lang, []).append(text)
            for lang, texts in by_lang.items():
                total = totals.setdefault(lang, np.zeros(1 << BITS, dtype=np.int64))
                for _, starts, codes in _chunks(texts):
                    context = np.add.outer(starts, range(CONTEXT)).ravel()
                    for order in ORDERS:
                        total += np.bincount(np.delete(_buckets(codes, order), context), minlength=1 << BITS)
        for lang, total in totals.items():
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(used), pa.string()), pa.array(used.astype(np.int32)), pa.array(total[used])],
                ["lang", "bucket", "n"])

    return arrow_pass(kept, run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def train(docs: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, log priors, log probabilities); bounded by ``MOST_LANGUAGES`` x 2**16 numbers."""
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~in_held_out())
    sizes = {r[0]: r[1] for r in usable.groupBy("lang").count().orderBy("lang").limit(MOST_LANGUAGES + 1).collect()}
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    langs = sorted(sizes)
    counts = np.zeros((len(langs), 1 << BITS))
    place = {lang: i for i, lang in enumerate(langs)}
    for lang, bucket, n in count(docs).toLocalIterator():
        counts[place[lang], bucket] = n
    smooth = counts + SMOOTHING
    logs = np.log(smooth / smooth.sum(axis=1, keepdims=True)).astype(np.float32) if langs else smooth
    priors = np.log(np.array([sizes[x] for x in langs], float) / max(1, sum(sizes.values())))
    return langs, priors, logs


def score_batch(texts: list[str | None], priors: np.ndarray, logs: np.ndarray) -> np.ndarray:
    """Log posterior (texts, languages), not normalised; texts must not be empty."""
    scores = np.tile(priors, (len(texts), 1))
    for rows, starts, codes in _chunks(texts):
        ends = [*starts[1:], len(codes)]
        bounds = np.column_stack([np.add(starts, CONTEXT), ends]).ravel()[:-1]  # first and end of each piece
        for order in ORDERS:
            buckets = _buckets(codes, order)
            for i, row in enumerate(logs):
                np.add.at(scores[:, i], rows, np.add.reduceat(row[buckets], bounds, dtype=np.float64)[::2])
    return scores


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray]) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score (posterior probability).

    Texts without a letter, null and empty ones are ``und`` with score 0; so is
    everything if no language was learned. Repeated rows get equal results;
    further columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        langs, priors, logs = shared.value
        for batch in batches:
            texts = batch.column(2).to_pylist()
            names, found = ["und"] * len(texts), [0.0] * len(texts)
            usable = [i for i, t in enumerate(texts) if langs and has_letter(t)]
            if usable:
                scores = score_batch([texts[i] for i in usable], priors, logs)
                best = scores.argmax(axis=1)
                sure = 1 / np.exp(scores - scores.max(axis=1, keepdims=True)).sum(axis=1)
                for i, b, s in zip(usable, best, sure):
                    names[i], found[i] = langs[b], float(s)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()),
                                              pa.array(found, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return arrow_pass(docs.select("doc_id", in_held_out().alias("held_out"), "text"), run,
                      f"doc_id {kind}, held_out boolean, lang_pred string, score double")
