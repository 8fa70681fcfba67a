"""Whole results against plain forms: a dictionary scorer, differencing by hand, windows one by one."""

import collections
import heapq
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from scenelake.llm import language, queries, sharding, toxicity


def is_held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2


def ngrams(text):
    """Hash buckets of all 1- to 3-grams, text padded with two spaces in front."""
    codes = [32, 32] + [c if c >= 128 else c if chr(c).isalpha() else 32 for c in map(ord, text.lower())]
    factors = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)
    for end in range(2, len(codes)):
        for order in (1, 2, 3):
            h = order * 0x27D4EB2F & 0xFFFFFFFF
            for back in range(order):
                h = (h + codes[end - back] * factors[back]) & 0xFFFFFFFF
            h ^= h >> 15
            yield (h * 0x2C1B3C6D & 0xFFFFFFFF) >> 16


def test_language_equals_a_plain_scorer(spark, small):
    docs = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "lang").collect()]
    counts, n_docs = collections.defaultdict(collections.Counter), collections.Counter()
    for doc_id, text, lang in docs:
        if lang is not None and text is not None and not is_held(doc_id):
            counts[lang].update(ngrams(text))
            n_docs[lang] += 1
    totals = {lang: sum(c.values()) + 0.5 * 65536 for lang, c in counts.items()}
    found = {r["doc_id"]: r for r in queries.op3_language(spark, small).collect()}
    assert len(found) == len(docs)
    for doc_id, text, _ in docs:
        r = found[doc_id]
        assert r["held_out"] == is_held(doc_id)
        if not text or not any(map(str.isalpha, text)):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        grams = collections.Counter(ngrams(text))
        logs = {lang: math.log(n_docs[lang] / sum(n_docs.values()))
                + sum(n * math.log((counts[lang][g] + 0.5) / totals[lang]) for g, n in grams.items()) for lang in counts}
        best = max(logs.values())
        share = 1 / sum(math.exp(v - best) for v in logs.values())
        assert r["score"] == pytest.approx(share, abs=1e-3) and logs[r["lang_pred"]] == pytest.approx(best, abs=1e-2)


def differenced(sizes, k):
    """Karmarkar-Karp with sets of items in hand."""
    heap = [(-s, i, [(s, [i])] + [(0, [])] * (k - 1)) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    count = len(sizes)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        parts = sorted(((x[0] + y[0], x[1] + y[1]) for x, y in zip(a, reversed(b))), key=lambda p: -p[0])
        heapq.heappush(heap, (-(parts[0][0] - parts[-1][0]), count, parts))
        count += 1
    return sorted(p[0] for p in heap[0][2])


@pytest.mark.parametrize("k", [2, 5, 24])
def test_one_bucket_is_differenced(spark, k):
    rng = np.random.default_rng(k)
    texts = ["x" * int(n) for n in rng.integers(0, 4000, 150)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = sharding.shard(docs, k).collect()
    groups = collections.Counter()
    for t in texts:
        groups[t] += len(t) + 8
    sums = collections.Counter()
    for r in found:
        sums[r["shard"]] += r["size"]
    # Ties between equal spreads may be taken in another order, so the spread is compared.
    plain = differenced(sorted(groups.values(), reverse=True), k)
    got = sorted(sums.get(s, 0) for s in range(k))
    assert sum(got) == sum(plain) and got[-1] - got[0] <= max(3 * (plain[-1] - plain[0]), 0.02 * sum(plain) / k + 8)
    slots = collections.defaultdict(list)
    shard_of = {}
    for r in found:
        slots[r["shard"]].append(r["slot"])
        assert shard_of.setdefault(texts[r["doc_id"]], r["shard"]) == r["shard"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_toxicity_equals_windows_one_by_one(spark, small):
    folder = small.replace("sf0.001", "sf0.1")  # enough labels to train on
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    assert model.toxic
    docs = docs.where(F.length("text") < 2000).orderBy("doc_id").limit(60)
    found = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    pair = toxicity.compressor(model.toxic), toxicity.compressor(model.ordinary)
    for doc_id, text in [tuple(r) for r in docs.select("doc_id", "text").collect()]:
        cut = list(toxicity.windows(text.encode()))
        steps = list(toxicity.STEPS)
        gaps = [sum(len(pair[1].compress(w + w)) - len(pair[0].compress(w + w)) >= s for w in cut) for s in steps]
        if not cut:
            assert found[doc_id]["score"] == 0.0
            continue
        x = np.r_[np.log1p(gaps), math.log1p(len(cut))]
        z = (x - model.mean) / model.scale
        want = 1 / (1 + math.exp(-max(-40.0, min(40.0, float(z @ model.weights[:-1] + model.weights[-1])))))
        assert found[doc_id]["score"] == pytest.approx(want, abs=1e-9)
