"""Ranked search against a scorer of all documents, and odd rows."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from scenelake.llm import lexical, queries

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_force(docs, items, top=20):
    held = [(doc_id, Counter(terms(text))) for doc_id, text in docs]
    lengths = [sum(c.values()) for _, c in held]
    n_docs, n_terms = sum(n > 0 for n in lengths), sum(lengths)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item_id, text in items:
        found = []
        for (doc_id, counts), n in zip(held, lengths):
            m = 75 + (25 * n * n_docs) // n_terms if n_terms else 0
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                        * (1_000_000_000 * counts[t] // (1000 * counts[t] + 12 * m)) for t in terms(text) if counts[t])
            if score > 0:
                found.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item_id, i + 1, f[3], -f[0]) for i, f in enumerate(sorted(found, key=lambda f: f[:3])[:top])]
    return sorted(out, key=repr)


def rows(df):
    assert df.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in df.collect()), key=repr)


def made(seed, n, words):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choices(words, weights=[1 / (k + 1) for k in range(len(words))], k=rng.randint(0, 60))))
            for i in range(n)]


@pytest.mark.parametrize("short", [0.0, 0.5, 10.0])
@pytest.mark.parametrize("window", [16, 1024])
def test_equals_brute_force(spark, monkeypatch, short, window):
    monkeypatch.setattr(lexical, "SHORT", short)
    monkeypatch.setattr(lexical, "WINDOW", window)
    words = [f"w{i}" for i in range(60)] + ["Ñandú", "É", "x9"]
    docs, items = made(1, 700, words), made(2, 25, words) + [(90, "w1 w1 W1 w2"), (91, "absent words only")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    monkeypatch.setattr(lexical, "BLOCK_BYTES", 400)  # several blocks
    found = lexical.search(frame, spark.createDataFrame(items, "item_id long, text string"), 7)
    assert rows(found) == brute_force(docs, items, 7)


def test_query_of_tables(spark, small):
    read = lambda t, k: [tuple(r) for r in spark.read.parquet(f"{small}/{t}.parquet").select(k, "text").collect()]
    assert rows(queries.op11_search(spark, small)) == brute_force(read("documents", "doc_id"), read("benchmark", "item_id"))


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(lexical, "PIECE", 64)
    long = " ".join(f"term{i % 50}" for i in range(20_000)) + " " + "y" * 5000
    docs = [(3, "same text"), (1, "same text"), (None, "same text"), (2, "same text"), (2, "same text"), (4, None), (5, ""),
            (6, "!!! ..."), (7, long), (8, "Same, TEXT; same")]
    items = [(1, "same text"), (1, "same text"), (2, None), (3, ""), (4, "?"), (None, "y" * 5000), (5, "term7 term7 text")]
    frame = spark.createDataFrame([(*d, "a", 5, 1.0) for d in docs], "doc_id long, text string, item_id string, rank int, score double")
    asked = spark.createDataFrame([(*i, 7) for i in items], "item_id long, text string, doc_id int")
    assert rows(lexical.search(frame, asked)) == brute_force(docs, items)
    none = frame.limit(0)
    assert rows(lexical.search(none, asked)) == [] and rows(lexical.search(frame, asked.limit(0))) == []


def test_probes_skip_postings(monkeypatch):
    """A rare strong term fills the list; the common weak one is then only probed."""
    n = 20_000
    norms = np.full(n, 100)
    common = lexical.Postings(np.arange(n), np.ones(n, dtype=np.int64), norms, 3)
    rare = lexical.Postings(np.arange(0, 2_000, 40), np.ones(50, dtype=np.int64), norms, 9000)
    windows = []
    monkeypatch.setattr(common, "window", lambda low, high: windows.append(low) or type(common).window(common, low, high))
    monkeypatch.setattr(lexical, "SHORT", 0.01)
    best = lexical.Best(20)
    lexical.search_segment([common, rare], np.arange(n), best)
    assert best.ids.tolist() == list(range(0, 800, 40)) and len(windows) <= 1


def test_norms_beyond_64_bits():
    lengths = np.array([3, 10 ** 9])
    assert lexical.normalisers(lengths, 10 ** 10, 10 ** 13).tolist() == [75, 75 + 25 * 10 ** 9 * 10 ** 10 // 10 ** 13]
