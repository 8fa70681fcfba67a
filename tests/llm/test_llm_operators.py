"""Operators of scenelake.llm against brute force, and their defined results on odd rows."""

import collections
import hashlib
import math
import random
import re
import string
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from scenelake.llm import (decontaminate, graph, language, mixing, quality, queries, secrets, sharding, simhash, suffixes,
                           toxicity, urls)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, score string, kept int"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def ascii_lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def docs_of(spark, rows):
    """Rows of (doc_id, text[, lang, source]) with columns whose names clash with results."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s0", 0, "x", "y", 7) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def sentence(rng, n):
    return " ".join("".join(rng.choices(string.ascii_lowercase, k=rng.randint(2, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def odd_rows():
    rng = random.Random(7)
    long_text = sentence(rng, 60_000)
    return [(1, None, None, None), (2, "", "en", None), (3, " \n\t ", None, "s1"), (None, "no id here", "en", "s1"),
            (4, "same text twice", "de", "s0"), (5, "same text twice", "de", "s0"), (5, "same text twice", "de", "s0"),
            (6, long_text, "en", "s2"), (7, "äöü ß 漢字", "de", "s2"), (8, "7 8 9 !!", "xx", "s3")]


@pytest.fixture(scope="module")
def odd(spark, odd_rows):
    return docs_of(spark, odd_rows)


@pytest.fixture(scope="module")
def none(spark):
    return docs_of(spark, [])


@pytest.fixture(scope="module")
def documents(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


@pytest.fixture(scope="module")
def texts(documents):
    return {r[0]: r[1] for r in documents.select("doc_id", "text").collect()}


# --- 1: decontamination ---


def brute_hits(text, items):
    words = WORD.findall(ascii_lower(text or ""))
    hit, found = set(), set()
    for name, item in items:
        w = WORD.findall(ascii_lower(item or ""))
        m = min(13, len(w))
        windows = {tuple(w[i:i + m]) for i in range(len(w) - m + 1)} if m else set()
        for i in range(len(words) - m + 1):
            if m and tuple(words[i:i + m]) in windows:
                hit.update(range(i, i + m))
                found.add(name)
    return len(words), len(hit), found


def as_rows(frame):
    return {(r["n_words"], sum(e - s for s, e in r["spans"]), tuple(r["items"])) for r in frame.collect()}


def test_wu_manber_equals_brute_force_on_dense_repetition():
    rng = random.Random(3)
    for _ in range(60):
        vocabulary = [w.encode() for w in "a b c d".split()[:rng.randint(1, 4)]]
        items = [(str(i), b" ".join(rng.choices(vocabulary, k=rng.choice([0, 1, 2, 5, 13, 14, 20])))) for i in range(6)]
        text = b" ".join(rng.choices(vocabulary, k=rng.randint(0, 80)))
        total, spans, found = decontaminate.Searcher(items).find(text)
        want = brute_hits(text.decode(), [(n, t.decode()) for n, t in items])
        assert (total, sum(e - s for s, e in spans), found) == want


def test_pieces_do_not_lose_windows(monkeypatch):
    rng = random.Random(5)
    words = sentence(rng, 400).split()
    item = " ".join(words[100:140])
    monkeypatch.setattr(decontaminate, "PIECE", 50)
    total, spans, found = decontaminate.Searcher([("9", item.encode())]).find(" ".join(words).encode())
    assert (total, spans, found) == (400, [[100, 140]], {"9"})


def test_blocks_of_items_add_up(spark, monkeypatch):
    rng = random.Random(11)
    items = [(i, sentence(rng, 15)) for i in range(6)] + [(6, None), (None, sentence(rng, 14)), (0, "tiny item")]
    body = " ".join([items[0][1], sentence(rng, 5), items[4][1], items[7][1]])
    docs = docs_of(spark, [(1, body), (2, "nothing at all"), (3, None), (1, body)])
    benchmark = spark.createDataFrame([(*i, "extra") for i in items], "item_id long, text string, spans string")
    whole = decontaminate.search(docs, benchmark).collect()
    monkeypatch.setattr(decontaminate, "ITEM_BYTES", 100)
    parts = decontaminate.search(docs, benchmark).collect()
    assert sorted(map(str, whole)) == sorted(map(str, parts))
    assert [r["items"] for r in whole if r["doc_id"] == 1] == [["0", "4"]] * 2
    assert [r.doc_id for r in decontaminate.drop_contaminated(docs, benchmark).collect()] == [2, 3]


def test_contamination_of_odd_rows(spark, odd, none, small):
    benchmark = spark.read.parquet(f"{small}/benchmark.parquet")
    rows = decontaminate.search(odd, benchmark).collect()
    assert len(rows) == 10 and {r["n_words"] for r in rows if r["doc_id"] in (1, 2, 3)} == {0}
    assert decontaminate.search(none, benchmark).count() == 0
    assert decontaminate.search(odd, benchmark.limit(0)).where(F.size("items") > 0).count() == 0
    assert decontaminate.drop_contaminated(odd, benchmark.limit(0)).columns == odd.columns


# --- 2: SimHash ---


def brute_fingerprint(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", ascii_lower(text or "")) if w]
    if not words:
        return 0
    shingles = [words[i:i + 4] for i in range(len(words) - 3)] if len(words) > 3 else [words]
    hashes = [xxhash.xxh64_intdigest(" ".join(s), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(points):
    """Smallest member reachable for each point."""
    label = {p: p for p in points}
    changed = True
    while changed:
        changed = False
        for a in points:
            for b in points:
                if (a ^ b).bit_count() <= 4 and label[a] > label[b]:
                    label[a], changed = label[b], True
    return label


def test_fingerprints_and_pieces(texts, monkeypatch):
    sample = [*list(texts.values())[:60], "", "one", "one two three", "A b\x0bC\x0cd E", "x\u00a0y z"]
    for text in sample:
        assert simhash.fingerprint(text.encode()) == brute_fingerprint(text)
    monkeypatch.setattr(simhash, "PIECE", 40)
    for text in sample:
        assert simhash.fingerprint(text.encode()) == brute_fingerprint(text)


@pytest.mark.parametrize("group", [4096, 5])
def test_links_keep_every_connection(spark, monkeypatch, group):
    """Chains and dense balls; with small groups, so that hot buckets are cut into blocks."""
    monkeypatch.setattr(simhash, "GROUP", group)
    rng = random.Random(1)
    points = set()
    for _ in range(4):
        at = rng.getrandbits(64)
        for _ in range(25):
            points.add(at)
            for bit in rng.sample(range(64), rng.randint(1, 5)):
                at ^= 1 << bit
    centre = rng.getrandbits(64)
    points |= {centre ^ (1 << i) for i in range(0, 40)} | {rng.getrandbits(64) for _ in range(20)}
    signed = [p - (1 << 64) if p >> 63 else p for p in points]
    fps = spark.createDataFrame([(p,) for p in signed], "fp long")
    found = {r["node"] & (1 << 64) - 1: r["root"] & (1 << 64) - 1 for r in graph.components(simhash.links(fps)).collect()}
    groups, wanted = collections.defaultdict(set), collections.defaultdict(set)
    for p, root in brute_components(points).items():
        wanted[root].add(p)
        groups[found.get(p, p)].add(p)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values()))


def test_components_of_a_long_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(100)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5, 5)]
    found = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(found[i] == 0 for i in range(101)) and all(found[1000 + i] == 1000 for i in range(200))


def test_a_hub_and_a_large_class_can_be_split(spark):
    """Joins of aggregated figures have an exchange on both sides; with low limits adaptive execution splits the hub."""
    from scenelake.llm.common import split_join

    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k",
            "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        edges = spark.range(60_000).repartition(8).select(
            F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id")).alias("a"), F.xxhash64("id").alias("b"))
        joined = split_join(edges, edges.groupBy("a").agg(F.min("b").alias("least")), "a")
        counted = joined.agg(F.count("*"), F.max("least"))
        assert counted.collect()[0][0] == 60_000
        assert "skew=true" in counted._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_near_duplicates_equal_brute_force(documents, texts):
    fps = {i: brute_fingerprint(t) for i, t in texts.items()}
    label = brute_components(set(fps.values()))
    least = {}
    for i, fp in fps.items():
        least[label[fp]] = min(i, least.get(label[fp], i))
    rows = simhash.near_duplicates(documents).collect()
    assert len(rows) == len(texts)
    assert all(r["component_id"] == least[label[fps[r["doc_id"]]]] for r in rows)


def test_near_duplicates_of_odd_rows(odd, none):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == 10
    assert {r["component_id"] for r in rows if r["doc_id"] in (1, 2, 3)} == {1}
    assert [r["component_id"] for r in rows if r["doc_id"] == 5] == [4, 4]
    kept = [r["doc_id"] for r in simhash.keep_one(odd).collect()]
    assert sorted(kept, key=str) == sorted([1, None, 4, 6, 7, 8], key=str)
    assert simhash.keep_one(odd).columns == odd.columns
    assert simhash.near_duplicates(none).count() == 0 and simhash.keep_one(none).count() == 0


def test_keep_one_with_clashing_column_names(spark):
    rows = [(1, "one two three four five six", "x", 5, "p"), (2, "one two three four five six", "y", 6, "q"), (3, "another text of its own here", "z", 7, "r")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _row string, digest int, `a.b` string")
    out = simhash.keep_one(docs)
    assert out.columns == docs.columns and out.schema == docs.schema
    assert sorted(tuple(r) for r in out.collect()) == [rows[0], rows[2]]


def test_keep_one_leaves_one_row_of_each_class(spark):
    rng = random.Random(11)
    a, b, c, d = (sentence(rng, 80) for _ in range(4))
    rows = [(1, a), (1, b), (2, b), (None, c), (None, c), (None, d), (7, d), (1, a), (3, "x y z"), (None, a)]
    for seed in range(2):
        docs = docs_of(spark, random.Random(seed).sample(rows, len(rows))).repartition(3 + seed)
        kept = simhash.keep_one(docs)
        assert kept.columns == docs.columns
        assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted(
            [(1, a), (1, b), (None, c), (7, d), (3, "x y z")], key=str)


# --- 3: language ---


def test_language_of_held_out_documents(documents):
    rows = language.identify(documents, language.train(documents)).join(documents.select("doc_id", "lang"), "doc_id")
    held = rows.where("held_out").collect()
    assert len(held) > 20 and sum(r["lang"] == r["lang_pred"] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in held)


def test_long_texts_lose_no_ngram(monkeypatch):
    text = sentence(random.Random(2), 300)
    wanted = collections.Counter()
    for order in language.ORDERS:
        padded = np.concatenate([np.full(2, 32, np.uint32), language._codes(text)])
        wanted.update((order, int(b)) for b in language._buckets(padded, order)[2:])
    monkeypatch.setattr(language, "CHUNK", 64)
    found = collections.Counter()
    for _, starts, codes in language._chunks(["", text]):
        context = np.add.outer(starts, range(language.CONTEXT)).ravel()
        for order in language.ORDERS:
            found.update((order, int(b)) for b in np.delete(language._buckets(codes, order), context))
    assert found == wanted


def test_language_of_odd_rows(odd, none):
    model = language.train(odd)
    rows = {(r["doc_id"], r["lang_pred"], r["held_out"]) for r in language.identify(odd, model).collect()}
    assert {r[1] for r in rows if r[0] in (1, 2, 3, 8)} == {"und"}
    assert all(r[2] == (r[0] is not None and zlib.crc32(str(r[0]).encode()) % 4 == 2) for r in rows)
    assert {r["lang_pred"] for r in language.identify(odd, language.train(none)).collect()} == {"und"}
    assert language.identify(none, model).count() == 0


# --- 4: sharding ---


def test_differencing_keeps_items_and_beats_dealing():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 100_000, 500)
    sums = np.zeros((500, 24), dtype=np.int64)
    sums[:, 0] = sizes
    parts = sharding.differencing(sums)[:, 0]
    loads = np.bincount(parts, weights=sizes, minlength=24)
    assert loads.sum() == sizes.sum() and loads.max() - loads.min() < sizes.max() / 100
    assert all(sorted(r) == list(range(24)) for r in sharding.differencing(rng.integers(0, 99, (7, 24))))
    assert sharding.differencing(np.zeros((0, 24), dtype=np.int64)).shape == (0, 24)


@pytest.mark.parametrize("bucket", [4000, 2])
def test_shards_of_odd_rows(odd, none, monkeypatch, bucket):
    monkeypatch.setattr(sharding, "BUCKET_GROUPS", bucket)
    monkeypatch.setattr(sharding, "FAN_IN", 2)
    rows = sharding.shard(odd).collect()
    assert len(rows) == 10 and all(r["size"] >= 8 and 0 <= r["shard"] < 24 for r in rows)
    by_digest, by_shard = collections.defaultdict(set), collections.defaultdict(list)
    for r in rows:
        by_digest[bytes(r["digest"])].add(r["shard"])
        by_shard[r["shard"]].append(r["slot"])
    assert all(len(s) == 1 for s in by_digest.values())
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    assert sharding.shard(none).count() == 0


def test_shards_are_even(documents, texts):
    rows = queries.shard_rows(documents).collect()
    loads = collections.Counter()
    for r in rows:
        text = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(text) + 8, zlib.crc32(text), "bytes")
        loads[r["shard"]] += r["size"]
    largest = max(collections.Counter({t: 0 for t in texts.values()} | {}).keys(), key=len)
    assert max(loads.values()) - min(loads.values()) <= len(largest.encode()) + 8


# --- 5: mixing ---


def brute_targets(sizes):
    names = sorted([s for s in sizes if s is not None]) + [s for s in sizes if s is None]
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    capped, total = set(), sum(sizes.values())
    while True:
        rest = total - sum(3 * sizes[s] for s in capped)
        free = sum(weight[s] for s in names if s not in capped)
        target = {s: 3 * sizes[s] if s in capped else rest * weight[s] / free for s in names}
        over = {s for s in names if s not in capped and target[s] > 3 * sizes[s]}
        if not over:
            return target
        capped |= over


def check_mix(rows):
    sizes, taken, target = collections.Counter(), collections.Counter(), {}
    for r in rows:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert 0 <= r["taken"] <= 3 * r["size"]
    wanted = brute_targets(sizes)
    for s in sizes:
        assert target[s] == pytest.approx(wanted[s])
        assert all(r["source_size"] == sizes[s] for r in rows if r["source"] == s)
    return taken, target


def test_mix_of_documents(documents):
    rows = mixing.mix(documents).collect()
    taken, target = check_mix(rows)
    assert all(abs(taken[s] - target[s]) <= 0.15 * target[s] for s in target)
    again = mixing.mix(documents.repartition(5)).collect()
    assert {(r["doc_id"], r["copies"]) for r in rows} == {(r["doc_id"], r["copies"]) for r in again}


def test_mix_with_caps_and_a_null_source(spark):
    rng = random.Random(4)
    rows = [(i, sentence(rng, rng.randint(1, 60)), "en", rng.choice(["big"] * 30 + ["Tiny", None, "ä"])) for i in range(3000)]
    found = mixing.mix(docs_of(spark, rows)).collect()
    taken, target = check_mix(found)
    assert any(target[r["source"]] == 3 * r["source_size"] for r in found)
    assert all(abs(taken[s] - target[s]) <= 0.02 * target[s] for s in target)


def test_mix_of_odd_rows(spark, odd, none):
    rows = mixing.mix(odd).collect()
    check_mix(rows)
    assert len(rows) == 10 and len({r["copies"] for r in rows if r["doc_id"] == 5}) == 1
    mixed = mixing.mixed(odd)
    assert mixed.columns == odd.columns
    assert mixed.count() == sum(r["copies"] for r in rows)
    assert mixing.mix(none).count() == 0 and mixing.mixed(none).count() == 0
    assert mixing.mix(docs_of(spark, [(1, None), (2, "")])).agg(F.sum("target")).first()[0] == 0


def test_mix_is_native(documents):
    plan = mixing.mix(documents)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# --- 6: repeats ---


def brute_removal(texts, length):
    starts = collections.Counter()
    data = [(t or "").encode() for t in texts]
    for b in data:
        starts.update(b[p:p + length] for p in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = bytearray(len(b) + 2)
        for p in range(len(b) - length + 1):
            if starts[b[p:p + length]] > 1:
                gone[p + 1:p + 1 + length] = b"\1" * length
        spans = sum(gone[i] and not gone[i - 1] for i in range(1, len(b) + 1))
        kept = bytes(c for c, g in zip(b, gone[1:]) if not g)
        out.append((len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def removal_rows(frame):
    return [(r["n_bytes"], r["n_removed"], len(r["spans"]), r["kept_sha256"]) for r in frame.orderBy("doc_id").collect()]


@pytest.mark.parametrize("length, anchor", [(400, 64), (60, 16)])
def test_repeats_equal_brute_force(spark, monkeypatch, length, anchor):
    """Passages at many places, copies, self-repetition, periodic text, edits, and matches of just too few bytes."""
    monkeypatch.setattr(suffixes, "SEGMENT", 700)
    rng = random.Random(length)
    passages = [sentence(rng, 150)[:rng.choice([length - 1, length, length + 1, 2 * length, 900])] for _ in range(6)]
    texts = [None, "", "ä" * length, "ab" * length, "a" * (3 * length), sentence(rng, 2000)]
    for _ in range(60):
        parts = [rng.choice(passages) if rng.random() < 0.5 else sentence(rng, rng.randint(1, 60)) for _ in range(rng.randint(1, 6))]
        texts.append(rng.choice(["", " ", "é"]).join(parts))
    edited = list(texts[5])
    for i in range(0, len(edited), 977):
        edited[i] = "#"
    texts += ["".join(edited), texts[10], texts[11], texts[11], passages[3], passages[3] * 3]
    docs = docs_of(spark, list(enumerate(texts)))
    found = removal_rows(suffixes.remove_repeats(docs, length, anchor))
    assert found == brute_removal(texts, length)


def test_repeats_of_documents(documents, texts):
    found = removal_rows(suffixes.remove_repeats(documents))
    assert found == brute_removal([texts[i] for i in sorted(texts)], 400)


def repeated_passages(texts, n):
    words = [(t or "").encode().split() for t in texts]
    starts = collections.Counter(tuple(w[i:i + n]) for w in words for i in range(len(w) - n + 1))
    return [any(starts[tuple(w[i:i + n])] > 1 for i in range(len(w) - n + 1)) for w in words]


def test_passages_of_words_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "SEGMENT", 90)
    rng = random.Random(8)
    passages = [sentence(rng, rng.choice([19, 20, 21, 30])) for _ in range(8)]
    texts = [None, "", "a " * 60, sentence(rng, 500)]
    for _ in range(80):
        parts = [rng.choice(passages) if rng.random() < 0.25 else sentence(rng, rng.randint(1, 60)) for _ in range(rng.randint(1, 5))]
        texts.append(rng.choice([" ", "\n", " \t "]).join(parts))
    texts += [texts[3].replace(" ", "\n"), sentence(rng, 15) + " x" * 1, sentence(rng, 3) + " q" * 30]
    docs = docs_of(spark, list(enumerate(texts))).repartition(3)
    found = [r["has_passage"] for r in suffixes.remove_repeats(docs, passage=20).orderBy("doc_id").collect()]
    assert found == repeated_passages(texts, 20) and 10 < sum(found) < len(found) - 10


def test_planted_passages_are_found(documents, texts):
    rows = suffixes.remove_repeats(documents).orderBy("doc_id").collect()
    assert [r["has_passage"] for r in rows] == repeated_passages([texts[i] for i in sorted(texts)], 51)


def test_repeats_of_odd_rows(odd, none):
    assert suffixes.remove_repeats(odd).where("n_removed = 0").count() == 10
    assert suffixes.remove_repeats(odd).where("has_passage").count() == 0
    assert suffixes.remove_repeats(none).count() == 0


# --- 7: URLs ---


def test_url_parts_and_rules(spark):
    rows = {
        "https://A.Example.NET/en/1?x#y": ("a.example.net", "/en/1", "example.net/en/", "allow"),
        "http://example.net/de/": ("example.net", "/de/", "net/", "block"), "http://x.net": ("x.net", "", None, "allow"),
        "http://example.com/de/a": ("example.com", "/de/a", "example.com/de/", "block"),
        "http://notexample.com/de/a": ("notexample.com", "/de/a", None, "allow"),
        "http://net/?q=/": ("net", "/", "net/", "block"), "no scheme": ("", "", None, "allow"), None: ("", "", None, "allow"),
        "": ("", "", None, "allow"), "a://b://c/d": ("b:", "//c/d", None, "allow"), "x://Ä.org/fr/\n1": ("Ä.org", "/fr/\n1", "org/fr/", "allow")}
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(rows)] * 2, "page_id long, url string, host string")
    rules = spark.createDataFrame([*urls.RULES, (None, "/", "block"), ("net", None, "block")], "host string, path string, verdict string")
    found = urls.filter_urls(pages, rules).orderBy("page_id").collect()
    assert [tuple(r)[1:] for r in found[::2]] == list(rows.values()) == [tuple(r)[1:] for r in found[1::2]]
    assert urls.filter_urls(pages.limit(0), rules).count() == 0
    assert {r["verdict"] for r in urls.filter_urls(pages, rules.limit(0)).collect()} == {"allow"}


def test_url_lists_in_several_files(spark, monkeypatch):
    monkeypatch.setattr(urls, "LIST_ROWS", 3)
    rules = spark.createDataFrame([(f"h{i}.org", "/" + "p" * i, "block") for i in range(8)] + [("org", "/", "allow")],
                                  "host string, path string, verdict string")
    pages = spark.createDataFrame([(i, f"http://www.h{i % 10}.org/pppppppp") for i in range(30)], "page_id long, url string")
    found = urls.filter_urls(pages, rules).collect()
    assert all(r["rule"] == (f"h{r['page_id'] % 10}.org/" + "p" * (r["page_id"] % 10) if r["page_id"] % 10 < 8 else "org/") for r in found)


def test_very_long_hosts_and_paths(spark):
    """A URL of a megabyte has as few keys as any other."""
    rules = spark.createDataFrame([("example.net", "/a", "block"), ("b.a.net", "/", "block")], "host string, path string, verdict string")
    long = ["http://" + "x." * 500_000 + "example.net/abc", "http://" + "y" * 1_000_000 + "/a", "http://example.net/a" + "z" * 1_000_000,
            "http://" + "." * 300_000 + "b.a.net/", "http://" + "a." * 300_000]
    pages = spark.createDataFrame(list(enumerate(long)), "page_id int, url string")
    found = {r["page_id"]: (r["rule"], r["verdict"]) for r in urls.filter_urls(pages, rules).collect()}
    assert found == {0: ("example.net/a", "block"), 1: (None, "allow"), 2: ("example.net/a", "block"), 3: ("b.a.net/", "block"), 4: (None, "allow")}


def test_digest_collisions_are_told_apart(tmp_path, monkeypatch):
    monkeypatch.setattr(urls.xxhash, "xxh64_intdigest", lambda key: 5)
    urls.write_index([("a.b", "/", "block"), ("c.d", "/x", "allow")], str(tmp_path / "index"))
    index = urls.Index(str(tmp_path / "index"))
    assert index.find(index.keys("w.c.d", "/xy")) == [(3, "c.d/x", "allow")] or index.find(["c.d\x01/x"]) == [(0, "c.d/x", "allow")]
    assert index.find(["q.r\x01/"]) == []


# --- 8: secrets ---

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def brute_base(text):
    found = [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    order = ["assign", "access", "hex"]
    return sorted(found, key=lambda s: (s[0], order.index(s[1])))


def test_base_spans(texts):
    key = "AKIA" + "B7" * 8
    odd = [f"{key} AKIA12 x{key}AKIA", "secret=token: abcdefgh", "PassWord \"= 'abc123'", "apikey:x api_key = abcdef", "ſecret=abcdef",
           "äö token = 12345 token=123456", "f" * 23 + " " + "0" * 24 + "g" + "a" * 25, "to\u212aen=abcdefg", ""]
    for text in [*odd, *texts.values()]:
        assert secrets.all_spans(text, [])[0] == brute_base(text)


def test_inferred_formats_find_what_patterns_miss():
    rng = random.Random(9)
    keys = ["".join(rng.choices("0123456789abcdef", k=40)) for _ in range(400)]
    automata = secrets.fit({"hex": keys[:350]})
    assert len(automata) == 1 and sum(automata[0].accepts(k) for k in keys[350:]) >= 45
    assert not automata[0].accepts("thequickbrownfoxjumpsoverthelazydogsagai")
    assert not automata[0].accepts(keys[0][:30])
    upper = ["".join(rng.choices("0123456789ABCDEF", k=40)) for _ in range(200)]
    both = secrets.fit({"assign": upper})
    text = f"see {upper[0][::-1]}. and {keys[0]}"
    base, spans = secrets.all_spans(text, both)
    assert base == [(50, "hex", 90)] and spans == [(4, "learned", 44), (50, "hex", 90)]
    assert secrets.fit({}) == []


def test_credentials_of_every_length_and_behind_separators(spark):
    rng = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    key = lambda n: "".join(rng.choices(letters, k=n))
    one = secrets.fit({"assign": [key(n) for n in [*range(6, 60), *range(150, 400, 5)] * 6]})[0]
    for n in (8, 13, 19, 33, 77, 250, 402, 1000):
        assert sum(one.accepts(key(n)) for _ in range(50)) >= 30, n
    upper = ["".join(rng.choices("0123456789ABCDEF", k=40)) for _ in range(200)]
    both, new = secrets.fit({"assign": upper}), upper[0][::-1]
    for text, at in ((f"credential={new}.", 11), (f"https://host/path/{new}", 18), (f"https://host/{new}/path", 13)):
        assert secrets.all_spans(text, both)[1] == [(at, "learned", at + 40)], text
    words = [sentence(rng, 60) for _ in range(300)]
    bare = {i: key(rng.choice((12, 14, 24, 260))) for i in range(40)}
    rows = [(i, f"{w} password={key(rng.choice((12, 13, 14, 24, 250, 260)))} {w} {bare.get(i, '')}") for i, w in enumerate(words)]
    docs = docs_of(spark, rows)
    found = secrets.scan(docs, secrets.train(docs)).collect()
    spans = {r["doc_id"]: [rows[r["doc_id"]][1][s["start"]:s["end"]] for s in r["spans"] if s["kind"] == "learned"] for r in found}
    assert sum(spans[i] == [b] for i, b in bare.items()) >= 32
    assert not any(v for i, v in spans.items() if i not in bare)


@pytest.mark.parametrize("nodes, ahead", [(1 << 12, 16), (60, 3)])
def test_formats_are_learned_from_all_values(spark, monkeypatch, nodes, ahead):
    """Every distinct credential and every other distinct token counts, and the threshold is that of all held-out ones."""
    monkeypatch.setattr(secrets, "NODES", nodes, raising=False)
    monkeypatch.setattr(secrets, "AHEAD", ahead, raising=False)
    rng = random.Random(11)
    key = lambda letters, n: "".join(rng.choices(letters, k=n))
    values = [rng.choice(("sk-live_", "pk-", "")) + key("012abcXYZgh-", rng.choice((9, 30, 300))) for _ in range(2500)]
    access = ["AKIA" + key("ABCXYZ0123456789", 16) for _ in range(900)]
    tokens = [key("abcxyzABC019_", rng.randint(6, 12)) for _ in range(2000)]
    rows = [(i, f"{tokens[i % 2000]} secret={v} {access[i % 900]} {tokens[(7 * i) % 2000]} short") for i, v in enumerate([*values, *values[:300]])]
    found = secrets.train(docs_of(spark, rows).repartition(5))
    assert len(found) == 2
    for kind, own, automaton in zip(("assign", "access"), (set(values), set(access)), found):
        held = {v for v in own if hashlib.sha256(v.encode()).digest()[0] % 5 == 0}
        symbols = sum(map(len, own - held))
        assert sum(n for moves in automaton.moves for _, n in moves.values()) == symbols
        assert all(automaton.format(secrets._line(v).rstrip("$")) > -math.inf for v in own - held)
        scores = sorted(x for x in map(automaton.likelihood, held) if x > -math.inf)
        assert automaton.threshold == scores[int(secrets.LOWEST * len(scores))]
        assert automaton.lengths == collections.Counter(map(len, own))
        assert automaton.fields()[:5] == secrets.fit({kind: sorted(own)})[0].fields()[:5]
        moves = collections.Counter()
        for token in set(tokens):
            line = " " + token.translate(secrets._CLASS_TABLE)
            moves.update(line[i:i + 2] for i in range(len(token)))
        assert automaton.usual == (moves, collections.Counter(map(len, set(tokens))), len(set(tokens)))


def test_secrets_of_odd_rows(odd, none):
    rows = secrets.scan(odd, secrets.train(odd)).collect()
    assert len(rows) == 10 and all(not r["spans"] for r in rows)
    assert secrets.scan(none, []).count() == 0 and secrets.train(none) == []


# --- 9: quality ---


def brute_measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = collections.Counter(zip(words, words[1:], words[2:]))
    marked = set()
    for i in range(len(words) - 2):
        if windows[tuple(words[i:i + 3])] > 1:
            marked |= {i, i + 1, i + 2}
    seen, again = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    failed = len(words) < 50 or 100 * len(marked) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), again, len(marked), failed


def test_quality_measures(spark, documents, odd, odd_rows, none, texts):
    for row in quality.judge(documents).collect():
        assert tuple(row)[1:7] == brute_measures(texts[row["doc_id"]])
    found = quality.judge(odd).collect()
    assert sorted(tuple(r)[1:7] for r in found) == sorted(brute_measures(r[1]) for r in odd_rows)
    assert quality.judge(none).count() == 0
    rng = random.Random(8)
    loops = [(i, " ".join(rng.choices("a b c".split(), k=n))) for i, n in enumerate([0, 1, 2, 3, 4, 5, 9, 60])]
    for row in quality.judge(docs_of(spark, loops)).collect():
        assert tuple(row)[1:7] == brute_measures(loops[row["doc_id"]][1])


def test_quality_keeps_clean_and_rejects_junk(spark, small):
    labels = spark.read.parquet(f"{small}/labels.parquet")
    rows = quality.judge(spark.read.parquet(f"{small}/documents.parquet")).join(labels, "doc_id").where(~F.col("base_failed")).collect()
    assert all(r["kept"] for r in rows if r["quality"] == 1)
    assert sum(r["kept"] for r in rows if r["quality"] == 0) <= 0.1 * sum(r["quality"] == 0 for r in rows)


def test_line_rules():
    line = quality.line_rule
    assert line(b"This is an ordinary sentence.") is None and line(b"  ") is None
    assert line(b"Home | News | About") == "navigation" and line(b"Read more") == "navigation"
    assert line(b"We use cookies on this page to help you.") == "boilerplate"
    assert line(b"BUY!! NOW!! THIS!! IS!! GREAT!!") == "punctuation"


def test_single_marks_do_not_condemn_long_lines(spark):
    prose = "This is an ordinary sentence with some words in it. " * 12
    marks = ["Every newsletter of theirs. ", "They design in wood and blog in verse. ", "Use {x} here. ", "Some » quoted « words | here. "]
    for mark in marks:
        assert quality.line_rule((prose + mark + prose).encode()) is None, mark
    assert quality.line_rule("They design in wood and blog in verse all day.".encode()) is None
    assert quality.line_rule(b"Subscribe to our newsletter.") == "boilerplate" == quality.line_rule(b"if (a) { return b; }")
    rng = random.Random(2)
    text = sentence(rng, 400) + " newsletter and cookie. " + sentence(rng, 400) + "."
    assert quality.judge(docs_of(spark, [(1, text)])).first()["kept"]


# --- 10: toxicity ---


def test_windows_cover_the_text():
    text = "Idiot, SCUM! " + sentence(random.Random(1), 300) + " " + "x" * 100
    joined = b"".join(w.strip() for w in toxicity.windows(text.encode()))
    assert joined.replace(b" ", b"") == b"".join(toxicity.words(text.encode()))
    assert list(toxicity.windows(b"")) == [] == list(toxicity.windows(None)) == list(toxicity.windows(b" .,\n"))


def synthetic(seed, n):
    rng = random.Random(seed)
    vocabulary = sentence(random.Random(0), 3000).split()
    bad = "frobnitz vexillor grumbach snorkeld blightum".split()
    rows = []
    for i in range(n):
        words = rng.choices(vocabulary, k=rng.randint(40, 200))
        toxic = int(rng.random() < 0.2)
        for _ in range(3 * toxic):
            words.insert(rng.randint(0, len(words)), rng.choice(bad))
        rows.append((" ".join(words).encode(), toxic, i % 3))
    return rows


def test_compression_tells_toxic_from_ordinary():
    one = toxicity.fit(synthetic(1, 1500)).scorer()
    unseen = [(one(t) >= toxicity.THRESHOLD, y) for t, y, _ in synthetic(2, 500)]
    assert sum(p for p, y in unseen if y) >= 0.9 * sum(y for _, y in unseen)
    assert sum(p for p, y in unseen if not y) <= 0.05 * len(unseen)
    assert one(b"") == one(None) == 0.0


def test_toxicity_of_odd_rows(spark, odd, none, small):
    labels = spark.createDataFrame([(4, 1, 1), (5, 1, 0), (5, 0, 0), (None, 1, 1), (6, None, None)], "doc_id long, quality int, toxic int")
    for model in (toxicity.train(odd, labels), toxicity.train(none, labels), toxicity.fit(synthetic(1, 300))):
        rows = toxicity.score(odd, model).collect()
        assert len(rows) == 10 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
        assert {r["score"] for r in rows if r["doc_id"] in (1, 2, 3)} == {0.0}
        assert toxicity.drop_toxic(odd, model).columns == odd.columns
        assert toxicity.score(none, model).count() == 0 == toxicity.drop_toxic(none, model).count()


def test_sample_takes_labels_with_documents(spark, monkeypatch):
    """Labels without documents take no place, and of several texts of an id one is taken by a fixed order."""
    monkeypatch.setattr(toxicity, "SAMPLE_TOXIC", 4)
    monkeypatch.setattr(toxicity, "SAMPLE_ORDINARY", 4)
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 4 != 2]
    docs = docs_of(spark, [(i, f"text {i}") for i in ids[-8:]] + [(ids[-1], "other text"), (ids[-2], None), (ids[0], "")])
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    samples = [sorted(tuple(r) for r in toxicity._sampled(d, labels).collect()) for d in (docs, docs.orderBy(F.desc("text")).repartition(3))]
    assert samples[0] == samples[1]
    assert {r[0] for r in samples[0]} <= set(ids[-8:])
    assert len(samples[0]) == sum(min(4, sum(i % 2 == y for i in ids[-8:])) for y in (0, 1))
