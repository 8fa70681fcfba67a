"""URL filters over a sorted digest array.

The entries (host and path prefix) are hashed with 64-bit xxHash and sorted;
digests, string offsets and strings lie in one file that every executor gets
through Spark's file service and maps into memory, so the workers of a machine
share its pages. A URL is turned into the keys it could be listed under (its
host and parent domains, each with every path prefix of a listed length); all
keys of a batch are probed with one vectorised binary search, and a hit counts
only if the stored string equals the key.
"""

from __future__ import annotations

import os
import re
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, functions as F

from scenelake.llm.common import arrow_pass

LIST_ROWS = 1_000_000  # entries of one file; longer lists take several passes
PROBES = 200_000  # keys searched at once

# The rules of the registered query: host, path prefix, verdict.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
DEFAULT = "allow"  # verdict of a URL without an entry

_PARTS = re.compile(r"://([^/?#]*)([^?#]*)", re.S)
_LOWER = {c: c + 32 for c in range(65, 91)}


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path); both empty without ``://``."""
    found = _PARTS.search(url) if url else None
    return (found[1].translate(_LOWER), found[2]) if found else ("", "")


def write_index(entries: list[tuple[str, str, str]], path: str) -> None:
    """File of counts, listed lengths of paths and numbers of host labels, sorted digests, string offsets and strings.

    Of equal entries the first verdict counts.
    """
    verdicts: dict[str, tuple[str, str]] = {}
    for host, prefix, verdict in entries:
        verdicts.setdefault(_key(host, prefix), (host + prefix, verdict))
    keys = sorted((xxhash.xxh64_intdigest(key.encode()), key) for key in verdicts)
    strings = ["\x00".join((key, *verdicts[key])).encode() for _, key in keys]
    offsets = np.cumsum([0, *map(len, strings)], dtype="<u8")
    lengths = np.array(sorted({len(key.partition("\x01")[2]) for _, key in keys}), dtype="<u8")
    labels = np.array(sorted({key.partition("\x01")[0].count(".") + 1 for _, key in keys}), dtype="<u8")
    with open(path, "wb") as out:
        out.write(np.array([len(keys), len(lengths), len(labels)], dtype="<u8").tobytes())
        out.write(lengths.tobytes())
        out.write(labels.tobytes())
        out.write(np.array([digest for digest, _ in keys], dtype="<u8").tobytes())
        out.write(offsets.tobytes())
        out.write(b"".join(strings))


def _key(host: str, prefix: str) -> str:
    return f"{host}\x01{prefix}"


class Index:
    """The mapped file."""

    def __init__(self, path: str):
        words = np.memmap(path, dtype="<u8", mode="r", shape=(os.path.getsize(path) // 8,))
        n, n_lengths, n_labels = (int(w) for w in words[:3])
        self.lengths = words[3:3 + n_lengths].tolist()
        begin = 3 + n_lengths + n_labels
        self.labels = words[3 + n_lengths:begin].tolist()
        self.digests = words[begin:begin + n]
        self.offsets = words[begin + n:begin + 2 * n + 1]
        self.strings = np.memmap(path, dtype=np.uint8, mode="r", offset=8 * (begin + 2 * n + 1),
                                 shape=(int(self.offsets[-1]),)) if n else np.zeros(0, np.uint8)

    def keys(self, host: str, path: str) -> list[str]:
        """Every key under which an entry fitting the URL would be stored.

        Only parent domains with a listed number of labels and prefixes of a
        listed length, so a long host or path has no more keys than the list has such numbers.
        """
        labels = host.split(".")
        hosts = [".".join(labels[-n:]) for n in self.labels if n <= len(labels)]
        prefixes = [path[:n] for n in self.lengths if n <= len(path)]
        return [_key(h, p) for h in hosts for p in prefixes]

    def find(self, keys: list[str]) -> list[tuple[int, str, str]]:
        """(position in ``keys``, rule, verdict) of the keys that are stored."""
        if not keys or not len(self.digests):
            return []
        wanted = np.fromiter((xxhash.xxh64_intdigest(k.encode()) for k in keys), np.uint64, len(keys))
        at = np.searchsorted(self.digests, wanted)
        hits = np.flatnonzero(self.digests[np.minimum(at, len(self.digests) - 1)] == wanted)
        found = []
        for i in hits:
            place = int(at[i])
            while place < len(self.digests) and self.digests[place] == wanted[i]:  # equal digests stand together
                stored = bytes(self.strings[int(self.offsets[place]):int(self.offsets[place + 1])])
                key, rule, verdict = stored.decode().split("\x00")
                if key == keys[i]:
                    found.append((int(i), rule, verdict))
                place += 1
        return found


def _judge(index: Index, urls: list[tuple[str, str]], best: list[tuple[str | None, str | None]]) -> None:
    """Replace ``best`` where a longer entry fits; equal lengths go to the smaller string."""
    keys, owner = [], []

    def flush():
        for i, rule, verdict in index.find(keys):
            known = best[owner[i]][0]
            if known is None or (-len(rule), rule) < (-len(known), known):
                best[owner[i]] = (rule, verdict)
        keys.clear()
        owner.clear()

    for number, (host, path) in enumerate(urls):
        if host:
            more = index.keys(host, path)
            keys.extend(more)
            owner.extend([number] * len(more))
        if len(keys) >= PROBES:
            flush()
    flush()


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict.

    ``rules(host, path, verdict)``: an entry fits its host and all subdomains
    if the path starts with its prefix; the longest fitting entry decides and
    ``default`` where none fits. Null URLs and those without ``://`` have an
    empty host and path and fit nothing; rules with a null host or path are
    ignored; repeated rows stay. Lists longer than ``LIST_ROWS`` take one pass
    per file. Further columns are ignored.
    """
    spark = pages.sparkSession
    kind = pages.schema["page_id"].dataType.simpleString()
    state = pages.select("page_id", F.col("url").cast("string").alias("url"), F.lit(None).cast("string").alias("rule"),
                         F.lit(None).cast("string").alias("verdict"))
    schema = f"page_id {kind}, url string, rule string, verdict string"

    def passed(state, entries):
        # Spark's own folder of files to distribute; executors fetch the file from the driver.
        name = f"url-index-{uuid.uuid4()}.bin"
        path = os.path.join(SparkFiles.getRootDirectory(), name)
        write_index(entries, path)
        spark.sparkContext.addFile(path)

        def run(batches):
            index = Index(SparkFiles.get(name))
            for batch in batches:
                best = list(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()))
                _judge(index, [split_url(u) for u in batch.column(1).to_pylist()], best)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array([r for r, _ in best], pa.string()),
                     pa.array([v for _, v in best], pa.string())], ["page_id", "url", "rule", "verdict"])

        return arrow_pass(state, run, schema)

    entries: list[tuple[str, str, str]] = []
    wanted = rules.where(F.col("host").isNotNull() & F.col("path").isNotNull()).select("host", "path", "verdict")
    for row in wanted.toLocalIterator():
        entries.append((row[0].translate(_LOWER), row[1], row[2] or default))
        if len(entries) == LIST_ROWS:
            state = passed(state, entries)
            entries = []
    if entries:
        state = passed(state, entries)
    parts = [F.regexp_extract("url", r"(?s)://([^/?#]*)([^?#]*)", i) for i in (1, 2)]
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return state.select(
        "page_id", F.coalesce(F.translate(parts[0], upper, lower), F.lit("")).alias("host"),
        F.coalesce(parts[1], F.lit("")).alias("path"), "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
