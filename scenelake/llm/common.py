"""Pieces shared by the operators: reading, splits, Arrow passes and written intermediates."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from scenelake.session import ensure_checkpoint_dir

# A batch handed to Python holds this many bytes of text, so long documents
# travel in small batches and a worker's memory does not depend on row counts.
BATCH_BYTES = 8 << 20

ASCII_SPACE = b"\x09\x0a\x0b\x0c\x0d\x20"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(name: str = "text") -> Column:
    """The text as UTF-8 bytes; Arrow then hands over bytes without decoding."""
    return F.col(name).cast("binary").alias(name)


def in_held_out(doc_id: str = "doc_id") -> Column:
    """crc32(doc_id as text) mod 4 is 2; a null id is not held out."""
    crc = F.crc32(F.col(doc_id).cast("string").cast("binary"))
    return F.coalesce(crc % 4 == 2, F.lit(False))


def arrow_pass(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
               schema) -> DataFrame:
    """``mapInArrow`` with batches bounded by bytes as well as by rows."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(function, schema)


def keep_rows(docs: DataFrame, judge: Callable[[Iterator], Iterator]) -> DataFrame:
    """Rows of ``docs`` for which ``judge`` says yes, columns untouched and nothing shuffled.

    ``judge`` maps an iterator of lists of UTF-8 texts (None for null) to an iterator of lists of booleans.
    """
    position = docs.columns.index("text")

    def run(batches):
        waiting = []

        def texts():
            for batch in batches:
                waiting.append(batch)
                yield [None if t is None else t.encode() for t in batch.column(position).to_pylist()]

        for verdict in judge(texts()):
            yield waiting.pop(0).filter(pa.array(verdict, pa.bool_()))

    return arrow_pass(docs, run, docs.schema)


def materialise(df: DataFrame) -> DataFrame:
    """Write a small intermediate to the shared checkpoint folder and cut its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def split_join(rows: DataFrame, figures: DataFrame, key: str) -> DataFrame:
    """Join rows to the aggregated figures of their key so that a hot key can be split.

    An aggregate is already dealt by its key, and a join that reuses that leaves
    a hot key in one task. A second key, a hash of the first, makes Spark deal
    both sides anew for the join, and adaptive execution splits such joins.
    """
    again = F.xxhash64(key)
    return rows.withColumn("_again", again).join(figures.withColumn("_again", again), [key, "_again"]).drop("_again")


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner remove written tables that nothing refers to any more (shared disk, not memory)."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def settle(df: DataFrame) -> DataFrame:
    """Like ``materialise``; the shuffle files behind the written rows are removed at once."""
    conf, name = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(name, "false")
    conf.set(name, "true")
    try:
        return materialise(df.select("*"))  # a query takes this setting when it is made
    finally:
        conf.set(name, before)
