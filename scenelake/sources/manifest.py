"""SHA-256 manifests of files of any size."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from scenelake.sources.rasters import CHUNK_BYTES, TASK_BYTES, Slices, open_path, plan_slices


class DigestReader(DataSourceReader):
    """Files are read in chunks; a task hashes several small files or one large one."""

    def __init__(self, options: dict[str, str]):
        self.path, self.suffix = options["path"], options.get("suffix", "")

    def partitions(self) -> Sequence[InputPartition]:
        return plan_slices(self.path, TASK_BYTES, self.suffix, split=False) or [Slices([])]

    def read(self, partition: Slices) -> Iterator[pa.RecordBatch]:
        root = open_path(self.path)[1]
        for part in partition.slices:
            files, name = open_path(part.path)
            digest, size = hashlib.sha256(), 0
            with files.open_input_stream(name) as source:
                while chunk := source.read(CHUNK_BYTES):
                    digest.update(chunk)
                    size += len(chunk)
            inside = name.removeprefix(root).lstrip("/") or name.rsplit("/", 1)[-1]
            yield pa.RecordBatch.from_arrays([pa.array([inside]), pa.array([size], pa.int64()), pa.array([digest.hexdigest()])],
                                             ["path", "size", "sha256"])


class DigestSource(DataSource):
    """Format ``digests``: (path below the folder, size, sha256) of its files."""

    @classmethod
    def name(cls) -> str:
        return "digests"

    def schema(self) -> str:
        return "path string, size long, sha256 string"

    def reader(self, schema) -> DataSourceReader:
        return DigestReader(self.options)


def checksums(spark, path: str, suffix: str = "") -> DataFrame:
    """(path, size, sha256) of every file under a path; paths are relative to it. Hidden files are left out."""
    spark.dataSource.register(DigestSource)
    return spark.read.format("digests").option("suffix", suffix).load(path)


def manifest_lines(sums: DataFrame) -> DataFrame:
    return sums.select(F.concat("sha256", F.lit("  "), "path").alias("value"))


def append_manifest(sums: DataFrame, path: str) -> None:
    manifest_lines(sums).write.mode("append").text(path)


def read_manifest(spark, path: str) -> DataFrame:
    line = F.col("value")
    return spark.read.text(path).select(
        F.substring(line, 1, 64).alias("sha256"), F.expr("substring(value, 67)").alias("path"))


def verify(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """State of every file of either side: same, changed, missing or added."""
    e = expected.select("path", F.col("sha256").alias("expected"))
    a = actual.select("path", F.col("sha256").alias("actual"))
    state = (F.when(F.col("actual").isNull(), "missing").when(F.col("expected").isNull(), "added")
             .when(F.col("actual") == F.col("expected"), "same").otherwise("changed"))
    return e.join(a, "path", "full_outer").select("path", state.alias("state"))
