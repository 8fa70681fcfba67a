"""Raster files: windowed reading, whole-image writing, blocks and their overviews.

``register(spark)`` adds the format ``raster``. Its reader plans partitions from
file sizes alone; a task opens a file, reads its header and then only the byte
ranges of its own blocks, so a file may be larger than a task's memory and a
scene is read by as many tasks as its size asks for. Built in are NumPy array
files; image codecs plug in through ``decode_files``.
"""

from __future__ import annotations

import io
import os
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from scenelake.operators.components import spread_lookup

BLOCK_SCHEMA = ("path string, band int, block_row int, block_col int, height int, width int, dtype string, "
                "values array<double>")
IMAGE_SCHEMA = "name string, bands int, height int, width int, values array<double>"
BLOCK = 256
# Pixels handed to Spark at once by the decoder.
MAX_BATCH_VALUES = 1_000_000
# Bytes of files that one task reads, and of a file that it reads or hashes at once.
TASK_BYTES = 64 << 20
CHUNK_BYTES = 8 << 20
LEVELS = (1, 2, 3, 4)


def decode_npy(content: bytes) -> np.ndarray:
    """Default decoder: a NumPy array file, (H, W) or (bands, H, W)."""
    return np.load(io.BytesIO(content), allow_pickle=False)


# --- Files of any size -------------------------------------------------------


def open_path(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path within it; a path without a scheme is local."""
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), os.path.abspath(path.removeprefix("file:")))


@dataclass
class Slice:
    """Part ``number`` of ``parts`` of a file."""

    path: str
    size: int
    number: int = 0
    parts: int = 1


class Slices(InputPartition):
    """What one task reads: a part of a large file, or several small files."""

    def __init__(self, slices: list[Slice]):
        self.slices = slices


def plan_slices(path: str, task_bytes: int, suffix: str = "", split: bool = True) -> list[Slices]:
    """Partitions of about ``task_bytes`` over the files under a path, from the listing alone."""
    files, root = open_path(path)
    info = files.get_file_info(root)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == fs.FileType.File else files.get_file_info(fs.FileSelector(root, recursive=True))
    scheme = path[:path.index("://") + 3] if "://" in path else ""
    out, small, held = [], [], 0
    for f in sorted((f for f in found if f.type == fs.FileType.File), key=lambda f: f.path):
        if not f.base_name.endswith(suffix) or f.base_name.startswith(("_", ".")):
            continue
        where = f.path if not scheme else scheme + f.path.lstrip("/") if not scheme.startswith("file") else scheme + f.path
        if split and f.size > task_bytes:
            parts = -(-f.size // task_bytes)
            out += [Slices([Slice(where, f.size, i, parts)]) for i in range(parts)]
            continue
        if small and held + f.size > task_bytes:
            out.append(Slices(small))
            small, held = [], 0
        small.append(Slice(where, f.size))
        held += f.size
    return [*out, Slices(small)] if small else out


class Windows:
    """Blocks of a NumPy array file, read by byte ranges."""

    def __init__(self, source):
        self.source = source
        version = np.lib.format.read_magic(source)
        read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
        shape, is_fortran, self.dtype = read(source)
        if is_fortran or len(shape) not in (2, 3) or self.dtype.hasobject:
            raise ValueError(f"a raster is a C-ordered array of numbers (H, W) or (bands, H, W), not {shape}")
        self.bands, self.height, self.width = (1, *shape) if len(shape) == 2 else shape
        self.begin = source.tell()

    def places(self, block: int) -> tuple[int, int, int]:
        """Numbers of bands, block rows and block columns."""
        return self.bands, -(-self.height // block), -(-self.width // block)

    def read(self, band: int, row: int, col: int, block: int) -> np.ndarray:
        y, x = row * block, col * block
        height, width = min(block, self.height - y), min(block, self.width - x)
        out, size = np.empty((height, width), dtype=self.dtype), self.dtype.itemsize
        first = self.begin + ((band * self.height + y) * self.width + x) * size
        if width == self.width:  # whole lines are one range
            self.source.seek(first)
            return np.frombuffer(self.source.read(height * width * size), dtype=self.dtype).reshape(height, width)
        for line in range(height):
            self.source.seek(first + line * self.width * size)
            out[line] = np.frombuffer(self.source.read(width * size), dtype=self.dtype)
        return out


class RasterReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.block = options["path"], int(options.get("block", BLOCK))
        self.task_bytes = int(options.get("taskBytes", TASK_BYTES))

    def partitions(self) -> Sequence[InputPartition]:
        return plan_slices(self.path, self.task_bytes, ".npy") or [Slices([])]

    def read(self, partition: Slices) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for part in partition.slices:
            files, name = open_path(part.path)
            with files.open_input_file(name) as source:
                windows = Windows(source)
                places = windows.places(self.block)
                total = places[0] * places[1] * places[2]
                for i in range(total * part.number // part.parts, total * (part.number + 1) // part.parts):
                    band, row, col = (int(n) for n in np.unravel_index(i, places))
                    values = windows.read(band, row, col, self.block)
                    rows.append((part.path, band, row, col, *values.shape, str(windows.dtype), values.astype(np.float64).ravel()))
                    held += values.size
                    if held >= MAX_BATCH_VALUES:
                        yield _batch(rows)
                        rows, held = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), *[pa.int32()] * 5, pa.string(), pa.list_(pa.float64()))
    names = [c.split()[0] for c in BLOCK_SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


@dataclass
class Written(WriterCommitMessage):
    """Temporary names that a task has written, with the final ones."""

    names: list[tuple[str, str]]


class RasterWriter(DataSourceWriter):
    """One file per row, hidden until all tasks are done; a retried task leaves nothing behind under final names."""

    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite

    def write(self, rows) -> Written:
        files, root = open_path(self.path)
        files.create_dir(root, recursive=True)
        names = []
        for row in rows:
            image = np.asarray(row["values"], dtype=np.float64).reshape(row["bands"], row["height"], row["width"])
            hidden = f"{root}/_{uuid.uuid4().hex}.tmp"
            with files.open_output_stream(hidden) as out:
                np.lib.format.write_array(out, image if row["bands"] > 1 else image[0], allow_pickle=False)
            names.append((hidden, f"{root}/{row['name']}.npy"))
        return Written(names)

    def commit(self, messages) -> None:
        files, root = open_path(self.path)
        if self.overwrite:
            final = {name for m in messages for _, name in m.names}
            for old in files.get_file_info(fs.FileSelector(root)):
                if old.path.endswith(".npy") and old.path not in final:
                    files.delete_file(old.path)
        for message in messages:
            for hidden, name in message.names:
                files.move(hidden, name)

    def abort(self, messages) -> None:
        files, _ = open_path(self.path)
        for message in messages:
            for hidden, _ in message.names if message else ():
                files.delete_file(hidden)


class RasterSource(DataSource):
    """Format ``raster``: reads blocks, writes images (``IMAGE_SCHEMA``); options ``path``, ``block``, ``taskBytes``."""

    @classmethod
    def name(cls) -> str:
        return "raster"

    def schema(self) -> str:
        return BLOCK_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return RasterReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return RasterWriter(self.options, overwrite)


def register(spark) -> None:
    spark.dataSource.register(RasterSource)


def scan(spark, path: str, block: int = BLOCK, task_bytes: int = TASK_BYTES) -> DataFrame:
    """Blocks of the raster files under a path, window by window."""
    register(spark)
    return spark.read.format("raster").option("block", block).option("taskBytes", task_bytes).load(path)


def write_images(images: DataFrame, path: str, mode: str = "append") -> None:
    """One file per row (``IMAGE_SCHEMA``) under a path; an image is bounded by its row."""
    register(images.sparkSession)
    images.select("name", "bands", "height", "width", "values").write.format("raster").mode(mode).save(path)


def decode_files(files: DataFrame, decoder: Callable[[bytes], np.ndarray] = decode_npy, block: int = BLOCK
                 ) -> DataFrame:
    """files(path, content) to blocks of at most ``block`` x ``block`` pixels per band.

    For codecs that need a whole file: ``decoder`` turns bytes into an array.
    """
    columns = ["path", "band", "block_row", "block_col", "height", "width", "dtype", "values"]

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, held = [], 0
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                image = decoder(bytes(content))
                image = image[np.newaxis] if image.ndim == 2 else image
                for b, y, x in np.ndindex(image.shape[0], -(-image.shape[1] // block), -(-image.shape[2] // block)):
                    part = image[b, y * block:(y + 1) * block, x * block:(x + 1) * block]
                    rows.append((path, b, y, x, *part.shape, str(image.dtype), part.astype(np.float64).ravel()))
                    held += part.size
                    if held >= MAX_BATCH_VALUES:
                        yield pd.DataFrame(rows, columns=columns)
                        rows, held = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=columns)

    return files.select("path", "content").mapInPandas(decode, BLOCK_SCHEMA)


# --- Blocks and masks --------------------------------------------------------


def write_blocks(blocks: DataFrame, path: str, mode: str = "append") -> None:
    """Block table on disk; tile ids are clustered so that readers prune files."""
    blocks.repartition("tile_id").sortWithinPartitions("tile_id").write.mode(mode).parquet(path)


def _overviews(values: np.ndarray, level: int) -> np.ndarray:
    """Means of cells of 2**level pixels a side; cells at the far edges average what there is."""
    side, (height, width) = 1 << level, values.shape
    rows, cols = np.arange(0, height, side), np.arange(0, width, side)
    sums = np.add.reduceat(np.add.reduceat(values, rows, axis=0), cols, axis=1)
    counts = np.outer(np.diff(np.append(rows, height)), np.diff(np.append(cols, width)))
    return sums / counts


def overviews(blocks: DataFrame, value: str, levels: Sequence[int] = LEVELS) -> DataFrame:
    """tile_id, level, block_row, block_col, block_size, width, ``value``: coarser copies of each block, made in place.

    Cells must not cross blocks: a tile of several blocks needs a block side that
    the coarsest cell divides.
    """
    kind = blocks.schema["tile_id"].dataType.simpleString()
    names = ["tile_id", "level", "block_row", "block_col", "block_size", "width", value]

    def run(batches):
        for batch in batches:
            ids, rows = batch.column(0), []
            for i, (row, col, size, width, data) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(1, 6)))):
                image = np.asarray(data, dtype=np.float64).reshape(-1, width)
                if size % (1 << max(levels)) and (row or col or max(image.shape) < size):
                    raise ValueError(f"blocks of {size} pixels cannot hold whole cells of {1 << max(levels)}")
                for level in levels:
                    small = _overviews(image, level)
                    rows.append((i, level, row, col, -(-size >> level), small.shape[1], small.ravel()))
            if rows:
                at, *columns = zip(*rows)
                kinds = [*[pa.int32()] * 5, pa.list_(pa.float64())]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), *[pa.array(c, k) for c, k in zip(columns, kinds)]], names)

    wanted = blocks.select("tile_id", *[F.col(c).cast("int") for c in names[2:6]], F.col(value).cast("array<double>"))
    return wanted.mapInArrow(run, f"tile_id {kind}, level int, block_row int, block_col int, block_size int, width int, "
                                  f"{value} array<double>")


def write_mask(blocks: DataFrame, path: str, value: str = "mask", min_size: int = 512, mode: str = "append") -> None:
    """Mask blocks (tile_id, block_row, block_col, block_size, width, ``value``) and overviews of large masks.

    The input is evaluated once, for level 0; the overviews of tiles with at
    least ``min_size`` pixels on a side are made from the written blocks. A row
    on disk is a block; ``read_mask`` gives pixels.
    """
    spark, columns = blocks.sparkSession, ["tile_id", "block_row", "block_col", "block_size", "width", value]
    run = uuid.uuid4().hex
    base = blocks.select(*columns).withColumn(value, F.col(value).cast("array<double>")).withColumn("run", F.lit(run))
    base.withColumn("level", F.lit(0)).write.mode(mode).partitionBy("level").parquet(path)
    stored = spark.read.parquet(path).where((F.col("level") == 0) & (F.col("run") == run)).select(*columns)
    end = F.greatest(F.col("block_row") * F.col("block_size") + F.size(value) / F.col("width"),
                     F.col("block_col") * F.col("block_size") + F.col("width"))
    large = stored.groupBy("tile_id").agg(F.max(end).alias("_side")).where(F.col("_side") >= min_size).select("tile_id")
    coarse = overviews(spread_lookup(stored, large, ["tile_id"], "left_semi"), value)
    coarse.withColumn("run", F.lit(run)).select(*columns, "run", "level").write.mode("append").partitionBy("level").parquet(path)


def read_mask(spark, path: str, value: str = "mask") -> DataFrame:
    """Pixels of written masks: tile_id, level, y, x and the value."""
    from scenelake.operators.blocks import unroll

    blocks = spark.read.parquet(path)
    return unroll(blocks, ["tile_id", "level"], [value])


def scale_reflectance(dn: Column) -> Column:
    """Digital number to reflectance."""
    return dn / 10000.0
