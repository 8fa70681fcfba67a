"""Raster blocks.

A raster is stored as blocks: one row per (tile, epoch), one array column per
band in row-major order, plus ``width``. A block is a bounded window of a scene
(256 x 256 by default), so a row stays small however large the scene is, and a
two-date join moves arrays instead of pixels. Pixels are unrolled only after
the join, inside the task that holds the block.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F


def widen(blocks: DataFrame, keys: Sequence[str], roles: dict[str, Column], values: str = "values") -> DataFrame:
    """One row per key with one array column per role, from one row per (key, band, epoch)."""
    picked = [F.max(F.when(test, F.col(values))).alias(name) for name, test in roles.items()]
    return blocks.groupBy(*keys).agg(*picked)


def bitemporal_join(before: DataFrame, after: DataFrame, keys: Sequence[str], bands: Sequence[str],
                    strict: bool = True) -> DataFrame:
    """Pair the blocks of two dates; band ``b`` becomes ``b1`` and ``b2``.

    Blocks of unequal size raise an error, or are dropped when not ``strict``.
    """
    left = before.select(*keys, "width", *[F.col(b).alias(f"{b}1") for b in bands])
    right = after.select(*keys, F.col("width").alias("width2"), *[F.col(b).alias(f"{b}2") for b in bands])
    b = bands[0]
    same = (F.col("width") == F.col("width2")) & (F.size(f"{b}1") == F.size(f"{b}2"))
    pairs = left.join(right, list(keys))
    if not strict:
        return pairs.where(same).drop("width2")
    message = F.format_string("block shapes differ: %d and %d pixels", F.size(f"{b}1"), F.size(f"{b}2"))
    checked = F.when(same, F.col("width")).otherwise(F.raise_error(message).cast("int"))
    return pairs.withColumn("width", checked).drop("width2")


def unroll(blocks: DataFrame, keys: Sequence[str], arrays: Sequence[str], width: str = "width") -> DataFrame:
    """One row per pixel: keys, y, x and one column per array. No shuffle.

    Positions are those of the scene where the table has block numbers that are not among the keys.

    The outer form keeps the optimizer from adding a non-empty test that would
    evaluate derived arrays a second time below the generator.
    """
    zipped = F.arrays_zip(*[F.col(a) for a in arrays])
    placed = {"block_row", "block_col", "block_size"} <= set(blocks.columns) - set(keys)
    top, left = [F.col(c) * F.col("block_size") if placed else F.lit(0) for c in ("block_row", "block_col")]
    flat = blocks.select(*keys, F.col(width).cast("int").alias("_stride"), top.alias("_top"), left.alias("_left"),
                         F.posexplode_outer(zipped).alias("_pos", "_px"))
    flat = flat.where(F.col("_pos").isNotNull())
    return flat.select(
        *keys, (F.col("_top") + F.expr("_pos div _stride")).cast("int").alias("y"),
        (F.col("_left") + F.col("_pos") % F.col("_stride")).cast("int").alias("x"),
        *[F.col("_px")[a].alias(a) for a in arrays])


def roll_up(pixels: DataFrame, keys: Sequence[str], values: Sequence[str], position: Sequence[str] = ("y", "x"),
            width: Column | None = None) -> DataFrame:
    """Pixels back to blocks; each key must be a bounded block, not a whole scene."""
    packed = F.array_sort(F.collect_list(F.struct(*position, *values)))
    grouped = pixels.groupBy(*keys).agg(packed.alias("_px"), (F.max(position[-1]) + 1).cast("int").alias("width"))
    columns = [F.col("_px")[v].alias(v) for v in values]
    return grouped.select(*keys, "width" if width is None else width.alias("width"), *columns)


def gather(values: Column, width: Column, row: Callable[..., Column], col: Callable[..., Column]) -> Column:
    """A block of the same size whose pixel (y, x) is read from (row(y, x, h, w), col(y, x, h, w))."""
    height = (F.size(values) / width).cast("int")
    index = F.sequence(F.lit(0), F.size(values) - 1)

    def read(i: Column) -> Column:
        y, x = F.floor(i / width), i % width
        return F.get(values, (row(y, x, height, width) * width + col(y, x, height, width)).cast("int"))

    return F.transform(index, read)


def roll(values: Column, width: Column, dy: Column, dx: Column) -> Column:
    """Circular shift of a block by (dy, dx)."""
    return gather(values, width, lambda y, x, h, w: F.pmod(y - dy, h), lambda y, x, h, w: F.pmod(x - dx, w))


def warp_bilinear(values: Column, width: Column, dy: Column, dx: Column) -> Column:
    """Fractional shift of a block with linear interpolation; edges repeat."""
    height = (F.size(values) / width).cast("int")
    index = F.sequence(F.lit(0), F.size(values) - 1)

    def read(i: Column) -> Column:
        sy = F.greatest(F.lit(0.0), F.least(height - 1.0, F.floor(i / width) - dy))
        sx = F.greatest(F.lit(0.0), F.least(width - 1.0, i % width - dx))
        y0, x0 = F.floor(sy), F.floor(sx)
        y1, x1 = F.least(y0 + 1, height - 1), F.least(x0 + 1, width - 1)
        fy, fx = sy - y0, sx - x0

        def at(y: Column, x: Column) -> Column:
            return F.get(values, (y * width + x).cast("int"))

        top = at(y0, x0) * (1.0 - fx) + at(y0, x1) * fx
        bottom = at(y1, x0) * (1.0 - fx) + at(y1, x1) * fx
        return top * (1.0 - fy) + bottom * fy

    return F.transform(index, read)


def pyramid(pixels: DataFrame, keys: Sequence[str], value: str, levels: Sequence[int] = (1, 2, 3, 4)) -> DataFrame:
    """Overviews: mean over 2^k x 2^k cells for each level k, in one pass."""
    level = F.explode(F.array(*[F.lit(k) for k in levels])).alias("level")
    leveled = pixels.select(*keys, "y", "x", value, level)
    return (leveled
            .withColumn("y", F.expr("shiftright(y, level)"))
            .withColumn("x", F.expr("shiftright(x, level)"))
            .groupBy(*keys, "level", "y", "x").agg(F.avg(value).alias(value)))
