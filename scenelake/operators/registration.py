"""Co-registration of two dates.

A scene of one row holds both dates, so the shift is found where the row
lives: an Arrow-batched function returns one small struct per row and nothing
is grouped or moved. A scene of many blocks gets one shift from all its pixels,
and pixels are moved by their position in the scene, across block borders.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from scenelake.operators.blocks import roll, roll_up, unroll, warp_bilinear
from scenelake.operators.scenes import is_blocked, scene_shift
from scenelake.operators.spectra import FACTOR, registration_confidence, zoom_kernel, zoom_offsets, zoom_peak

# Side of the cells in which shifted pixels meet.
SHIFT_CELL = 16
MAX_SHIFT = 6

# Type objects rather than texts: workers import this module without a session.
_SHIFT = T.StructType().add("dy", T.IntegerType()).add("dx", T.IntegerType())
_SCORED_SHIFT = T.StructType().add("dy", T.IntegerType()).add("dx", T.IntegerType()).add("score", T.DoubleType())
_FINE_SHIFT = T.StructType().add("dy", T.DoubleType()).add("dx", T.DoubleType()).add("confidence", T.DoubleType())


def _square(values, width: int) -> np.ndarray:
    return np.asarray(values, dtype=np.float64).reshape(-1, int(width))


@F.pandas_udf(_SHIFT)
def phase_shift(before: pd.Series, after: pd.Series, width: pd.Series) -> pd.DataFrame:
    """Whole-pixel translation at the peak of the normalised cross-power spectrum."""
    shifts = []
    for a, b, w in zip(before, after, width):
        cross = np.fft.fft2(_square(a, w)) * np.conj(np.fft.fft2(_square(b, w)))
        surface = np.fft.ifft2(cross / (np.abs(cross) + 1e-8)).real
        peak = np.array(np.unravel_index(int(surface.argmax()), surface.shape))
        size = np.array(surface.shape)
        shifts.append(np.where(peak < size // 2, peak, peak - size))
    return pd.DataFrame(np.array(shifts).reshape(-1, 2), columns=["dy", "dx"])


@F.pandas_udf(_SCORED_SHIFT)
def correlation_shift(before: pd.Series, after: pd.Series, width: pd.Series) -> pd.DataFrame:
    """Translation below six pixels each way with the best correlation over the overlap.

    Flat overlaps score 0; equal scores prefer the shorter, then the smaller shift.
    """
    rows = []
    for a, b, w in zip(before, after, width):
        t1, t2 = _square(a, w), _square(b, w)
        h, n = t1.shape
        best = None
        for dy in range(max(1 - MAX_SHIFT, 1 - h), min(MAX_SHIFT, h)):
            for dx in range(max(1 - MAX_SHIFT, 1 - n), min(MAX_SHIFT, n)):
                u = t1[max(dy, 0):h + min(dy, 0), max(dx, 0):n + min(dx, 0)]
                v = t2[max(-dy, 0):h - max(dy, 0), max(-dx, 0):n - max(dx, 0)]
                u, v = u - u.mean(), v - v.mean()
                power = np.sqrt((u * u).sum() * (v * v).sum())
                score = round(float((u * v).sum() / power), 9) if power > 1e-12 else 0.0
                key = (-score, abs(dy) + abs(dx), dy, dx)
                best = key if best is None or key < best else best
        rows.append((best[2], best[3], -best[0]))
    return pd.DataFrame(rows, columns=["dy", "dx", "score"])


def _zoomed_peak(product: np.ndarray, center: np.ndarray, factor: int) -> tuple[np.ndarray, complex]:
    """Peak of the correlation on a fine grid of +-0.75 px around ``center``; equal peaks prefer the centre."""
    offsets = zoom_offsets(factor)
    kernels = [zoom_kernel(center[axis] + offsets, n) for axis, n in enumerate(product.shape)]
    fine = kernels[0] @ product @ kernels[1].T
    peak = zoom_peak(fine, offsets)
    return center + offsets[list(peak)], fine[peak]


@F.pandas_udf(_FINE_SHIFT)
def subpixel_shift(before: pd.Series, after: pd.Series, width: pd.Series) -> pd.DataFrame:
    """Translation to 0.1 px: whole-pixel phase peak refined by a small matrix DFT.

    Confidence is 1 minus the registration error, clipped to [0, 1].
    """
    rows = []
    for a, b, w in zip(before, after, width):
        fa, fb = np.fft.fft2(_square(a, w)), np.fft.fft2(_square(b, w))
        cross = fa * np.conj(fb)
        cross = cross / np.maximum(np.abs(cross), 100 * np.finfo(np.float64).eps)
        surface = np.abs(np.fft.ifft2(cross))
        size = np.array(surface.shape)
        peak = np.array(np.unravel_index(int(surface.argmax()), surface.shape), dtype=float)
        peak = np.where(peak > size // 2, peak - size, peak)
        shift, top = _zoomed_peak(cross, peak, FACTOR)
        energy = float((np.abs(fa) ** 2).sum() * (np.abs(fb) ** 2).sum())
        flat = [0.0 if n == 1 else s for s, n in zip(shift, size)]
        rows.append((*np.round(flat, 6) + 0.0, registration_confidence(top, energy)))
    return pd.DataFrame(rows, columns=["dy", "dx", "confidence"])


def luminance(bands: Sequence[str]) -> Column:
    """Mean of the bands, pixel by pixel."""
    return F.transform(F.arrays_zip(*bands), lambda p: sum(p[b] for b in bands) / float(len(bands)))


def _with_shift(pairs: DataFrame, keys: Sequence[str], before: Column, after: Column, find) -> DataFrame:
    """Add ``shift`` of the row, or of the scene of several blocks."""
    if is_blocked(pairs):
        return pairs.join(scene_shift(pairs, keys, before, after, find), list(keys))
    return pairs.withColumn("shift", find(before, after, F.col("width")))


def _move_by_position(pairs: DataFrame, keys: Sequence[str], bands: Sequence[str], wrap: bool) -> DataFrame:
    """Later bands of blocked scenes read from shifted positions, into ``b2a``.

    With ``wrap`` whole pixels move circularly; otherwise values are
    interpolated between the four source pixels and edges repeat. Every pixel
    writes to the at most four places that read it, with its weight; blocks are
    put together again by their numbers.
    """
    size = pairs.groupBy(*keys).agg(
        F.max(F.col("block_row") * F.col("block_size") + (F.size(f"{bands[0]}2") / F.col("width")).cast("int")).alias("_h"),
        F.max(F.col("block_col") * F.col("block_size") + F.col("width")).alias("_w"))
    moving = pairs.where("is_moved").join(size, list(keys))
    carried = ["_h", "_w", "_dy", "_dx", "_size"]
    px = unroll(moving.withColumns({"_dy": F.col("shift.dy"), "_dx": F.col("shift.dx"), "_size": F.col("block_size")}),
                [*keys, *carried], [f"{b}2" for b in bands])
    if wrap:
        one = F.array(F.struct(F.pmod(F.col("y") + F.col("_dy"), "_h").cast("int").alias("y"),
                               F.pmod(F.col("x") + F.col("_dx"), "_w").cast("int").alias("x"), F.lit(1.0).alias("weight")))
    else:
        def targets(pos: str, shift: str, extent: str, name: str) -> Column:
            """Places whose source lies within one pixel of this one, with their weights along an axis."""
            near = F.sequence(F.greatest(F.lit(0), F.floor(F.col(pos) + F.col(shift)).cast("int") - 1),
                              F.least(F.col(extent) - 1, F.ceil(F.col(pos) + F.col(shift)).cast("int") + 1))
            last = F.col(extent) - 1
            # Edge pixels also serve every place that looks beyond the edge.
            span = (F.when(F.col(pos) == 0, F.sequence(F.lit(0), F.least(last, F.greatest(F.lit(0), F.ceil(F.col(shift)).cast("int") + 1))))
                    .when(F.col(pos) == last, F.sequence(F.greatest(F.lit(0), F.least(last, F.floor(last + F.col(shift)).cast("int") - 1)), last))
                    .otherwise(F.when(F.greatest(F.lit(0), F.floor(F.col(pos) + F.col(shift)).cast("int") - 1)
                                      <= F.least(last, F.ceil(F.col(pos) + F.col(shift)).cast("int") + 1), near)
                               .otherwise(F.array().cast("array<int>"))))

            def weight(place: Column) -> Column:
                source = F.greatest(F.lit(0.0), F.least(last.cast("double"), place - F.col(shift)))
                return F.greatest(F.lit(0.0), F.lit(1.0) - F.abs(source - F.col(pos)))

            return F.filter(F.transform(span, lambda p: F.struct(p.alias(name), weight(p).alias("weight"))),
                            lambda t: t["weight"] > 0)

        ys, xs = targets("y", "_dy", "_h", "y"), targets("x", "_dx", "_w", "x")
        one = F.flatten(F.transform(ys, lambda a: F.transform(xs, lambda b: F.struct(
            a["y"].alias("y"), b["x"].alias("x"), (a["weight"] * b["weight"]).alias("weight")))))
    written = px.select(*keys, "_size", *[f"{b}2" for b in bands], F.explode(one).alias("_t"))
    summed = written.groupBy(*keys, "_size", F.col("_t.y").alias("y"), F.col("_t.x").alias("x")).agg(
        *[F.sum(F.col(f"{b}2") * F.col("_t.weight")).alias(f"{b}2a") for b in bands])
    placed = summed.withColumn("block_row", F.expr("y div _size").cast("int")).withColumn(
        "block_col", F.expr("x div _size").cast("int"))
    blocks = roll_up(placed, [*keys, "block_row", "block_col"], [f"{b}2a" for b in bands]).drop("width")
    joined = pairs.join(blocks, [*keys, "block_row", "block_col"], "left")
    return joined.withColumns({f"{b}2a": F.coalesce(f"{b}2a", F.col(f"{b}2").cast("array<double>")) for b in bands})


def coregister(pairs: DataFrame, bands: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Roll the later bands ``b2`` by the whole-pixel shift, into ``b2a``; large shifts are left alone.

    ``keys`` name the scene where it has several blocks.
    """
    before, after = luminance([f"{b}1" for b in bands]), luminance([f"{b}2" for b in bands])
    dy, dx = F.col("shift.dy"), F.col("shift.dx")
    moved = (F.abs(dy) < MAX_SHIFT) & (F.abs(dx) < MAX_SHIFT) & ((dy != 0) | (dx != 0))
    out = _with_shift(pairs, keys, before, after, phase_shift).withColumn("is_moved", moved)
    if is_blocked(pairs):
        return _move_by_position(out, keys, bands, wrap=True)
    for b in bands:
        out = out.withColumn(f"{b}2a", F.when(F.col("is_moved"), roll(F.col(f"{b}2"), F.col("width"), dy, dx))
                             .otherwise(F.col(f"{b}2")))
    return out


def coregister_ncc(pairs: DataFrame, before: str, after: str) -> DataFrame:
    """Best correlated translation of two arrays as ``shift(dy, dx, score)``."""
    return pairs.withColumn("shift", correlation_shift(before, after, F.col("width")))


def coregister_sub(pairs: DataFrame, bands: Sequence[str], estimate: bool = True, keys: Sequence[str] = ()) -> DataFrame:
    """Sub-pixel shift of the first band; warps every later band into ``b2a`` when 0.2 < |shift| < 10."""
    first = bands[0]
    if estimate:
        out = _with_shift(pairs, keys, F.col(f"{first}1"), F.col(f"{first}2"), subpixel_shift)
    else:
        out = pairs.withColumn("shift", F.struct(F.lit(0.0).alias("dy"), F.lit(0.0).alias("dx"), F.lit(1.0).alias("confidence")))
    dy, dx = F.col("shift.dy"), F.col("shift.dx")
    size = F.hypot(dx, dy)
    out = out.withColumn("is_moved", (size > 0.2) & (size < 10.0))
    if is_blocked(pairs):
        return _move_by_position(out, keys, bands, wrap=False)
    for b in bands:
        warped = warp_bilinear(F.col(f"{b}2"), F.col("width"), dy, dx)
        out = out.withColumn(f"{b}2a", F.when(F.col("is_moved"), warped).otherwise(F.col(f"{b}2")))
    return out


def shift_join(pixels: DataFrame, keys: Sequence[str], before: str, after: str, reach: int = MAX_SHIFT) -> DataFrame:
    """Every pixel of the first date with the later pixel under each shift |dy|, |dx| < ``reach``.

    Partners meet in square cells: a later pixel goes to the few cells it can
    reach, so neither date is multiplied by the number of shifts. Both are
    sorted for the join; pixels unrolled from arrays look small to the optimizer, which would gather them in the driver.
    """
    far = reach - 1

    def cell(position: Column) -> Column:
        return F.floor(position / SHIFT_CELL)

    def cells(name: str) -> Column:
        return F.explode(F.sequence(cell(F.col(name) - far), cell(F.col(name) + far)))

    first = pixels.select(*keys, "y", "x", before, cell(F.col("y")).alias("_cy"), cell(F.col("x")).alias("_cx"))
    later = (pixels.select(*keys, F.col("y").alias("_y"), F.col("x").alias("_x"), after, cells("y").alias("_cy"))
             .select(*keys, "_y", "_x", after, "_cy", cells("_x").alias("_cx")))
    dy, dx = F.col("y") - F.col("_y"), F.col("x") - F.col("_x")
    return (first.hint("merge").join(later, [*keys, "_cy", "_cx"]).where((F.abs(dy) <= far) & (F.abs(dx) <= far))
            .select(*keys, "y", "x", before, dy.alias("dy"), dx.alias("dx"), after))
