"""Phase correlation of scenes that no task holds whole.

The two-dimensional transform of a scene is taken in strips: lines are
transformed along x, turned into columns by one exchange, transformed along y,
multiplied and transformed back, and turned into lines again. A task holds one
strip of ``STRIP`` values at full resolution (one line or column at least), so
the correlation surface and its peak are those of the whole scene. Of the
transforms along x only the half that real pixels need is moved.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

STRIP = 1 << 18  # values of one date in a strip
BATCH_BYTES = 16 << 20

# Rectangle of a strip: its place in the scene and its values, row-major.
_PARTS = T.ArrayType(T.StructType().add("strip", T.IntegerType()).add("top", T.IntegerType()).add("left", T.IntegerType())
                     .add("height", T.IntegerType()).add("width", T.IntegerType()).add("data", T.BinaryType()))
_PEAK = T.StructType().add("rank", T.DoubleType()).add("y", T.IntegerType()).add("x", T.IntegerType())
_ZOOM = T.StructType().add("fine", T.BinaryType()).add("before", T.DoubleType()).add("after", T.DoubleType())
_WHOLE_SHIFT = T.StructType().add("dy", T.DoubleType()).add("dx", T.DoubleType()).add("confidence", T.DoubleType())

FACTOR = 10  # steps of the fine grid in a pixel


def zoom_offsets(factor: int) -> np.ndarray:
    """Fine grid of +-0.75 px."""
    span = int(np.ceil(factor * 1.5))
    return (np.arange(span) - span // 2) / factor


def zoom_kernel(places: np.ndarray, n: int) -> np.ndarray:
    """Rows that transform ``n`` frequencies back to ``places``."""
    return np.exp(2j * np.pi * np.outer(places, np.fft.fftfreq(n)))


def zoom_peak(fine: np.ndarray, offsets: np.ndarray) -> tuple[int, int]:
    """Index of the highest value of the fine grid; equal ones prefer the centre."""
    height = np.abs(fine)
    away = np.hypot(*np.meshgrid(offsets, offsets, indexing="ij"))
    best = np.where(height >= height.max() * (1 - 1e-9), away, np.inf)
    return np.unravel_index(int(best.argmin()), fine.shape)


def registration_confidence(top: complex, energy: float) -> float:
    """1 minus the registration error, clipped to [0, 1]."""
    error = np.sqrt(abs(1.0 - abs(top) ** 2 / energy)) if energy > 0 else 0.0
    return float(np.clip(1.0 - error, 0.0, 1.0))


def _per_strip(other: int) -> int:
    return max(1, STRIP // int(other))


def _cut(values: np.ndarray, top: int, left: int, along: int, per: int) -> list[dict]:
    """``values`` (date, y, x) placed at (top, left), cut into strips of ``per`` lines (``along`` 1) or columns (2)."""
    start, found = (top, left)[along - 1], []
    end = start + values.shape[along]
    for strip in range(start // per, (end - 1) // per + 1):
        a, b = max(start, strip * per), min(end, (strip + 1) * per)
        part = values[:, a - start:b - start] if along == 1 else values[:, :, a - start:b - start]
        found.append({"strip": strip, "top": a if along == 1 else top, "left": a if along == 2 else left,
                      "height": part.shape[1], "width": part.shape[2], "data": np.ascontiguousarray(part).tobytes()})
    return found


def _joined(parts, top: int, left: int, height: int, width: int, kind) -> np.ndarray:
    """The strip (date, y, x) of its parts; places without a block are 0."""
    whole = None
    for p in parts:
        values = np.frombuffer(p["data"], kind).reshape(-1, p["height"], p["width"])
        if whole is None:
            whole = np.zeros((len(values), height, width), kind)
        y, x = p["top"] - top, p["left"] - left
        whole[:, y:y + p["height"], x:x + p["width"]] = values
    return whole


@F.pandas_udf(_PARTS)
def _lines(before: pd.Series, after: pd.Series, width: pd.Series, top: pd.Series, left: pd.Series,
           scene_width: pd.Series) -> pd.Series:
    return pd.Series([_cut(np.stack([np.asarray(v, float).reshape(-1, w) for v in (a, b)]), t, x, 1, _per_strip(n))
                      for a, b, w, t, x, n in zip(before, after, width, top, left, scene_width)], dtype=object)


@F.pandas_udf(_PARTS)
def _along_x(parts: pd.Series, strip: pd.Series, h: pd.Series, w: pd.Series) -> pd.Series:
    found = []
    for p, s, height, width in zip(parts, strip, h, w):
        top, per = s * _per_strip(width), _per_strip(width)
        pixels = _joined(p, top, 0, min(per, height - top), width, float)
        found.append(_cut(np.fft.rfft(pixels, axis=2), top, 0, 2, _per_strip(height)))
    return pd.Series(found, dtype=object)


def _product(parts, strip: int, h: int, w: int, fine: bool) -> tuple[np.ndarray, np.ndarray]:
    """Normalised cross-power of a strip of columns, and the spectra of both dates."""
    left = strip * _per_strip(h)
    both = np.fft.fft(_joined(parts, 0, left, h, min(_per_strip(h), w // 2 + 1 - left), complex), axis=1)
    cross = both[0] * np.conj(both[1])
    size = np.abs(cross)
    return cross / (np.maximum(size, 100 * np.finfo(np.float64).eps) if fine else size + 1e-8), both


@F.pandas_udf(_PARTS)
def _along_y(parts: pd.Series, strip: pd.Series, h: pd.Series, w: pd.Series, fine: pd.Series) -> pd.Series:
    return pd.Series([_cut(np.fft.ifft(_product(p, s, height, width, f)[0], axis=0)[None], 0, s * _per_strip(height), 1,
                           _per_strip(width))
                      for p, s, height, width, f in zip(parts, strip, h, w, fine)], dtype=object)


@F.pandas_udf(_PEAK)
def _peak(parts: pd.Series, strip: pd.Series, h: pd.Series, w: pd.Series, fine: pd.Series) -> pd.DataFrame:
    rows = []
    for p, s, height, width, f in zip(parts, strip, h, w, fine):
        top = s * _per_strip(width)
        half = _joined(p, top, 0, min(_per_strip(width), height - top), width // 2 + 1, complex)[0]
        surface = np.fft.irfft(half, n=width, axis=1)
        surface = np.abs(surface) if f else surface
        y, x = np.unravel_index(int(surface.argmax()), surface.shape)
        rows.append((-float(surface[y, x]), top + int(y), int(x)))
    return pd.DataFrame(rows, columns=["rank", "y", "x"])


def _centre(y: int, x: int, size: np.ndarray, fine: bool) -> np.ndarray:
    peak = np.array([y, x])
    return np.where(peak > size // 2, peak - size, peak) if fine else np.where(peak < size // 2, peak, peak - size)


@F.pandas_udf(_ZOOM)
def _zoom(parts: pd.Series, strip: pd.Series, h: pd.Series, w: pd.Series, y: pd.Series, x: pd.Series) -> pd.DataFrame:
    """What a strip of columns, and its mirror image, adds to the fine grid and to the energies."""
    rows, offsets = [], zoom_offsets(FACTOR)
    for p, s, height, width, py, px in zip(parts, strip, h, w, y, x):
        product, both = _product(p, s, height, width, True)
        centre = _centre(py, px, np.array([height, width]), True)
        down, across = zoom_kernel(centre[0] + offsets, height), zoom_kernel(centre[1] + offsets, width)
        columns = s * _per_strip(height) + np.arange(product.shape[1])
        twins = (columns > 0) & (2 * columns < width)
        mirror = np.conj(product[-np.arange(height) % height][:, twins])
        fine = down @ product @ across[:, columns].T + down @ mirror @ across[:, width - columns[twins]].T
        power = [(np.abs(v) ** 2).sum(axis=0) @ (1.0 + twins) for v in both]
        rows.append((fine.tobytes(), *map(float, power)))
    return pd.DataFrame(rows, columns=["fine", "before", "after"])


@F.pandas_udf(_WHOLE_SHIFT)
def _whole_shift(y: pd.Series, x: pd.Series, h: pd.Series, w: pd.Series) -> pd.DataFrame:
    rows = [(*map(float, _centre(*yx, np.array(size), False)), None) for yx, size in zip(zip(y, x), zip(h, w))]
    return pd.DataFrame(rows, columns=["dy", "dx", "confidence"])


@F.pandas_udf(_WHOLE_SHIFT)
def _fine_shift(strips: pd.Series, y: pd.Series, x: pd.Series, h: pd.Series, w: pd.Series) -> pd.DataFrame:
    rows, offsets = [], zoom_offsets(FACTOR)
    for found, py, px, height, width in zip(strips, y, x, h, w):
        found = sorted(found, key=lambda s: s["strip"])
        fine = sum(np.frombuffer(s["z"]["fine"], complex).reshape(len(offsets), -1) for s in found)
        energy = sum(s["z"]["before"] for s in found) * sum(s["z"]["after"] for s in found)
        at = zoom_peak(fine, offsets)
        size = np.array([height, width])
        shift = np.where(size == 1, 0.0, _centre(py, px, size, True) + offsets[list(at)])
        rows.append((*np.round(shift, 6) + 0.0, registration_confidence(fine[at], energy)))
    return pd.DataFrame(rows, columns=["dy", "dx", "confidence"])


def strip_shift(blocks: DataFrame, keys: Sequence[str], fine: bool) -> DataFrame:
    """Keys and dy, dx, confidence of scenes of any size, from the peak of the whole correlation surface.

    ``blocks``: keys, before, after, width, ``_top`` and ``_left`` of the block, ``_h`` and ``_w`` of the scene.
    Without ``fine`` the shift is in whole pixels and has no confidence.
    """
    blocks.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    scene = [*keys, "_h", "_w"]
    size = F.col("_h"), F.col("_w")

    def strips(rows: DataFrame, parts) -> DataFrame:
        """Parts brought together by strip; the outer generator keeps ``parts`` from being computed twice."""
        each = rows.select(*scene, F.explode_outer(parts).alias("_p"))
        return each.groupBy(*scene, F.col("_p.strip").alias("_strip")).agg(F.collect_list("_p").alias("_parts"))

    lines = strips(blocks, _lines("before", "after", "width", "_top", "_left", "_w"))
    columns = strips(lines, _along_x("_parts", "_strip", *size))
    surface = strips(columns, _along_y("_parts", "_strip", *size, F.lit(fine)))
    # Of equal peaks the first line by line.
    peaks = surface.select(*scene, _peak("_parts", "_strip", *size, F.lit(fine)).alias("_peak")).groupBy(*scene).agg(
        F.min("_peak").alias("_peak"))
    place = F.col("_peak.y"), F.col("_peak.x")
    if not fine:
        return peaks.select(*keys, _whole_shift(*place, *size).alias("shift"))
    # A strip adds 15 x 15 values, so what a scene collects here is a thousandth of it.
    zoomed = columns.join(peaks, scene).select(
        *scene, "_peak", F.struct(F.col("_strip").alias("strip"), _zoom("_parts", "_strip", *size, *place).alias("z")).alias("_z"))
    return zoomed.groupBy(*scene, "_peak").agg(F.collect_list("_z").alias("_strips")).select(
        *keys, _fine_shift("_strips", *place, *size).alias("shift"))
