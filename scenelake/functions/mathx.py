"""Numeric helpers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def clip(x: Column, lo: float, hi: float) -> Column:
    """Bound a value; NULL stays NULL (``least`` and ``greatest`` alone would skip it)."""
    return F.when(x.isNotNull(), F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), x)))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def safe_ratio(num: Column, den: Column, default: float = 0.0) -> Column:
    """``num / den``, or ``default`` where the denominator is 0."""
    return F.when(den != 0, num / den).otherwise(F.lit(default))


def round_half_up(x: Column, digits: int) -> Column:
    """Round half up on the product with the power of ten, the same in every SQL engine."""
    scale = float(10 ** digits)
    return F.floor(x * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def _rounded(v: Column, digits: int) -> Column:
    scale = F.lit(float(10 ** digits))
    below = F.floor(v * scale).cast("double")
    high = v * 134217729.0 - (v * 134217729.0 - v)
    over = (high * scale - (below + 0.5)) + (v - high) * scale
    up = (over > 0) | ((over == 0) & (below % 2 != 0))
    return F.when(up, below + 1.0).otherwise(below) / scale


def round_to(x: Column, digits: int) -> Column:
    """Round the exact binary value to ``digits`` decimals, ties to even (up to six decimals).

    The product with the power of ten may itself round onto a tie, so the
    distance to the middle is taken from the two halves of the factor, whose
    products are exact.
    """
    return F.transform(F.array(x.cast("double")), lambda v: _rounded(v, digits))[0]


def round_column(name: str, digits: int) -> Column:
    """``round_to`` of a plain column: nothing to evaluate twice, so no array is made and the code is compiled."""
    return _rounded(F.col(name).cast("double"), digits)


def l2_norm(values: Column) -> Column:
    """Euclidean length of an array of numbers."""
    return F.sqrt(F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v.cast("double") * v.cast("double")))


def hypot(dx: Column, dy: Column) -> Column:
    return F.hypot(dx, dy)


def or_missing(x: Column, falsy) -> Column:
    """NULL where the value is empty or zero, so that a fallback chain skips it."""
    return F.when(x != F.lit(falsy), x)


def bbox_centroid(bbox: Column) -> tuple[Column, Column]:
    """(lat, lon) midpoint of ``[min_lon, min_lat, max_lon, max_lat]``."""
    lat = (F.element_at(bbox, 2) + F.element_at(bbox, 4)) / 2.0
    lon = (F.element_at(bbox, 1) + F.element_at(bbox, 3)) / 2.0
    return lat, lon
