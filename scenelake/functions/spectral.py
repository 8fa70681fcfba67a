"""Spectral indices, cloud tests and change predicates on pixel columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from scenelake.functions.mathx import clip
from scenelake.lookups import SCL_CLOUD_CLASSES


def normalized_difference(a: Column, b: Column, eps: float = 1e-8, bounded: bool = True) -> Column:
    """``(a - b) / (a + b + eps)``; bounded: 0 where ``a + b`` is 0, clipped to [-1, 1]."""
    ratio = (a - b) / (a + b + F.lit(eps))
    if not bounded:
        return ratio
    return clip(F.when(a + b != 0, ratio).otherwise(F.lit(0.0)), -1.0, 1.0)


def ndvi(nir: Column, red: Column) -> Column:
    return normalized_difference(nir, red)


def ndwi(green: Column, nir: Column) -> Column:
    return normalized_difference(green, nir)


def band_indices(n_bands: Column, red: Column, green: Column, third: Column, fourth: Column) -> tuple[Column, Column]:
    """(ndvi, ndwi) where near-infrared is the fourth band, or the third of exactly three."""
    nir = F.when(n_bands >= 4, fourth).otherwise(third)
    enough = n_bands >= 3
    veg = normalized_difference(nir, red, 1e-6, bounded=False)
    water = normalized_difference(green, nir, 1e-6, bounded=False)
    return F.when(enough, veg).otherwise(0.0), F.when(enough, water).otherwise(0.0)


def vegetation_proxy(r: Column, g: Column) -> Column:
    """Greenness from visible bands alone."""
    return normalized_difference(g, r, 1e-6, bounded=False)


def water_proxy(r: Column, b: Column) -> Column:
    """Blueness from visible bands alone."""
    return normalized_difference(b, r, 1e-6, bounded=False)


def is_cloud_rgb(r: Column, g: Column, b: Column) -> Column:
    """Bright and nearly grey; reflectances in [0, 1]."""
    brightness = (r + g + b) / 3.0
    spread = F.greatest(r, g, b) - F.least(r, g, b)
    return (brightness > 0.78) & (spread < 0.12)


def is_cloud_scl(scl: Column) -> Column:
    return scl.isin(SCL_CLOUD_CLASSES)


def rgb_distance(r1: Column, g1: Column, b1: Column, r2: Column, g2: Column, b2: Column) -> Column:
    dr, dg, db = r2 - r1, g2 - g1, b2 - b1
    return F.sqrt(dr * dr + dg * dg + db * db)


def month_distance(before: Column, after: Column) -> Column:
    """Absolute month difference (not circular); 0 unless both texts carry a month."""
    m1 = F.try_to_number(F.get(F.split(before, "-"), F.lit(1)), F.lit("99")).cast("int")
    m2 = F.try_to_number(F.get(F.split(after, "-"), F.lit(1)), F.lit("99")).cast("int")
    return F.coalesce(F.abs(m1 - m2), F.lit(0))


def is_phenology(delta_veg: Column, month_diff: Column, tolerance: float = 0.12) -> Column:
    """A mild greenness drop between different seasons."""
    return (month_diff > 2) & (delta_veg > -tolerance) & (delta_veg < 0.0)
