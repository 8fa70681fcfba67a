"""Radiometric statistics and normalisation.

Statistics are aggregated per key and joined back to blocks, so that a key may
cover one block or a whole scene; the per-value arithmetic stays in the arrays.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from scenelake.functions.mathx import clip
from scenelake.operators.components import spread_lookup
from scenelake.operators.ranks import grouped_cdf, grouped_quantiles
from scenelake.operators.scenes import is_blocked

# Ranges of the cumulative share in which two distributions are merged.
SHARE_BUCKETS = 64


def tile_stats(pixels: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Per key over all bands: count, population std, min, max and the shares equal to min and max.

    Values are counted once per distinct value, so the shares need no second scan.
    """
    every = F.explode(F.array(*[F.col(v) for v in values])).alias("v")
    counts = pixels.select(*keys, every).groupBy(*keys, "v").agg(F.count("*").alias("c"))
    total = F.sum("c")
    whole = counts.groupBy(*keys).agg(
        total.alias("n"), (F.sum(F.col("v") * F.col("c")) / total).alias("_mean"),
        F.min("v").alias("v_min"), F.max("v").alias("v_max"),
        (F.min_by("c", "v") / total).alias("share_min"), (F.max_by("c", "v") / total).alias("share_max"))
    # Squares of deviations: squares of the values would cancel where the mean is large.
    away = F.col("v") - F.col("_mean")
    spread = spread_lookup(counts, whole.select(*keys, "_mean"), keys).groupBy(*keys).agg(
        F.sqrt(F.sum(away * away * F.col("c")) / total).alias("std"))
    return whole.join(spread, list(keys)).select(*keys, "n", "std", "v_min", "v_max", "share_min", "share_max")


def is_valid_tile(std: Column, v_max: Column, share_min: Column, share_max: Column, min_std: float = 4.0,
                  max_blank: float = 0.95) -> Column:
    """Enough contrast, and neither extreme value fills the tile."""
    needed = F.when(v_max <= 1.0, F.lit(min_std / 255.0)).otherwise(F.lit(min_std))
    return (std >= needed) & (share_min <= max_blank) & (share_max <= max_blank)


def percentile_stretch(pixels: DataFrame, keys: Sequence[str], value: str, lower: float = 0.02,
                       upper: float = 0.98, out: str = "stretched") -> DataFrame:
    """Clip values between two exact percentiles of their key to [0, 1]; flat keys give 0.

    8-bit values are only scaled by 255. Small integers have few distinct values,
    so the built-in percentile is bounded there; other types use the bucketed one.
    """
    kind = pixels.schema[value].dataType
    if isinstance(kind, T.ByteType):
        return pixels.withColumn(out, F.pmod(F.col(value).cast("int"), F.lit(256)) / 255.0)
    if isinstance(kind, T.ShortType):
        both = F.percentile(value, F.array(F.lit(lower), F.lit(upper)))
        limits = pixels.groupBy(*keys).agg(both.alias("_b")).select(
            *keys, F.col("_b")[0].alias("_lo"), F.col("_b")[1].alias("_hi"))
    else:
        limits = grouped_quantiles(pixels, keys, value, [lower, upper], ["_lo", "_hi"])
    scaled = clip((F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")), 0.0, 1.0)
    return (spread_lookup(pixels, limits, keys)
            .withColumn(out, F.when(F.col("_hi") > F.col("_lo"), scaled).otherwise(F.lit(0.0)))
            .drop("_lo", "_hi"))


def _moments(blocks: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Mean ``m_c`` and population std ``s_c`` per key of each array column ``c``."""
    flat = blocks.select(*keys, F.explode(F.arrays_zip(*columns)).alias("_px"))
    stats = [agg for c in columns
             for agg in (F.avg(F.col("_px")[c]).alias(f"m_{c}"), F.stddev_pop(F.col("_px")[c]).alias(f"s_{c}"))]
    return flat.groupBy(*keys).agg(*stats)


def _with_moments(blocks: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Blocks with the moments of their key; a scene of many blocks is spread."""
    moments = _moments(blocks, keys, columns)
    return spread_lookup(blocks, moments, keys) if is_blocked(blocks) else blocks.join(moments, list(keys))


def radiometric_align(blocks: DataFrame, keys: Sequence[str], bands: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Give later bands the mean and spread of the earlier ones, where both have contrast.

    ``bands`` lists (before, after, out) array columns; all statistics come from
    one aggregation and one join.
    """
    columns = [c for before, after, _ in bands for c in (before, after)]
    joined = _with_moments(blocks, keys, columns)

    def aligned(before: str, after: str) -> Column:
        m1, s1, m2, s2 = (F.col(f"{p}_{c}") for c in (before, after) for p in ("m", "s"))
        moved = F.transform(F.col(after), lambda v: ((v - m2) / s2) * s1 + m1)
        return F.when((s1 > 1e-4) & (s2 > 1e-4), moved).otherwise(F.col(after))

    outs = [out for _, _, out in bands]
    kept = [c for c in blocks.columns if c not in outs]
    return joined.select(*kept, *[aligned(b, a).alias(out) for b, a, out in bands])


def domain_standardize(blocks: DataFrame, keys: Sequence[str], value: str | Sequence[str], out: str | Sequence[str],
                       mean: float = 0.15, std: float = 0.10) -> DataFrame:
    """Shift a band to the reference mean and spread, then clip to [0, 1].

    Several bands, with as many names for ``out``, share one aggregation and one
    join. Blocks whose key has no value of a band at all are left out.
    """
    bands = [(value, out)] if isinstance(value, str) else list(zip(value, out, strict=True))
    columns = [c for c, _ in bands]
    filled = blocks.select(*keys, *[F.coalesce(c, F.array().cast(blocks.schema[c].dataType)).alias(c) for c in columns])
    flat = filled.select(*keys, *[(F.size(c) > 0).alias(f"_has_{c}") for c in columns], F.explode(F.arrays_zip(*columns)).alias("_px"))
    moments = flat.groupBy(*keys).agg(*[agg for c in columns for agg in (
        F.avg(F.col("_px")[c]).alias(f"m_{c}"), F.stddev_pop(F.col("_px")[c]).alias(f"s_{c}"), F.bool_or(f"_has_{c}").alias(f"_has_{c}"))])
    for c in columns:
        moments = moments.where(f"`_has_{c}`")
    moments = moments.select(*keys, *[f"{p}_{c}" for c in columns for p in "ms"])
    joined = spread_lookup(blocks, moments, keys) if is_blocked(blocks) else blocks.join(moments, list(keys))

    def shifted(c: str) -> Column:
        m, s = F.col(f"m_{c}"), F.col(f"s_{c}")
        return F.transform(F.col(c), lambda v: clip(F.when(s > 1e-6, (v - m) / s * std + mean).otherwise(v), 0.0, 1.0))

    return joined.withColumns({o: shifted(c) for c, o in bands}).drop(*[f"{p}_{c}" for c in columns for p in "ms"])


def histogram_match(source: DataFrame, reference: DataFrame, keys: Sequence[str], value: str,
                    out: str = "matched", buckets: int = SHARE_BUCKETS) -> DataFrame:
    """Replace each source value by the reference value at the same cumulative share.

    Shares between two reference points are interpolated linearly and clamped at
    the ends. Both curves are merged inside buckets of the share; the nearest
    reference point of an earlier or later bucket is carried over bucket totals.
    """
    keys = list(keys)
    bucket = F.least(F.lit(buckets - 1), F.floor(F.col("q") * buckets).cast("int")).alias("_b")
    point = F.struct(F.col("q"), F.col(value).alias("v"))
    sides = source.select(*keys, value, F.lit(True).alias("_source")).unionByName(
        reference.select(*keys, value, F.lit(False).alias("_source")))
    curves = grouped_cdf(sides, [*keys, "_source"], value).select(*keys, value, "q", bucket, "_source")
    src, ref = curves.where("_source").drop("_source"), curves.where(~F.col("_source")).drop("_source")
    merged = (src.select(*keys, "_b", "q", value, F.lit(None).cast("struct<q:double,v:double>").alias("_r"))
              .unionByName(ref.select(*keys, "_b", "q", F.lit(None).cast("double").alias(value), point.alias("_r"))))
    totals = merged.groupBy(*keys, "_b").agg(F.min("_r").alias("_first"), F.max("_r").alias("_last"))
    along = W.partitionBy(*keys).orderBy("_b")
    totals = totals.select(
        *keys, "_b",
        F.last("_last", ignorenulls=True).over(along.rowsBetween(W.unboundedPreceding, -1)).alias("_before"),
        F.first("_first", ignorenulls=True).over(along.rowsBetween(1, W.unboundedFollowing)).alias("_after"))
    inner = W.partitionBy(*keys, "_b").orderBy("q")
    merged = (merged
              .withColumn("_lo", F.last("_r", ignorenulls=True).over(inner.rangeBetween(W.unboundedPreceding, 0)))
              .withColumn("_hi", F.first("_r", ignorenulls=True).over(inner.rangeBetween(0, W.unboundedFollowing)))
              .where(F.col("_r").isNull())
              .join(totals, [*keys, "_b"])
              .withColumn("_lo", F.coalesce("_lo", "_before")).withColumn("_hi", F.coalesce("_hi", "_after")))
    lo, hi, q = F.col("_lo"), F.col("_hi"), F.col("q")
    between = lo["v"] + (hi["v"] - lo["v"]) * (q - lo["q"]) / (hi["q"] - lo["q"])
    mapped = (F.when(lo.isNull(), hi["v"]).when(hi.isNull(), lo["v"]).when(hi["q"] == lo["q"], lo["v"])
              .otherwise(between))
    mapping = merged.select(*keys, value, mapped.alias(out))
    return source.withColumn(value, F.col(value).cast("double")).join(mapping, [*keys, value])


def block_resample_nearest(pixels: DataFrame, keys: Sequence[str], height: str, width: str, value: str,
                           source_gsd: float, target_gsd: float, jitter_seed: int | None = None) -> DataFrame:
    """Nearest-neighbour resampling to a target ground sample distance.

    Output pixel ``i`` of ``n`` reads source index ``int(i * (size - 1) / (n - 1))``.
    ``jitter_seed`` varies the target by up to 15 %, once for the job.
    """
    if source_gsd <= 0 or target_gsd <= 0:
        raise ValueError("ground sample distances must be positive")
    if jitter_seed is not None:
        import random
        target_gsd *= random.Random(jitter_seed).uniform(0.85, 1.15)
    scale = source_gsd / target_gsd
    if abs(scale - 1.0) < 1e-3:
        return pixels.select(*keys, "y", "x", value)
    new = {n: F.greatest(F.lit(1), F.bround(F.col(n) * F.lit(scale)).cast("int")) for n in (height, width)}

    def targets(pos: str, size: str, count: Column) -> Column:
        """All output indexes that read source index ``pos``."""
        step = F.when(count > 1, (F.col(size) - 1) / (count - 1)).otherwise(F.lit(0.0))
        near = F.when(step > 0, F.floor(F.col(pos) / step).cast("int")).otherwise(F.lit(0))
        reach = F.when(step > 0, F.ceil(1 / step).cast("int") + 1).otherwise(F.lit(0))
        candidates = F.sequence(F.greatest(F.lit(0), near - 1), F.greatest(F.lit(0), F.least(count - 1, near + reach)))
        # The last output index always reads the last source index.
        def reads(i: Column) -> Column:
            return F.when((count > 1) & (i == count - 1), F.col(size) - 1).otherwise(F.floor(i * step).cast("int"))

        return F.filter(candidates, lambda i: (i < count) & (reads(i) == F.col(pos)))

    grown = pixels.select(*keys, "y", "x", height, width, value,
                          F.explode(targets("y", height, new[height])).alias("_y"))
    grown = grown.select(*keys, "_y", "x", width, value, F.explode(targets("x", width, new[width])).alias("_x"))
    return grown.select(*keys, F.col("_y").alias("y"), F.col("_x").alias("x"), value)


def block_resample_area(pixels: DataFrame, keys: Sequence[str], value: str, factor: int) -> DataFrame:
    """Coarsen by averaging ``factor`` x ``factor`` cells."""
    cell = [F.floor(F.col(c) / factor).cast("int").alias(c) for c in ("y", "x")]
    return pixels.groupBy(*keys, *cell).agg(F.avg(value).alias(value))
