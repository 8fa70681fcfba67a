"""Neighbouring acquisitions in time without one window per site.

A window over a whole site would send the busiest site to one task. Rows are
windowed inside (site, time bucket); the first row of each later bucket is
carried back through the much smaller list of buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from scenelake.operators.components import spread_lookup


def with_next(df: DataFrame, keys: Sequence[str], order: Sequence[str], payload: Sequence[str],
              bucket: Column) -> DataFrame:
    """Add ``next``: the payload struct of the following row per key, NULL on the last.

    ``bucket`` must not decrease along ``order`` (for instance the day of the timestamp).
    """
    keys, order = list(keys), list(order)
    rows = df.withColumn("_bucket", bucket)
    inner = W.partitionBy(*keys, "_bucket").orderBy(*order)
    item = F.struct(*payload)
    rows = rows.withColumn("_next", F.lead(item).over(inner))
    heads = rows.groupBy(*keys, "_bucket").agg(F.min_by(item, F.struct(*order)).alias("_head"))
    over_buckets = W.partitionBy(*keys).orderBy("_bucket")
    heads = heads.select(*keys, "_bucket", F.lead("_head").over(over_buckets).alias("_carry"))
    return (rows.join(heads, [*keys, "_bucket"], "left")
            .withColumn("next", F.coalesce("_next", "_carry")).drop("_bucket", "_next", "_carry"))


def scene_pairs(acquisitions: DataFrame, site: str, ts: str, payload: Sequence[str], tie: Sequence[str] = (),
                bucket: Column | None = None) -> DataFrame:
    """Each acquisition with the next of its site: columns of the first, plus struct ``next``."""
    bucket = F.to_date(ts) if bucket is None else bucket
    return with_next(acquisitions, [site], [ts, *tie], [ts, *payload], bucket).where(F.col("next").isNotNull())


def date_confidence(pairs: DataFrame, site: str, ts: str, min_confidence: float = 0.70,
                    min_coverage: float = 0.75) -> DataFrame:
    """One row per pair: both dates, the later date's evidence, and whether it is supported.

    ``pairs.next`` must hold ``confidence`` and ``qa_coverage`` (missing coverage counts as 1).
    """
    conf = F.coalesce(F.col("next.confidence"), F.lit(0.0))
    cover = F.coalesce(F.col("next.qa_coverage"), F.lit(1.0))
    return pairs.select(
        site, F.col(ts).alias("t1_date"), F.col(f"next.{ts}").alias("t2_date"), conf.alias("confidence"),
        cover.alias("qa_coverage"), ((conf >= min_confidence) & (cover >= min_coverage)).alias("is_valid_change"))


def earliest_supported(acquisitions: DataFrame, evidence: DataFrame, site: str) -> DataFrame:
    """Per site: the date of the first supported pair (NULL with fewer than two acquisitions)."""
    found = evidence.groupBy(site).agg(
        F.min(F.when(F.col("is_valid_change"), F.col("t2_date"))).alias("earliest_supported_date"),
        F.count("*").alias("n_pairs"))
    sites = acquisitions.select(site).distinct()
    return (sites.join(found, site, "left")
            .select(site, "earliest_supported_date", F.coalesce("n_pairs", F.lit(0)).alias("n_pairs")))


def seasonal_moments(df: DataFrame, site: str, ts: str, value: str) -> DataFrame:
    """Per site and calendar month: number, mean and sum of squared deviations of the values.

    A small table that is kept and merged with that of new acquisitions, so history is not read again.
    """
    known = df.where(F.col(value).isNotNull()).withColumn("month", F.month(ts))
    return known.groupBy(site, "month").agg(
        F.count("*").alias("n"), F.avg(value).alias("mean"), (F.var_pop(value) * F.count("*")).alias("m2"))


def merge_moments(kept: DataFrame, new: DataFrame, site: str) -> DataFrame:
    """Moments of two disjoint sets of acquisitions together (pairwise update of means and squared deviations)."""
    parts = kept.unionByName(new)
    n, mean = F.sum("n"), F.sum(F.col("n") * F.col("mean")) / F.sum("n")
    whole = parts.groupBy(site, "month").agg(n.alias("_n"), mean.alias("_mean"))
    away = F.col("mean") - F.col("_mean")
    return parts.join(whole, [site, "month"]).groupBy(site, "month").agg(
        F.first("_n").alias("n"), F.first("_mean").alias("mean"), F.sum(F.col("m2") + F.col("n") * away * away).alias("m2"))


def seasonal_scores(df: DataFrame, moments: DataFrame, site: str, ts: str, value: str, limit: float = 2.0) -> DataFrame:
    """Deviation of each value from the moments of its (site, calendar month) in standard deviations."""
    base = moments.select(site, "month", F.col("mean").alias("_m"), F.sqrt(F.col("m2") / F.col("n")).alias("_s"))
    rows = spread_lookup(df.withColumn("month", F.month(ts)), base, [site, "month"])
    z = F.when(F.col("_s") > 1e-9, (F.col(value) - F.col("_m")) / F.col("_s")).otherwise(F.lit(0.0))
    return rows.withColumn("z", z).withColumn("is_anomaly", F.abs("z") > limit).drop("_m", "_s")


def seasonal_zscore(df: DataFrame, site: str, ts: str, value: str, limit: float = 2.0) -> DataFrame:
    """The same over one table, from its own moments; months without any value are left out."""
    return seasonal_scores(df, seasonal_moments(df, site, ts, value), site, ts, value, limit)
