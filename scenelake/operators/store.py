"""Stored tables that take upserts: rows lie in hash buckets of their key, and an upsert rewrites touched buckets only.

A store is a folder of Parquet files partitioned by bucket. New rows are
compared with the stored ones of the same bucket first; buckets in which no row
is newer keep their files, so a repeated upsert changes nothing. The merged
buckets are written to shared storage before they replace the old ones.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.errors import AnalysisException

from scenelake.session import checkpoint

BUCKETS = 64
BUCKET = "_bucket"


def bucket_of(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def latest(rows: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """The row of greatest version per key; equal versions are decided by the row itself, null versions come first."""
    rest = [c for c in rows.columns if c not in keys]
    order = F.struct(version, F.xxhash64(*rest))
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_row")).select(
        *keys, *[F.col("_row")[c].alias(c) for c in rest]).select(*rows.columns)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """All rows of a store, without its bucket column."""
    return spark.read.parquet(path).drop(BUCKET)


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def upsert(rows: DataFrame, path: str, keys: Sequence[str], version: str, buckets: int = BUCKETS) -> list[int]:
    """Merge rows into the store at ``path`` and return the rewritten buckets.

    A row replaces the stored one of its key if its ``version`` is greater;
    a key that the store lacks is added. ``buckets`` must stay what it was when
    the store was made; it bounds the list that is returned. The first upsert
    makes the store.
    """
    keys, spark = list(keys), rows.sparkSession
    fresh = checkpoint(latest(rows, keys, version).withColumn(BUCKET, bucket_of(keys, buckets)))
    old = _stored(spark, path)
    if old is None:
        touched, merged = None, fresh
    else:
        asked = [r[0] for r in fresh.select(BUCKET).distinct().collect()]
        near = old.where(F.col(BUCKET).isin(asked))
        known = near.select(BUCKET, *keys, F.col(version).alias("_known"), F.lit(True).alias("_stored"))
        newer = F.col("_stored").isNull() | F.coalesce(F.col(version) > F.col("_known"), F.col("_known").isNull() & F.col(version).isNotNull())
        effective = checkpoint(fresh.join(known, [BUCKET, *keys], "left").where(newer).select(*fresh.columns))
        touched = sorted(r[0] for r in effective.select(BUCKET).distinct().collect())
        if not touched:
            return []
        kept = old.where(F.col(BUCKET).isin(touched)).join(effective.select(BUCKET, *keys), [BUCKET, *keys], "left_anti")
        # Written before the old files go: they are what it was made from.
        merged = checkpoint(kept.select(*fresh.columns).unionByName(effective))
    merged.repartition(BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)
    return touched if touched is not None else sorted(r[0] for r in fresh.select(BUCKET).distinct().collect())
