"""Session defaults and the reliable checkpoint folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

# Relied on by the operators: hot join keys are split at run time, small
# partitions are merged, sessions combine before their shuffle, checkpoints go
# with their tables, and all date arithmetic is done in UTC.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
}


def build_session(app: str = "scenelake", master: str | None = None, **conf: str) -> SparkSession:
    """Create a session with the defaults; ``conf`` keys use ``_`` for ``.``-free overrides."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder, setting it only where none is named.

    A cluster must name shared storage in ``spark.checkpoint.dir``; a private
    temporary folder is used in local mode alone, where driver and executors
    share one disk.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        named = tempfile.mkdtemp(prefix="scenelake-checkpoint-")
    sc.setCheckpointDir(named)
    return named


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage through the reliable checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
