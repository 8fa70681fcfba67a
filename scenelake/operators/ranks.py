"""Order statistics that survive a hot group.

A window over a whole group would put a group holding a third of all rows into
one task. Here each group is cut into value buckets by counts that combine
before the shuffle; only the few bucket totals of a group are ever ordered
together, and exact work happens inside one bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from scenelake.operators.components import spread_lookup
from scenelake.session import checkpoint

BUCKETS = 1024
BUCKET_ROWS = 512
# Rows ordered together in one task, and how often ranges are cut to get there.
ORDERED_ROWS = 100_000
MAX_LEVELS = 6


def _value_bucket(value: Column, lo: Column, hi: Column, size: Column, buckets: int) -> Column:
    """Monotone bucket number of a value in [lo, hi]; small groups get few buckets, large ones ``buckets``."""
    count = F.greatest(F.lit(1), F.least(F.lit(buckets), F.ceil(size / F.lit(float(BUCKET_ROWS)))))
    share = (value - lo) / (hi - lo)
    return F.when(hi > lo, F.least(count - 1, F.floor(share * count))).otherwise(F.lit(0)).cast("int")


def _is_open(rows: Column, lo: Column, hi: Column) -> Column:
    return (rows > ORDERED_ROWS) & (lo < hi)


def grouped_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float],
                      names: Sequence[str], buckets: int = BUCKETS) -> DataFrame:
    """Exact linearly interpolated quantiles per group.

    Each level narrows every wanted rank to one of ``buckets`` value ranges of
    the range before. One level is enough unless outliers leave most of a group
    in one range; ranges are then cut again, between their own smallest and
    largest values, until at most ``ORDERED_ROWS`` rows are ordered together.
    """
    keys = list(keys)
    rows = df.select(*keys, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    rows = rows.withColumn("_path", F.lit(0).cast("bigint"))
    bounds = rows.groupBy(*keys, "_path").agg(F.count("*").alias("_size"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    wanted = F.array(*[F.struct(F.lit(i).alias("p"), F.lit(side).alias("side"),
                                (F.floor if side == "lo" else F.ceil)(F.lit(float(p)) * (F.col("_size") - 1))
                                .cast("bigint").alias("rank"))
                       for i, p in enumerate(probs) for side in ("lo", "hi")])
    targets = (bounds.select(*keys, F.col("_size").alias("_n"), F.explode(wanted).alias("t"))
               .select(*keys, "_n", F.col("t.p").alias("_p"), F.col("t.side").alias("_side"),
                       F.col("t.rank").alias("_rank"), F.lit(0).cast("bigint").alias("_path")))
    for level in range(MAX_LEVELS):
        bucket = _value_bucket(F.col("_v"), F.col("_lo"), F.col("_hi"), F.col("_size"), buckets)
        rows = (spread_lookup(rows, bounds, [*keys, "_path"])
                .select(*keys, "_v", "_path", (F.col("_path") * buckets + bucket).alias("_next")))
        hist = rows.groupBy(*keys, "_path", "_next").agg(F.count("*").alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        ordered = W.partitionBy(*keys, "_path").orderBy("_next")
        hist = hist.withColumn("_start", F.sum("_c").over(ordered) - F.col("_c"))
        inside = (F.col("_rank") >= F.col("_start")) & (F.col("_rank") < F.col("_start") + F.col("_c"))
        found = targets.join(hist, [*keys, "_path"]).where(inside)
        targets = found.select(*keys, "_n", "_p", "_side", (F.col("_rank") - F.col("_start")).alias("_rank"), F.col("_next").alias("_path"))
        bounds = found.select(*keys, F.col("_next").alias("_path"), F.col("_c").alias("_size"), "_lo", "_hi").distinct()
        rows = spread_lookup(rows.select(*keys, "_v", F.col("_next").alias("_path")), bounds.select(*keys, "_path"),
                             [*keys, "_path"], "left_semi")
        if not bounds.where(_is_open(F.col("_size"), F.col("_lo"), F.col("_hi"))).limit(1).count():
            break
        rows, targets, bounds = checkpoint(rows), checkpoint(targets), checkpoint(bounds)  # else plans would nest
    counts = rows.groupBy(*keys, "_path", "_v").agg(F.count("*").alias("_c"))
    ordered = W.partitionBy(*keys, "_path").orderBy("_v")
    counts = counts.withColumn("_start", F.sum("_c").over(ordered) - F.col("_c"))
    inside = (F.col("_rank") >= F.col("_start")) & (F.col("_rank") < F.col("_start") + F.col("_c"))
    found = targets.join(counts, [*keys, "_path"]).where(inside)
    out = []
    for i, (p, name) in enumerate(zip(probs, names)):
        lo = F.max(F.when((F.col("_p") == i) & (F.col("_side") == "lo"), F.col("_v")))
        hi = F.max(F.when((F.col("_p") == i) & (F.col("_side") == "hi"), F.col("_v")))
        pos = F.lit(float(p)) * (F.max("_n") - 1)
        out.append((lo + (hi - lo) * (pos - F.floor(pos))).alias(name))
    return found.groupBy(*keys).agg(*out)


def grouped_cdf(df: DataFrame, keys: Sequence[str], value: str, buckets: int = BUCKETS) -> DataFrame:
    """Per group and distinct value: count and the share of values up to it (``q``)."""
    keys = list(keys)
    counts = (df.groupBy(*keys, F.col(value).cast("double").alias(value)).agg(F.count("*").alias("n"))
              .withColumn("_path", F.lit(0).cast("bigint")))
    for level in range(MAX_LEVELS):
        bounds = counts.groupBy(*keys, "_path").agg(
            F.count("*").alias("_size"), F.min(value).alias("_lo"), F.max(value).alias("_hi"))
        if not bounds.where(_is_open(F.col("_size"), F.col("_lo"), F.col("_hi"))).limit(1).count():
            break
        bucket = _value_bucket(F.col(value), F.col("_lo"), F.col("_hi"), F.col("_size"), buckets)
        counts = checkpoint(spread_lookup(counts, bounds, [*keys, "_path"]).select(
            *keys, value, "n", (F.col("_path") * buckets + bucket).alias("_path")))
    hist = counts.groupBy(*keys, "_path").agg(F.sum("n").alias("_c"))
    ordered, whole = W.partitionBy(*keys).orderBy("_path"), W.partitionBy(*keys)
    hist = hist.select(*keys, "_path", (F.sum("_c").over(ordered) - F.col("_c")).alias("_start"), F.sum("_c").over(whole).alias("_total"))
    running = F.sum("n").over(W.partitionBy(*keys, "_path").orderBy(value))
    return (counts.withColumn("_run", running).join(hist, [*keys, "_path"])
            .select(*keys, value, "n", ((F.col("_start") + F.col("_run")) / F.col("_total")).alias("q")))


def lowest_n(df: DataFrame, order: str, n: Column, hash_hex: str) -> DataFrame:
    """The ``n`` rows of smallest hash, exactly, without a global sort.

    ``hash_hex`` is a uniform hex hash column; ``n`` is an expression over the
    total ``_total``. Rows are counted by the first four hex digits; only rows
    that share the digits of the cut are ordered.
    """
    tagged = df.withColumn("_h4", F.substring(hash_hex, 1, 4))
    hist = tagged.groupBy("_h4").agg(F.count("*").alias("_c"))
    everything = W.partitionBy(F.lit(0)).orderBy("_h4")
    hist = (hist.withColumn("_total", F.sum("_c").over(W.partitionBy(F.lit(0))))
            .withColumn("_start", F.sum("_c").over(everything) - F.col("_c"))
            .withColumn("_need", n - F.col("_start"))
            .where(F.col("_need") > 0))
    marked = tagged.join(F.broadcast(hist.select("_h4", "_need", "_c")), "_h4")
    whole = marked.where(F.col("_need") >= F.col("_c"))
    cut = marked.where(F.col("_need") < F.col("_c"))
    rank = F.row_number().over(W.partitionBy("_h4").orderBy(hash_hex, order))
    cut = cut.withColumn("_rank", rank).where(F.col("_rank") <= F.col("_need")).drop("_rank")
    return whole.unionByName(cut).drop("_h4", "_need", "_c")
