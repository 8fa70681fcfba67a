"""Spatial clusters of alerts: single linkage at a distance ``eps`` in degrees.

Points are first reduced to distinct locations and then to grid cells whose
diagonal is ``eps``, so all points of a cell belong together without a single
pair. Only occupied cells are linked, each to at most 20 others, and whether
two cells touch is decided by narrowing their bounding boxes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from scenelake.functions.mathx import round_to
from scenelake.operators.components import connected_components, salted_lookup
from scenelake.session import checkpoint

REFINE_LEVELS = 5


def _cell(value: str, side: float, level: int) -> Column:
    return F.floor(F.col(value) / F.lit(side / 2 ** level)).cast("bigint")


def with_cell(points: DataFrame, eps: float, keys: Sequence[str] = ()) -> DataFrame:
    """Add ``cell``, an id whose points are pairwise within ``eps``."""
    side = eps / 2 ** 0.5 * (1 - 1e-12)
    parts = [F.col(k).cast("string") for k in keys]
    return points.withColumn("cell", F.concat_ws("/", *parts, _cell("lat", side, 0).cast("string"),
                                                 _cell("lng", side, 0).cast("string")))


def neighbor_cells(points: DataFrame, eps: float, keys: Sequence[str] = ()) -> DataFrame:
    """(src, dst) for occupied cells with at least one point pair within ``eps``.

    Candidate cell pairs are split into quarters of quarters: a pair of parts is
    dropped when its boxes are farther apart than ``eps``, settles its cells when
    all its points must be within, and is split again otherwise. What is still
    open after the last split is compared point by point, which only concerns
    points almost exactly ``eps`` apart.
    """
    keys = list(keys)
    side = eps / 2 ** 0.5 * (1 - 1e-12)
    spots = checkpoint(with_cell(points, eps, keys).select(
        *keys, "cell", "lat", "lng", _cell("lat", side, 0).alias("cy"), _cell("lng", side, 0).alias("cx")).distinct())

    def parts(level: int) -> DataFrame:
        return spots.groupBy(*keys, "cell", "cy", "cx", _cell("lat", side, level).alias("py"),
                             _cell("lng", side, level).alias("px")).agg(
            F.min("lat").alias("a0"), F.max("lat").alias("a1"), F.min("lng").alias("o0"), F.max("lng").alias("o1"))

    def renamed(df: DataFrame, tag: str) -> DataFrame:
        return df.select(*[F.col(c).alias(f"{tag}_{c}") for c in ("cell", "py", "px", "a0", "a1", "o0", "o1")])

    around = [(dy, dx) for dy in range(-2, 3) for dx in range(-2, 3) if (dy, dx) > (0, 0)]
    cells = parts(0)
    ahead = cells.withColumn("_s", F.explode(F.array(*[
        F.struct(F.lit(dy).alias("y"), F.lit(dx).alias("x")) for dy, dx in around])))
    ahead = ahead.select(*keys, (F.col("cy") + F.col("_s.y")).alias("cy"), (F.col("cx") + F.col("_s.x")).alias("cx"),
                         *[F.col(c).alias(f"s_{c}") for c in ("cell", "py", "px", "a0", "a1", "o0", "o1")])
    other = cells.select(*keys, "cy", "cx", *[F.col(c).alias(f"d_{c}")
                                              for c in ("cell", "py", "px", "a0", "a1", "o0", "o1")])
    pairs = ahead.join(other, [*keys, "cy", "cx"]).drop("cy", "cx", *keys)

    def gap(lo1: str, hi1: str, lo2: str, hi2: str) -> Column:
        return F.greatest(F.lit(0.0), F.col(lo2) - F.col(hi1), F.col(lo1) - F.col(hi2))

    def reach(lo1: str, hi1: str, lo2: str, hi2: str) -> Column:
        return F.greatest(F.col(hi2) - F.col(lo1), F.col(hi1) - F.col(lo2))

    lat, lng = ("s_a0", "s_a1", "d_a0", "d_a1"), ("s_o0", "s_o1", "d_o0", "d_o1")
    nearest = F.sqrt(F.pow(gap(*lat), 2) + F.pow(gap(*lng), 2))
    farthest = F.sqrt(F.pow(reach(*lat), 2) + F.pow(reach(*lng), 2))
    links = None
    for level in range(1, REFINE_LEVELS + 1):
        open_pairs = checkpoint(pairs.where(nearest <= eps).withColumn("_sure", farthest <= eps))
        sure = open_pairs.where("_sure").select(F.col("s_cell").alias("src"), F.col("d_cell").alias("dst")).distinct()
        links = sure if links is None else links.unionByName(sure)
        if not open_pairs.where("not _sure").limit(1).count():
            return links.distinct()
        rest = (open_pairs.where("not _sure")
                .join(links.select(F.col("src").alias("s_cell"), F.col("dst").alias("d_cell")).distinct(),
                      ["s_cell", "d_cell"], "left_anti"))
        finer = parts(level)
        s = renamed(finer, "n").withColumn("s_py", F.expr("shiftright(n_py, 1)")).withColumn(
            "s_px", F.expr("shiftright(n_px, 1)")).withColumnRenamed("n_cell", "s_cell")
        d = renamed(finer, "m").withColumn("d_py", F.expr("shiftright(m_py, 1)")).withColumn(
            "d_px", F.expr("shiftright(m_px, 1)")).withColumnRenamed("m_cell", "d_cell")
        split = (rest.select("s_cell", "s_py", "s_px", "d_cell", "d_py", "d_px")
                 .join(s, ["s_cell", "s_py", "s_px"]).join(d, ["d_cell", "d_py", "d_px"]))
        pairs = split.select("s_cell", "d_cell", *[F.col(f"{old}_{c}").alias(f"{new}_{c}")
                                                   for old, new in (("n", "s"), ("m", "d"))
                                                   for c in ("py", "px", "a0", "a1", "o0", "o1")])
    last = spots.select("cell", "lat", "lng", _cell("lat", side, REFINE_LEVELS).alias("py"),
                        _cell("lng", side, REFINE_LEVELS).alias("px"))
    s = last.select(*[F.col(c).alias(f"s_{c}") for c in last.columns])
    d = last.select(*[F.col(c).alias(f"d_{c}") for c in last.columns])
    tight = (pairs.where(nearest <= eps).select("s_cell", "s_py", "s_px", "d_cell", "d_py", "d_px")
             .join(s, ["s_cell", "s_py", "s_px"]).join(d, ["d_cell", "d_py", "d_px"])
             .where(F.hypot(F.col("s_lat") - F.col("d_lat"), F.col("s_lng") - F.col("d_lng")) <= eps)
             .select(F.col("s_cell").alias("src"), F.col("d_cell").alias("dst")))
    return links.unionByName(tight).distinct()


def spatial_clusters(points: DataFrame, eps: float, keys: Sequence[str] = (), ident: str = "alert_id") -> DataFrame:
    """Add ``cluster``, the smallest member id of the linked group."""
    placed = with_cell(points, eps, keys)
    cells = placed.groupBy("cell").agg(F.min(ident).alias("_least"))
    comps = connected_components(cells.select(F.col("cell").alias("node")), neighbor_cells(points, eps, keys))
    named = cells.join(comps.withColumnRenamed("node", "cell"), "cell")
    least = named.groupBy("component").agg(F.min("_least").alias("cluster"))
    lookup = named.select("cell", "component").join(least, "component").select("cell", "cluster")
    return salted_lookup(placed, lookup, "cell", ident).drop("cell")


def cluster_summary(members: DataFrame, margin: float = 0.008, min_size: int = 2, keys: Sequence[str] = ()
                    ) -> DataFrame:
    """Centre, size, mean confidence and bounds per cluster; groups below ``min_size`` are noise."""
    return (members.groupBy(*keys, "cluster").agg(
        # Published centres of known clusters round ties to even.
        F.bround(F.avg("lat"), 5).alias("center_lat"), F.bround(F.avg("lng"), 5).alias("center_lng"),
        F.count("*").alias("member_count"),
        round_to(F.avg(F.coalesce("confidence", F.lit(0.90))), 2).alias("confidence"),
        (F.min("lat") - margin).alias("min_lat"), (F.min("lng") - margin).alias("min_lng"),
        (F.max("lat") + margin).alias("max_lat"), (F.max("lng") + margin).alias("max_lng"))
        .where(F.col("member_count") >= min_size))


def clusters_or_fallback(points: DataFrame, members: DataFrame, ident: str = "alert_id") -> DataFrame:
    """Cluster summaries, or one wide cluster of all points when there is none."""
    found = cluster_summary(members)
    every = points.agg(F.min(ident).alias("cluster"))
    empty = found.agg((F.count("*") == 0).alias("is_empty")).scalar()
    whole = (points.withColumn("cluster", F.lit(1))
             .transform(lambda d: cluster_summary(d, margin=0.01, min_size=1)).drop("cluster")
             .where(empty).withColumn("cluster", every.scalar()))
    whole = whole.withColumn("confidence", F.when(F.col("member_count") < 2, F.lit(0.92)).otherwise(F.col("confidence")))
    return found.unionByName(whole)


def cluster_number(clusters: DataFrame) -> DataFrame:
    """Number clusters by their smallest member: ``cluster_id`` and ``cluster_name``.

    Clusters are range-partitioned and fixed by a checkpoint; a partition's
    offset comes from the counts of the partitions before it.
    """
    ordered = checkpoint(clusters.repartitionByRange("cluster").sortWithinPartitions("cluster"))
    low = (1 << 33) - 1
    tagged = (ordered.withColumn("_m", F.monotonically_increasing_id())
              .withColumn("_part", F.shiftright("_m", 33)).withColumn("_row", F.col("_m").bitwiseAND(F.lit(low))))
    sizes = tagged.groupBy("_part").agg(F.count("*").alias("_c"))
    offsets = sizes.select("_part", F.expr(
        "coalesce(sum(_c) over (partition by 0 order by _part rows between unbounded preceding and 1 preceding), 0)")
        .alias("_offset"))
    number = (F.col("_offset") + F.col("_row") + 1).cast("string")
    padded = F.when(F.length(number) < 2, F.concat(F.lit("0"), number)).otherwise(number)
    return (tagged.join(offsets, "_part").withColumn("cluster_id", F.concat(F.lit("cluster_"), padded))
            .withColumn("cluster_name", F.concat(F.lit("Spatial Activity Cluster #"), padded))
            .drop("_m", "_part", "_row", "_offset"))


def cluster_types(members: DataFrame, ident: str = "alert_id", kind: str = "type", n: int = 3) -> DataFrame:
    """The first ``n`` distinct types of each cluster, in member order."""
    firsts = members.groupBy("cluster", kind).agg(F.min(ident).alias("_first"))
    rank = F.row_number().over(W.partitionBy("cluster").orderBy("_first", kind))
    top = firsts.withColumn("_rank", rank).where(F.col("_rank") <= n)
    ordered = F.array_sort(F.collect_list(F.struct("_rank", kind)))
    return top.groupBy("cluster").agg(ordered.alias("_t")).select("cluster", F.col("_t")[kind].alias("types"))
