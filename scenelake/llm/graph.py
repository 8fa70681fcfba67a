"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from scenelake.llm.common import materialise, split_join


def _least(edges: DataFrame) -> DataFrame:
    """(node, least): the smallest of a node and its neighbours in column ``b``; combined before the shuffle."""
    return edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select(
        "node", F.least("node", "b").alias("least"))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges(a, b)``; root is the smallest node reachable.

    Large stars hang the bigger neighbours of a node on its smallest one, small
    stars do the same with the smaller neighbours. The two together never grow
    the edge set and close any shape, chains included, in about log² rounds. A
    node of high degree is only a join key here, which adaptive execution
    splits (``split_join``); no group is gathered. Every round is written to shared storage.
    """
    current = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where(
        F.col("a") != F.col("b")).distinct())
    before = None
    for _ in range(max_rounds):
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = split_join(both, _least(both).withColumnRenamed("node", "a"), "a").where(F.col("b") > F.col("a")).select(
            F.col("b").alias("a"), F.col("least").alias("b")).distinct()
        least = _least(large)
        # a hangs on its least neighbour, and so do the other smaller neighbours of a
        small = split_join(large, least.withColumnRenamed("node", "a"), "a").select(
            F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("least").alias("b")),
                              F.struct(F.col("b").alias("a"), F.col("least").alias("b")))).alias("e")).select(
            "e.a", "e.b").where(F.col("a") != F.col("b")).distinct()
        current = materialise(small)
        now = tuple(current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            roots = current.select(F.col("a").alias("node"), F.col("b").alias("root"))
            return roots.unionByName(current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
