"""Connected components over an edge table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F, types as T

from scenelake.session import checkpoint

SALTS = 16


def salted_lookup(rows: DataFrame, table: DataFrame, key: str, spread: str, salts: int = SALTS,
                  how: str = "inner") -> DataFrame:
    """Join rows to a table with unique ``key`` when many rows share one key.

    Rows are spread over ``salts`` copies of the table's row by the hash of ``spread``.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    copies = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, [key, "_salt"], how).drop("_salt")


def spread_lookup(rows: DataFrame, table: DataFrame, keys: Sequence[str], how: str = "inner", salts: int = SALTS) -> DataFrame:
    """Join rows to a table with unique ``keys`` (figures of a group) when one group may hold a third of the rows.

    Rows are spread by the hash of their other plain columns over ``salts`` copies
    of the table's row. Both sides are exchanged for the join, whatever grouping
    made them, so groups that are still too large are split at run time.
    """
    plain = [F.col(f"`{f.name}`") for f in rows.schema
             if f.name not in keys and not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
    salt = F.pmod(F.xxhash64(*plain), F.lit(salts)) if plain else F.lit(0)
    salted = rows.withColumn("_salt", salt.cast("int"))
    copies = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, [*keys, "_salt"], how).drop("_salt")


def connected_components(nodes: DataFrame, edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """(node, component) with component = smallest node id reachable.

    ``nodes(node)``; ``edges(src, dst)`` in either direction. Every round hooks
    each node and its parent to the smallest grandparent around it, then
    shortens the paths, so long chains close in about log(length) rounds. Node
    degree must be bounded (cells and block borders are); one parent may own any
    number of nodes, hence the salted lookup. Each round is checkpointed.
    """
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    both = checkpoint(both.where(F.col("src") != F.col("dst")).distinct())
    parents = checkpoint(nodes.select("node", F.col("node").alias("parent")).distinct())
    for _ in range(max_rounds):
        owners = parents.select("parent").distinct()
        grand = owners.join(parents.select(F.col("node").alias("parent"), F.col("parent").alias("grand")), "parent")
        lifted = salted_lookup(parents, grand, "parent", "node")
        around = (both.join(lifted.select(F.col("node").alias("dst"), "grand"), "dst")
                  .groupBy(F.col("src").alias("node")).agg(F.min("grand").alias("least")))
        found = F.coalesce("least", "grand")
        proposal = F.explode(F.array(*[
            F.struct(node.alias("node"), parent.alias("parent"), old.alias("old")) for node, parent, old in (
                (F.col("node"), F.least("parent", "grand", found), F.col("parent")),
                (F.col("parent"), found, F.lit(None)))]))
        merged = checkpoint(lifted.join(around, "node", "left").select(proposal.alias("p")).groupBy("p.node").agg(
            F.min("p.parent").alias("parent"), F.max("p.old").alias("old")))
        changed = merged.where(F.col("parent") != F.col("old")).limit(1).count()
        parents = merged.select("node", "parent")
        if not changed:
            return parents.select("node", F.col("parent").alias("component"))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
