"""Scenes of many blocks.

A table is blocked if it carries ``block_row``, ``block_col`` and ``block_size``
beside its arrays; several rows then share the keys of one scene. Figures of a
scene are combined from per-row scalars, so arrays never move for them; one
shift per scene is found at full resolution and applied by position.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from scenelake.operators.components import spread_lookup
from scenelake.operators.spectra import strip_shift
from scenelake.session import checkpoint

BLOCK = ("block_row", "block_col", "block_size")
# Longest side of a scene that one task puts together, in pixels; larger ones are transformed in strips.
WHOLE = 512

_PAIR = (T.StructType().add("before", T.ArrayType(T.DoubleType())).add("after", T.ArrayType(T.DoubleType()))
         .add("width", T.IntegerType()))


def is_blocked(df: DataFrame) -> bool:
    return set(BLOCK) <= set(df.columns)


def scene_values(df: DataFrame, keys: Sequence[str], values: dict[str, tuple[Column, Callable]]) -> DataFrame:
    """Add one column per entry: a scalar of the row, combined over the rows of its scene by an aggregate.

    Tables with one row per scene keep the row's scalar and nothing is moved.
    """
    out = df.withColumns({name: local for name, (local, _) in values.items()})
    if not is_blocked(df):
        return out
    # Written, so that a chain of such figures reads its rows once each instead of doubling the plan.
    whole = checkpoint(out.groupBy(*keys).agg(*[combine(name).alias(name) for name, (_, combine) in values.items()]))
    return spread_lookup(df, whole, list(keys))


@F.pandas_udf(_PAIR)
def _assemble(parts: pd.Series) -> pd.DataFrame:
    """Blocks, placed side by side."""
    rows = []
    for blocks in parts:
        tiles = {(b["block_row"], b["block_col"]): b for b in blocks}
        lines = sorted({r for r, _ in tiles})
        columns = sorted({c for _, c in tiles})

        def picture(name: str) -> np.ndarray:
            return np.vstack([np.hstack([np.asarray(tiles[r, c][name], float).reshape(-1, tiles[r, c]["width"])
                                         for c in columns]) for r in lines])

        before, after = picture("before"), picture("after")
        rows.append((before.ravel(), after.ravel(), before.shape[1]))
    return pd.DataFrame(rows, columns=["before", "after", "width"])


def scene_shift(blocks: DataFrame, keys: Sequence[str], before: Column, after: Column, find: Callable) -> DataFrame:
    """Keys and ``shift``: ``find(before, after, width)`` on the whole scene at full resolution.

    Scenes up to ``WHOLE`` pixels a side are put together in one task; larger
    ones get the same figures from strips. ``find`` is the phase correlation in
    whole pixels, or the finer one if its shift has a ``confidence``.
    """
    keys = list(keys)
    px = blocks.select(*keys, *BLOCK, F.col("width").cast("int").alias("width"), before.alias("before"), after.alias("after"),
                       (F.col("block_row") * F.col("block_size")).cast("int").alias("_top"),
                       (F.col("block_col") * F.col("block_size")).cast("int").alias("_left"))
    extent = px.groupBy(*keys).agg(F.max(F.col("_top") + (F.size("before") / F.col("width")).cast("int")).alias("_h"),
                                   F.max(F.col("_left") + F.col("width")).alias("_w"))
    px = spread_lookup(px, extent, keys) if keys else px.crossJoin(extent)
    is_small = F.greatest("_h", "_w") <= WHOLE
    # What a scene collects is bounded by ``WHOLE``.
    part = F.struct("block_row", "block_col", "before", "after", "width")
    small = px.where(is_small).groupBy(*keys).agg(F.collect_list(part).alias("_parts")).where(
        F.size("_parts") > 0).withColumn("_pair", _assemble("_parts")).select(
        *keys, find(F.col("_pair.before"), F.col("_pair.after"), F.col("_pair.width")).alias("shift"))
    fields = small.schema["shift"].dataType.fields
    large = strip_shift(px.where(~is_small), keys, "confidence" in {f.name for f in fields})
    cast = [F.col("shift")[f.name].cast(f.dataType).alias(f.name) for f in fields]
    return small.unionByName(large.select(*keys, F.struct(*cast).alias("shift")))
