"""Quality-mask decoding."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from scenelake.lookups import QA_BAD_FLAGS, QA_BITS, SCL_CLASSES

FLAGS = [*QA_BITS, "usable"]


def decode_bits(qa: Column) -> dict[str, Column]:
    """Eight flags of a bit mask plus ``usable`` (valid and free of contamination; water is usable)."""
    flags = {name: qa.bitwiseAND(F.lit(bit)) > 0 for name, bit in QA_BITS.items()}
    bad = reduce(lambda a, b: a | b, (flags[name] for name in QA_BAD_FLAGS))
    flags["usable"] = flags["valid_data"] & ~bad
    return flags


def decode_scl(scl: Column) -> dict[str, Column]:
    """The same flags from Sentinel-2 scene classes (no haze class exists)."""
    flags = {name: scl.isin(SCL_CLASSES[name]) if name in SCL_CLASSES else F.lit(False) for name in FLAGS}
    flags["valid_data"] = scl != 0
    return flags


def decode_mixed(mask: Column, is_scl: Column) -> dict[str, Column]:
    """Decode by the encoding found for the row's tile."""
    bits, scl = decode_bits(mask), decode_scl(mask)
    return {name: F.when(is_scl, scl[name]).otherwise(bits[name]) for name in FLAGS}


def qa_summary() -> list[Column]:
    """Aggregates over decoded flags: shares of valid, cloudy, shadowed and usable pixels."""
    names = {"valid": "valid_data", "cloud": "cloud", "shadow": "cloud_shadow", "usable": "usable"}
    return [F.avg(F.col(flag).cast("double")).alias(name) for name, flag in names.items()]
