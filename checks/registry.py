"""Registration of queries and of their SQL.

A column spec such as ``"scene:l y:l dist:6 kind:s"`` fixes names, order, types
and rounding of a result on both sides: l integer, s text, b boolean, t
timestamp as text, a digit rounds a double half up.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from scenelake.functions.mathx import round_half_up

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _spark_column(name: str, kind: str):
    c = F.col(name)
    if kind == "l":
        return c.cast("bigint").alias(name)
    if kind == "s":
        return c.cast("string").alias(name)
    if kind == "b":
        return c.cast("boolean").alias(name)
    if kind == "t":
        return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(name)
    return round_half_up(c.cast("double"), int(kind)).alias(name)


def _sql_column(name: str, kind: str) -> str:
    if kind == "l":
        return f'CAST("{name}" AS BIGINT) AS "{name}"'
    if kind == "s":
        return f'CAST("{name}" AS VARCHAR) AS "{name}"'
    if kind == "b":
        return f'CAST("{name}" AS BOOLEAN) AS "{name}"'
    if kind == "t":
        return f"strftime(\"{name}\", '%Y-%m-%d %H:%M:%S.%f') AS \"{name}\""
    scale = f"1e{kind}"
    return f'floor(CAST("{name}" AS DOUBLE) * {scale} + 0.5) / {scale} AS "{name}"'


def half_even(value: str, digits: int) -> str:
    """SQL of ``round_to``: the exact value to the nearest decimal, ties to even."""
    s = f"1e{digits}::DOUBLE"
    high = "(v * 134217729.0::DOUBLE - (v * 134217729.0::DOUBLE - v))"
    over = f"(({high} * {s} - (floor(v * {s}) + 0.5::DOUBLE)) + (v - {high}) * {s})"
    return (f"list_transform([CAST({value} AS DOUBLE)], lambda v: (CASE WHEN {over} > 0 OR ({over} = 0 AND floor(v * {s}) % 2 <> 0) "
            f"THEN floor(v * {s}) + 1 ELSE floor(v * {s}) END) / {s})[1]")


def check(name: str, spec: str, sql: str | None = None, ctes: str = ""):
    """Register a query; ``ctes`` are common table expressions put before ``sql``."""
    columns = [part.split(":") for part in spec.split()]

    def register(build: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(spark, sf_dir).select(*[_spark_column(n, k) for n, k in columns])

        QUERIES[name] = run
        if sql is not None:
            head = f"WITH {ctes} " if ctes else ""
            body = ", ".join(_sql_column(n, k) for n, k in columns)
            ORACLES[name] = f"{head}SELECT {body} FROM ({sql}) AS result_rows"
        return build

    return register
