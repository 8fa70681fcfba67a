"""Rounding as Python does it, on exact ties, near ties and ordinary values."""

import random

from pyspark.sql import functions as F

from scenelake.functions.mathx import round_to


def test_rounds_like_python(spark):
    rng = random.Random(1)
    values = [66.25, 66.35, 0.5, 1.5, 2.5, -0.5, -66.25, 2.675, 1.115, 1.005, 0.285, 0.125, 0.375, 1e9 + 0.5, 0.0, 99.95, 99.949999]
    values += [rng.uniform(-200, 200) for _ in range(500)] + [rng.randint(-10_000, 10_000) / 16 for _ in range(300)]
    values += [round(rng.uniform(0, 100), 3) for _ in range(500)]
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    for digits in (0, 1, 2, 4, 6):
        for row in frame.select("v", round_to(F.col("v"), digits).alias("r")).collect():
            assert row["r"] == round(row["v"], digits), (row["v"], digits)
    assert spark.range(1).select(round_to(F.lit(None).cast("double"), 2).alias("r")).first()["r"] is None
