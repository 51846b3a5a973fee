"""Least-squares sine of a known period, one closed-form solve per series."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cyclewright.operators.spectral import SERIES


def fit_sine(series: DataFrame, period: str, keys: list[str] = SERIES) -> DataFrame:
    """amplitude, phase and level of A sin(2 pi x / P + phase) + level.

    The model is linear in (sin, cos, 1), so the sums of one partial aggregate
    give the 3x3 normal equations, solved by determinants. A singular system
    gives amplitude 0 and the mean, as does a series with a single day.
    """
    x = F.col("day") * (2 * math.pi) / F.col(period)
    rows = series.select(
        *keys, period, "day", F.col("value").alias("y"), F.sin(x).alias("s"), F.cos(x).alias("c")
    )
    s, c, y = F.col("s"), F.col("c"), F.col("y")
    sums = rows.groupBy(*keys, period).agg(
        F.count(y).alias("n"),
        F.avg(s).alias("s"),
        F.avg(c).alias("c"),
        F.avg(y).alias("y"),
        F.avg(s * s).alias("ss"),
        F.avg(c * c).alias("cc"),
        F.avg(s * c).alias("sc"),
        F.avg(s * y).alias("sy"),
        F.avg(c * y).alias("cy"),
        F.min("day").alias("first_day"),
        F.max("day").alias("last_day"),
    )
    # Taking means off leaves a 2x2 system in the two wave coefficients.
    ss = F.col("ss") - s * s
    cc = F.col("cc") - c * c
    sc = F.col("sc") - s * c
    sy = F.col("sy") - s * y
    cy = F.col("cy") - c * y
    det = ss * cc - sc * sc
    solved = sums.select(
        *keys,
        period,
        "n",
        "first_day",
        "last_day",
        y.alias("mean"),
        s.alias("mean_s"),
        c.alias("mean_c"),
        F.when(det > 1e-12, (sy * cc - cy * sc) / det).alias("a"),
        F.when(det > 1e-12, (cy * ss - sy * sc) / det).alias("b"),
    )
    a, b = F.col("a"), F.col("b")
    return solved.select(
        *keys,
        period,
        "n",
        "first_day",
        "last_day",
        F.coalesce(F.sqrt(a * a + b * b), F.lit(0.0)).alias("amplitude"),
        F.coalesce(F.atan2(b, a), F.lit(0.0)).alias("phase"),
        F.coalesce(F.col("mean") - a * F.col("mean_s") - b * F.col("mean_c"), F.col("mean")).alias(
            "level"
        ),
    )


def sine_curve(fits: DataFrame, period: str, points: int = 1000) -> DataFrame:
    """The fitted curve at evenly spaced places from the first to the last day."""
    reach = F.col("last_day") - F.col("first_day")
    placed = fits.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn(
        "x", F.col("first_day") + reach * F.col("i") / (points - 1)
    )
    angle = F.col("x") * (2 * math.pi) / F.col(period) + F.col("phase")
    return placed.withColumn(
        "fitted", F.col("amplitude") * F.sin(angle) + F.col("level")
    ).drop("i")
