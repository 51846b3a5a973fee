"""Per-user and per-series scaling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cyclewright.functions.columns import nan_to_null
from cyclewright.plans.joins import lookup_join
from cyclewright.settings import EPSILON

SCALINGS = ("zscore", "minmax", "none")


def scaled(value: Column, over: WindowSpec, method: str = "zscore") -> Column:
    """Population z-score, min-max, or the value itself, over a window of one series."""
    if method == "zscore":
        spread = F.stddev_pop(value).over(over) + EPSILON
        return (value - F.avg(value).over(over)) / spread
    if method == "minmax":
        low = F.min(value).over(over)
        return (value - low) / (F.max(value).over(over) - low + EPSILON)
    if method == "none":
        return value
    raise ValueError(f"unknown scaling: {method}")


def zscore_daily_per_user(daily: DataFrame, columns: list[str], user: str) -> DataFrame:
    """``{column}_zscore`` of daily means with the sample deviation.

    Null for constant columns and for users with a single day. The input is
    daily, so a window holds no more rows than days.
    """
    over = W.partitionBy(user)
    out = []
    for c in columns:
        v = nan_to_null(F.col(c).cast("double"))
        spread = F.stddev_samp(v).over(over)
        z = (v - F.avg(v).over(over)) / (spread + EPSILON)
        out.append(F.when(spread >= EPSILON, z).alias(f"{c.removesuffix('_mean')}_zscore"))
    return daily.select(*daily.columns, *out)


def zscore_posts_per_user(
    posts: DataFrame, columns: list[str], user: str
) -> DataFrame:
    """``{column}_zscore`` of single posts with the population deviation.

    Posts per user are unbounded, so the moments are a partial aggregate that
    is joined back; a window would put all posts of a user in one task.
    """
    moments = []
    for c in columns:
        v = nan_to_null(F.col(c).cast("double"))
        moments += [
            F.avg(v).alias(f"__m_{c}"),
            F.stddev_pop(v).alias(f"__s_{c}"),
            F.count(v).alias(f"__n_{c}"),
        ]
    stats = posts.groupBy(user).agg(*moments)
    joined = lookup_join(posts, stats, [user], "left")
    out = []
    for c in columns:
        v = nan_to_null(F.col(c).cast("double"))
        z = (v - F.col(f"__m_{c}")) / (F.col(f"__s_{c}") + EPSILON)
        usable = (F.col(f"__n_{c}") >= 2) & (F.col(f"__s_{c}") >= EPSILON)
        out.append(F.when(usable, z).alias(f"{c}_zscore"))
    return joined.select(*posts.columns, *out)
