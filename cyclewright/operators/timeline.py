"""User timelines, their daily tables and complete-case filtering."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cyclewright.functions.columns import nan_to_null
from cyclewright.operators.anchors import placed_window, with_anchor, calendar_days
from cyclewright.plans.joins import lookup_join
from cyclewright.plans.quantiles import grouped_median
from cyclewright.settings import CALENDAR_WINDOW_DAYS

TIMELINE_COLUMNS = ["author", "ts_utc", "text", "source", "offset_from_cd1"]


def unified_timeline(
    users: DataFrame,
    comments: DataFrame,
    posts: DataFrame,
    days: int = CALENDAR_WINDOW_DAYS,
) -> DataFrame:
    """Posts and comments of the users around their anchors, sorted by author and time.

    Membership, window and offset come from one join over the stacked content.
    """
    columns = ["author", "ts_utc", "text", "source"]
    content = comments.select(*columns).unionByName(posts.select(*columns))
    joined = with_anchor(content, users, "author", "offset_from_cd1", "inner")
    apart = calendar_days(F.col("ts_utc"), F.col("anchor_ts"))
    return (
        joined.where(F.abs(apart) <= days)
        .select(*columns, (F.col("anchor_value") + apart).alias("offset_from_cd1"))
        .orderBy("author", "ts_utc")
    )


def incomplete_users(df: DataFrame, features: list[str], user: str = "author") -> DataFrame:
    """Users with a missing value in any feature of any row."""
    present = [f for f in features if f in df.columns]
    missing = F.lit(False)
    for f in present:
        col = F.col(f)
        is_float = isinstance(df.schema[f].dataType, T.FractionalType) and not isinstance(
            df.schema[f].dataType, T.DecimalType
        )
        missing = missing | (col.isNull() | F.isnan(col) if is_float else col.isNull())
    return df.where(missing).select(user).distinct()


def drop_incomplete_users(
    df: DataFrame, features: list[str], user: str = "author"
) -> DataFrame:
    """Rows of users that have every feature in every row."""
    return lookup_join(df, incomplete_users(df, features, user), [user], "left_anti")


DAILY_FUNCTIONS = {
    "mean": F.avg,
    "min": F.min,
    "max": F.max,
    "sum": F.sum,
    "std": F.stddev_samp,
}


def daily_value(
    df: DataFrame, keys: list[str], day: str, value: str, function: str = "mean"
) -> DataFrame:
    """Value and entry count per key and day; days without a value are left out."""
    v = nan_to_null(F.col(value).cast("double"))
    if function == "median":
        known = df.where(F.col(day).isNotNull()).select(*keys, day, v.alias("__value"))
        return (
            grouped_median(known, [*keys, day], "__value")
            .where(F.col("n") > 0)
            .select(*keys, day, F.col("median").alias("feature_mean"), F.col("n").alias("n_entries"))
        )
    if function not in DAILY_FUNCTIONS:
        raise ValueError(f"unknown daily function: {function}")
    return (
        df.where(F.col(day).isNotNull())
        .groupBy(*keys, day)
        .agg(DAILY_FUNCTIONS[function](v).alias("feature_mean"), F.count(v).alias("n_entries"))
        .where(F.col("feature_mean").isNotNull())
    )


def daily_means(df: DataFrame, features: list[str], user: str, day: str) -> DataFrame:
    """``{feature}_mean`` per user and day, missing values skipped.

    Keyed by (user, day): partial sums are one row per map task, user and day,
    and a hot user is spread over its days.
    """
    usable = [
        f
        for f in features
        if f in df.columns
        and f not in (user, day)
        and isinstance(df.schema[f].dataType, T.NumericType | T.BooleanType)
    ]
    if not usable:
        raise ValueError("no numeric feature column to aggregate")
    means = [
        F.avg(nan_to_null(F.col(f).cast("double"))).alias(f"{f}_mean") for f in usable
    ]
    return (
        df.where(F.col(day).isNotNull() & F.col(user).isNotNull())
        .groupBy(user, day)
        .agg(*means)
    )


def as_series(daily: DataFrame, user: str, day: str, features: list[str]) -> DataFrame:
    """Wide daily table to long (user, feature, day, value) without missing values."""
    plain = daily.select(
        F.col(user).alias("user"),
        F.col(day).cast("int").alias("day"),
        *[F.col(f).cast("double").alias(f) for f in features],
    )
    long = plain.unpivot(["user", "day"], features, "feature", "value")
    return long.where(F.col("value").isNotNull() & ~F.isnan("value"))
