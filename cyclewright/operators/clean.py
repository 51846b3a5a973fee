"""Row filters, projections and quality predicates."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cyclewright.functions.columns import nan_to_null, strip
from cyclewright.settings import (
    DELETED_AUTHOR,
    EPSILON,
    MIN_DAYS,
    MIN_POINTS,
    MIN_SPAN_DAYS,
    MIN_TEXT_CHARS,
    MODERATOR_FLAIR,
    NON_FEATURE_COLUMNS,
    REMOVED_BODIES,
    SEED,
)


def drop_deleted_authors(df: DataFrame, author: str = "author") -> DataFrame:
    """Rows whose author is not the deleted marker; null authors stay."""
    return df.where(~F.col(author).eqNullSafe(DELETED_AUTHOR))


def blank_removed_bodies(df: DataFrame, body: str = "selftext") -> DataFrame:
    cleared = F.when(F.col(body).isin(REMOVED_BODIES), F.lit("")).otherwise(F.col(body))
    return df.withColumn(body, cleared)


def join_title_and_body(
    df: DataFrame, title: str = "title", body: str = "selftext", out: str = "text"
) -> DataFrame:
    parts = [F.coalesce(F.col(c), F.lit("")) for c in (title, body)]
    return df.withColumn(out, strip(F.concat_ws(" ", *parts)))


def add_timestamps(
    df: DataFrame, epoch: str = "created_utc", tz: str = "UTC", date_string: bool = False
) -> DataFrame:
    """``ts_utc`` from epoch seconds (bad numbers give null), optionally ``ts_date`` text."""
    if epoch not in df.columns:
        raise KeyError(f"{epoch} column missing")
    seconds = nan_to_null(F.col(epoch).try_cast("double"))
    micros = F.round(seconds * 1_000_000).try_cast("long")
    out = df.withColumn("ts_utc", F.from_utc_timestamp(F.timestamp_micros(micros), tz))
    if date_string:
        out = out.withColumn("ts_date", F.date_format("ts_utc", "yyyy-MM-dd"))
    return out


def min_text_length(df: DataFrame, n: int = MIN_TEXT_CHARS, text: str = "text") -> DataFrame:
    return df.where(F.length(text) >= n)


def clean_content(df: DataFrame) -> DataFrame:
    """Unified posts and comments: drop deleted authors and empty or removed texts, add times."""
    kept = drop_deleted_authors(df).where(
        F.col("text").isNotNull() & ~F.col("text").isin([*REMOVED_BODIES, ""])
    )
    return add_timestamps(kept)


def drop_categories(df: DataFrame, blocked: Iterable[str], category: str) -> DataFrame:
    """Case-sensitive block list; rows without a category stay."""
    return df.where(F.coalesce(~F.col(category).isin(list(blocked)), F.lit(True)))


def keep_categories(df: DataFrame, wanted: Iterable[str], category: str) -> DataFrame:
    """Case-sensitive allow list."""
    return df.where(F.col(category).isin(list(wanted)))


def feature_columns(df: DataFrame, excluded: Iterable[str] = NON_FEATURE_COLUMNS) -> list[str]:
    """Numeric or boolean columns that are not excluded, sorted by name."""
    drop = set(excluded)
    return sorted(
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType | T.BooleanType) and f.name not in drop
    )


def flag_moderators(df: DataFrame) -> DataFrame:
    """``is_moderator`` from flair wording or the distinguished mark; either column may be absent."""
    tests: list[Column] = [F.lit(False)]
    if "author_flair_text" in df.columns:
        tests.append(F.col("author_flair_text").rlike("(?i)" + MODERATOR_FLAIR))
    if "distinguished" in df.columns:
        tests.append(F.col("distinguished") == "moderator")
    flag = F.greatest(*[F.coalesce(t, F.lit(False)) for t in tests]) if len(tests) > 1 else tests[0]
    return df.withColumn("is_moderator", flag)


def with_offset(df: DataFrame, offset: str = "offset_from_cd1") -> DataFrame:
    return df.where(F.col(offset).isNotNull())


def offset_range(
    df: DataFrame, before: int, after: int, offset: str = "offset_from_cd1"
) -> DataFrame:
    """Rows from ``before`` days ahead of day zero to ``after`` days past it, inclusive."""
    return df.where(F.col(offset).between(-before, after))


def filter_snr(
    df: DataFrame, threshold: float, strict: bool = False, snr: str = "peak_to_background"
) -> DataFrame:
    value = nan_to_null(F.col(snr))
    return df.where(value > threshold if strict else value >= threshold)


def filter_fap(df: DataFrame, threshold: float, fap: str = "fap") -> DataFrame:
    return df.where(nan_to_null(F.col(fap)) < threshold)


def filter_period_range(
    df: DataFrame, low: float, high: float, period: str = "period"
) -> DataFrame:
    return df.where(F.col(period).between(low, high))


def significance(
    period: Column, snr: Column, span: Column, min_snr: float = 1.5, min_cycles: float = 1.5
) -> Column:
    """Reason a period is not significant, null when it is."""
    return (
        F.when(period.isNull(), F.lit("no period"))
        .when(nan_to_null(snr) < min_snr, F.lit("low signal"))
        .when(span / period < min_cycles, F.lit("few cycles"))
    )


def gate_reason(
    n_points: Column,
    n_days: Column,
    span_days: Column,
    n_valid: Column,
    spread: Column,
    min_points: int = MIN_POINTS,
    min_days: int = MIN_DAYS,
    min_span: float = MIN_SPAN_DAYS,
    epsilon: float = EPSILON,
) -> Column:
    """First reason why a series is not searched for periods, null when it is.

    ``spread`` is the standard deviation of the values as they are searched, that is after scaling.
    """
    return (
        F.when(n_points < min_points, F.lit("few points"))
        .when(n_days < min_days, F.lit("few days"))
        .when(span_days < min_span, F.lit("short span"))
        .when(n_valid == 0, F.lit("all missing"))
        .when(n_valid < 2, F.lit("one value"))
        .when(F.coalesce(spread, F.lit(0.0)) < epsilon, F.lit("constant"))
    )


def series_gate(
    df: DataFrame,
    keys: list[str],
    day: str,
    value: str,
    min_points: int = MIN_POINTS,
    min_days: int = MIN_DAYS,
    min_span: float = MIN_SPAN_DAYS,
    epsilon: float = EPSILON,
) -> DataFrame:
    """One row per series with its counts, ``is_valid`` and the first failing ``reason``.

    The distinct count of days makes Spark aggregate by (series, day) first, so
    a hot series is spread over its days before its rows meet.
    """
    v = nan_to_null(F.col(value).cast("double"))
    out = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_points"),
        F.count_distinct(day).alias("n_days"),
        (F.max(day) - F.min(day)).cast("double").alias("span_days"),
        F.count(v).alias("n_valid"),
        F.stddev_pop(v).alias("spread"),
    )
    counts = (F.col(c) for c in ("n_points", "n_days", "span_days", "n_valid", "spread"))
    reason = gate_reason(*counts, min_points, min_days, min_span, epsilon)
    return out.select(
        *keys,
        "n_points",
        "n_days",
        "span_days",
        "n_valid",
        reason.isNull().alias("is_valid"),
        reason.alias("reason"),
    )


def seeded_order(key: str, seed: int = SEED) -> Column:
    """Repeatable pseudo-random sort key: md5 of seed and row key."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def random_rows(df: DataFrame, n: int, key: str, seed: int = SEED) -> DataFrame:
    """``n`` repeatably random rows, as a distributed top-n."""
    return df.orderBy(seeded_order(key, seed), F.col(key)).limit(n)
