"""Counts, shares, samples and other descriptive tables."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cyclewright.functions.columns import nan_to_null
from cyclewright.operators.clean import seeded_order
from cyclewright.plans.quantiles import exact_medians
from cyclewright.settings import SAMPLE_SIZE, SEED


def phrase_summary(df: DataFrame, phrase: str = "matched_phrase_norm") -> DataFrame:
    """Posts and hedged posts per phrase, most frequent first."""
    return (
        df.where(F.col(phrase).isNotNull())
        .groupBy(phrase)
        .agg(
            F.count(F.lit(1)).alias("total"),
            F.count_if(F.col("has_uncertainty")).alias("uncertain"),
        )
        .orderBy(F.desc("total"), phrase)
    )


def hedge_rate(df: DataFrame) -> DataFrame:
    """Posts, hedged posts and their share in percent."""
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("has_uncertainty")).alias("uncertain"),
        (F.avg(F.col("has_uncertainty").cast("int")) * 100).alias("pct"),
    )


def pattern_counts(df: DataFrame, author: str = "author") -> DataFrame:
    """Posts and distinct users per pattern, sorted by pattern."""
    return (
        df.where(F.col("regex_type").isNotNull())
        .groupBy("regex_type")
        .agg(F.count(F.lit(1)).alias("count"), F.count_distinct(author).alias("unique_users"))
        .orderBy("regex_type")
    )


def category_shares(
    df: DataFrame, category: str, min_posts: int = 1, top_n: int | None = None
) -> DataFrame:
    """Posts per category with the share of all posts, also of those filtered out."""
    known = df.where(F.col(category).isNotNull() & (F.col(category) != ""))
    counts = known.groupBy(category).agg(F.count(F.lit(1)).alias("post_count"))
    total = counts.agg(F.sum("post_count")).scalar()
    out = (
        counts.where(F.col("post_count") >= min_posts)
        .withColumn("percentage", F.round(F.col("post_count") / total * 100, 2))
        .orderBy(F.desc("post_count"), category)
    )
    return out if top_n is None else out.limit(top_n)


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return (
        df.where(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(column)
    )


def offset_summary(users: DataFrame, offset: str = "offset_from_cd1") -> DataFrame:
    """Range, mean and median of the whole-day anchor offsets."""
    return users.agg(
        F.min(offset).alias("min_offset"),
        F.max(offset).alias("max_offset"),
        F.avg(offset).alias("mean_offset"),
        F.median(offset).alias("median_offset"),
        F.count(F.lit(1)).alias("n_users"),
    )


def days_per_user(daily: DataFrame, user: str) -> DataFrame:
    """User-days, users and their ratio."""
    rows, users = F.count(F.lit(1)), F.count_distinct(user)
    return daily.agg(
        rows.alias("user_days"), users.alias("users"), (rows / users).alias("days_per_user")
    )


def require_rows(df: DataFrame, name: str = "input") -> DataFrame:
    """The table itself; an error when it has no rows."""
    if df.isEmpty():
        raise ValueError(f"{name} has no rows")
    return df


def null_profile(df: DataFrame, required: list[str]) -> DataFrame:
    """Row count and missing share of each required column; error for an absent one."""
    absent = [c for c in required if c not in df.columns]
    if absent:
        raise ValueError(f"required columns missing: {absent}")

    def share(c: str) -> Column:
        return F.avg(F.col(c).isNull().cast("int")).alias(c)

    wide = df.agg(F.count(F.lit(1)).alias("n_rows"), *[share(c) for c in required])
    return wide.unpivot(["n_rows"], required, "column_name", "null_share")


def sample_per_group(
    df: DataFrame, group: str, key: str, n: int = SAMPLE_SIZE, seed: int = SEED
) -> DataFrame:
    """Up to ``n`` repeatably random rows per group, numbered in key order.

    The rank filter is pushed below the exchange by Spark, so each map task
    sends at most ``n`` rows of a group.
    """
    drawn = W.partitionBy(group).orderBy(seeded_order(key, seed), F.col(key))
    kept = (
        df.where(F.col(group).isNotNull())
        .withColumn("__r", F.row_number().over(drawn))
        .where(F.col("__r") <= n)
        .drop("__r")
    )
    return kept.withColumns(
        {
            "sample_index": F.row_number().over(W.partitionBy(group).orderBy(key)),
            "sample_size_target": F.lit(n),
        }
    )


def users_of_pattern(
    users: DataFrame, pattern: str, n: int = 50, seed: int = SEED, user: str = "user"
) -> DataFrame:
    """``n`` repeatably random users of one pattern, all of them if there are fewer."""
    chosen = users.where(F.col("pattern_category") == pattern)
    return chosen.orderBy(seeded_order(user, seed), F.col(user)).limit(n)


def overall_period_stats(results: DataFrame) -> DataFrame:
    """Mean and median of the period and of the signal-to-noise ratio over all results, one row.

    Periods are whole days in a short range; ratios are not bounded in number. Runs
    when called: equal results are counted once and kept on the executors' disks, and
    all figures come from that table.
    """
    snr = nan_to_null(F.col("peak_to_background")).alias("snr")
    counts = results.groupBy("period", snr).agg(F.count(F.lit(1)).alias("n_rows"))
    counts = counts.persist(StorageLevel.DISK_ONLY)
    period, ratio, n = F.col("period"), F.col("snr"), F.col("n_rows")

    def total(c: Column) -> Column:
        return F.coalesce(F.sum(F.when(c.isNotNull(), n)), F.lit(0).cast("long"))

    try:
        row = counts.agg(
            total(period).alias("n"),
            F.try_divide(F.sum(period * n), total(period)).cast("double").alias("mean_period"),
            F.try_divide(F.sum(ratio * n), total(ratio)).alias("mean_snr"),
        ).first()
        medians = exact_medians(counts, ["period", "snr"], "n_rows")
    finally:
        counts.unpersist()
    return results.sparkSession.createDataFrame(
        [(*row, medians["period"], medians["snr"])],
        "n long, mean_period double, mean_snr double, median_period double, median_snr double",
    )
