"""Features compared across phases and over time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cyclewright.functions.columns import nan_to_null
from cyclewright.functions.phases import adaptive_phase
from cyclewright.settings import DAYS_PER_MONTH, EPSILON


def _phase_features(columns: list[str], excluded: set[str]) -> list[str]:
    return sorted(
        c for c in columns if c not in excluded and c.endswith(("_zscore", "_mean"))
    )


def phase_range(
    df: DataFrame, features: list[str] | None = None, phase: str = "phase"
) -> DataFrame:
    """Largest and smallest phase mean per feature; ties go to the first name."""
    if features is None:
        features = _phase_features(df.columns, {phase, "user", "author"})
    means = (
        df.where(F.col(phase).isNotNull())
        .groupBy(phase)
        .agg(*[F.avg(nan_to_null(F.col(f).cast("double"))).alias(f) for f in features])
    )
    long = means.unpivot([phase], features, "feature", "m").where(F.col("m").isNotNull())
    return (
        long.groupBy("feature")
        .agg(
            (F.max("m") - F.min("m")).alias("max_min_diff"),
            F.min_by(phase, F.struct(-F.col("m"), F.col(phase))).alias("max_phase"),
            F.min_by(phase, F.struct(F.col("m"), F.col(phase))).alias("min_phase"),
            F.max("m").alias("mean_max"),
            F.min("m").alias("mean_min"),
        )
        .orderBy(F.desc("max_min_diff"), "feature")
    )


def signal_fading(
    timeline: DataFrame,
    phase_rows: DataFrame,
    features: list[str],
    user: str = "author",
    offset: str = "offset_from_cd1",
    months: list[tuple[int, int]] | None = None,
) -> DataFrame:
    """Spread over phases of the users seen in each month after the anchor.

    Days before the anchor are in no bin. A user's spread is over all of its
    phase rows. The z-score column of a feature is preferred to its mean column.
    """
    months = months or [(m, m + 1) for m in range(6)]
    month = F.col(offset) / DAYS_PER_MONTH
    label = F.coalesce(
        *[F.when((month >= a) & (month < b), F.lit(f"{a}-{b}")) for a, b in months]
    )
    seen = (
        timeline.select(F.col(user), label.alias("months_bin"))
        .where(F.col("months_bin").isNotNull())
        .distinct()
    )
    sources = {}
    for f in features:
        for c in (f"{f}_zscore", f"{f}_mean"):
            if c in phase_rows.columns:
                sources[f] = c
                break
    spread = [
        (
            F.max(nan_to_null(F.col(c).cast("double"))) - F.min(nan_to_null(F.col(c).cast("double")))
        ).alias(f)
        for f, c in sources.items()
    ]
    per_user = phase_rows.groupBy(user).agg(*spread)
    long = (
        seen.join(per_user, user)
        .unpivot([user, "months_bin"], list(sources), "feature", "d")
        .where(F.col("d").isNotNull())
    )
    return (
        long.groupBy("feature", "months_bin")
        .agg(
            F.avg("d").alias("max_min_diff"),
            F.count(F.lit(1)).alias("n_users"),
            F.stddev_pop("d").alias("std_max_min"),
        )
        .orderBy("feature", "months_bin")
    )


def features_by_phase(
    daily: DataFrame,
    features: list[str],
    periods: DataFrame | None,
    user: str = "author",
    day: str = "offset_from_cd1",
    normalise: bool = True,
    time_window: tuple[int, int] | None = None,
    fixed_length: float | None = None,
    average_per_user: bool = True,
) -> DataFrame:
    """Mean, deviation, standard error and counts per feature and phase.

    ``daily`` holds one row per user and day with a column per feature; scaling
    (sample deviation) precedes the time window. ``periods`` has user and
    period, and is ignored when ``fixed_length`` is given.
    """
    over = W.partitionBy(user)
    values = []
    for f in features:
        v = nan_to_null(F.col(f).cast("double"))
        z = (v - F.avg(v).over(over)) / (F.stddev_samp(v).over(over) + EPSILON)
        values.append((z if normalise else v).alias(f))
    rows = daily.select(user, day, *values)
    if time_window is not None:
        rows = rows.where(F.col(day).between(*time_window))
    if fixed_length is not None:
        rows = rows.withColumn("period", F.lit(float(fixed_length)))
    else:
        pairs = periods.where(F.col("period").isNotNull()).select(
            F.col("user").alias(user), F.col("period").cast("double").alias("period")
        )
        rows = rows.join(pairs.distinct(), user)
    rows = rows.withColumn("phase", adaptive_phase(F.col(day), F.col("period"))).where(
        F.col("phase").isNotNull()
    )
    if average_per_user:
        # All features of a user and phase in one row, on the partitioning by user; rows multiply after.
        wide = rows.groupBy(user, "phase").agg(
            *[x for f in features for x in (F.avg(f).alias(f"m:{f}"), F.count(f).alias(f"n:{f}"))]
        )
        each = [
            F.struct(F.lit(f).alias("feature"), F.col(f"m:{f}").alias("m"), F.col(f"n:{f}").alias("days"))
            for f in features
        ]
        per_user = wide.select("phase", F.inline(F.array(*each))).where(F.col("days") > 0)
        out = per_user.groupBy("feature", "phase").agg(
            F.avg("m").alias("mean"),
            F.stddev_samp("m").alias("std"),
            F.sum("days").alias("n_user_days"),
            F.count(F.lit(1)).alias("n_users"),
        )
        weight = F.col("n_users")
    else:
        long = rows.unpivot([user, "phase"], features, "feature", "v").where(F.col("v").isNotNull())
        out = long.groupBy("feature", "phase").agg(
            F.avg("v").alias("mean"),
            F.stddev_samp("v").alias("std"),
            F.count(F.lit(1)).alias("n_user_days"),
            F.count_distinct(user).alias("n_users"),
        )
        weight = F.col("n_user_days")
    return out.withColumn("sem", F.col("std") / F.sqrt(weight))


def phase_counts(df: DataFrame, user: str, phase: str = "phase") -> DataFrame:
    """Users and user-days per phase."""
    return (
        df.where(F.col(phase).isNotNull())
        .groupBy(phase)
        .agg(F.count_distinct(user).alias("n_users"), F.count(F.lit(1)).alias("n_user_days"))
    )
