"""Phase tables and phase assignment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cyclewright.functions.columns import let
from cyclewright.functions.phases import adaptive_bounds, adaptive_phase, five_phase, five_phase_bounds
from cyclewright.plans.joins import lookup_join


def phase_table(
    periods: DataFrame,
    user: str = "user",
    period: str = "period",
    split_luteal: bool = False,
) -> DataFrame:
    """One row per user and phase: start, end and length in days, with the order of the phase."""
    bounds = adaptive_bounds(F.col(period), split_luteal)
    entries = [
        F.struct(
            F.lit(i).alias("phase_order"),
            F.lit(name).alias("phase"),
            start.alias("start_day"),
            end.alias("end_day"),
            (end - start + 1).alias("length_days"),
        )
        for i, (name, start, end) in enumerate(bounds)
    ]
    return periods.select(F.col(user).alias("user"), F.explode(F.array(*entries)).alias("p")).select(
        "user", "p.*"
    )


def five_phase_table(periods: DataFrame, user: str = "user", period: str = "period") -> DataFrame:
    """One row per user and phase of the five-phase scheme; ``early`` marks very short cycles."""
    entries = [
        F.struct(F.lit(name).alias("phase"), start.alias("start_day"), end.alias("end_day"))
        for name, start, end in five_phase_bounds(F.col(period))
    ]
    early = F.bround(F.col(period).cast("double")) - 14 < 10
    return periods.select(
        F.col(user).alias("user"), early.alias("early"), F.explode(F.array(*entries)).alias("p")
    ).select("user", "early", "p.*")


def assign_five_phases(df: DataFrame, day: str, period: str) -> DataFrame:
    """``phase`` from the day reduced to the row's own cycle length."""
    inside = F.pmod(F.col(day).cast("double"), F.col(period).cast("double"))
    return df.withColumn("phase", five_phase(inside, F.col(period)))


def assign_phases(
    timeline: DataFrame,
    phases: DataFrame,
    user: str = "author",
    day: str = "offset_from_cd1",
) -> DataFrame:
    """Phase of each row from a phase table; null for unknown users and null days.

    The table is folded to one row per user (a handful of phases), so the range
    condition is read from an array and rows do not multiply.
    """
    folded = phases.groupBy(F.col("user").alias(user)).agg(
        F.sort_array(
            F.collect_list(F.struct("phase_order", "phase", "start_day", "end_day"))
        ).alias("__phases"),
        (F.max("end_day") + 1).alias("__wrap"),
    )
    joined = lookup_join(timeline, folded, [user], "left")
    phase = let(
        F.pmod(F.col(day).cast("double"), F.col("__wrap")),
        lambda d: F.get(
            F.filter("__phases", lambda p: d.between(p["start_day"], p["end_day"])), F.lit(0)
        )["phase"],
    )
    return joined.select(*timeline.columns, phase.alias("phase"))


def assign_phases_by_length(
    timeline: DataFrame, cycle: str, day: str = "offset_from_cd1", split_luteal: bool = False
) -> DataFrame:
    """Phase by arithmetic from a cycle-length column on the row; no join."""
    return timeline.withColumn("phase", adaptive_phase(F.col(day), F.col(cycle), split_luteal))


def with_cycle_length(
    timeline: DataFrame, periods: DataFrame, user: str = "author"
) -> DataFrame:
    """Adds ``period``; distinct (user, period) pairs, so a user with two periods gives two rows."""
    pairs = periods.select(F.col("user").alias(user), "period").distinct()
    return lookup_join(timeline, pairs, [user], "left")


def with_fixed_cycle_length(timeline: DataFrame, length: float) -> DataFrame:
    return timeline.withColumn("period", F.lit(float(length)))
