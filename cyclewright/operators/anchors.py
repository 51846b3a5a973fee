"""One anchor per user, and everything measured relative to it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cyclewright.plans.joins import lookup_join
from cyclewright.settings import (
    CALENDAR_WINDOW_DAYS,
    CYCLE_DAY_PATTERNS,
    DAYS_PER_MONTH,
    DPO_PATTERNS,
    WINDOW_MONTHS,
)

MICROS_PER_DAY = 86_400_000_000


def latest_per_key(
    df: DataFrame, key: str, ts: str, tie_break: str, keep: list[str]
) -> DataFrame:
    """Newest row per key; equal times fall to the largest ``tie_break``.

    A max over a struct is combined on the map side, so a hot key sends one row
    per map task and is never sorted as a whole.
    """
    newest = F.max_by(F.struct(*keep), F.struct(ts, tie_break)).alias("r")
    return df.where(F.col(ts).isNotNull()).groupBy(key).agg(newest).select(key, "r.*")


def usable_candidates(candidates: list[DataFrame]) -> DataFrame:
    """Union of the sources without hedged or undated candidates."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), candidates)
    return stacked.where(~F.col("has_uncertainty") & F.col("offset_from_cd1").isNotNull())


def prioritised_users(
    candidates: DataFrame,
    groups: list[tuple[str, list[str]]],
    author: str = "author",
    row_id: str = "id",
) -> DataFrame:
    """Users layout with ``anchor_group``: the newest anchor of the first group a user has.

    One partial aggregate keeps the newest row of every group per user, so the
    priority between groups needs no join.
    """
    keep = F.struct(
        F.col("ts_utc").alias("timestep"),
        "text",
        "offset_from_cd1",
        "dpo_days",
        F.col("regex_type").alias("pattern_category"),
    )
    order = F.struct("ts_utc", row_id)

    def newest(patterns: list[str]) -> Column:
        mine = F.col("regex_type").isin(patterns)
        return F.max_by(F.when(mine, keep), F.when(mine, order))

    per_user = (
        candidates.where(F.col("ts_utc").isNotNull())
        .groupBy(F.col(author).alias("user"))
        .agg(*[newest(patterns).alias(f"__{name}") for name, patterns in groups])
    )
    chosen = F.coalesce(
        *[
            F.when(
                F.col(f"__{name}").isNotNull(),
                F.struct(F.lit(name).alias("anchor_group"), F.col(f"__{name}").alias("row")),
            )
            for name, _ in groups
        ]
    )
    return (
        per_user.select("user", chosen.alias("c"))
        .where(F.col("c").isNotNull())
        .select("user", "c.row.*", "c.anchor_group")
    )


def without_users_of(lower: DataFrame, upper: DataFrame, user: str = "user") -> DataFrame:
    """The lower-priority group loses the users that the upper one has."""
    return lower.join(upper.select(user), user, "left_anti")


def users_tables(candidates: list[DataFrame], row_id: str = "id") -> tuple[DataFrame, DataFrame]:
    """(cycle-day users, days-past-ovulation users); the first group has priority."""
    groups = [("cycle_day", CYCLE_DAY_PATTERNS), ("past_ovulation", DPO_PATTERNS)]
    users = prioritised_users(usable_candidates(candidates), groups, row_id=row_id)

    def of(name: str) -> DataFrame:
        return users.where(F.col("anchor_group") == name).drop("anchor_group")

    return of("cycle_day"), of("past_ovulation")


def keep_users(df: DataFrame, users: DataFrame, key: str, by_layout: bool = False) -> DataFrame:
    """Rows of the users in ``users`` (one column named like ``key``, distinct or not)."""
    return lookup_join(df, users.select(key), [key], "left_semi", by_layout)


def split_anchor_posts(
    posts: DataFrame, users: DataFrame, author: str = "author", ts: str = "ts_utc"
) -> DataFrame:
    """Posts without all those of a user at exactly the user's anchor time."""
    anchors = users.select(F.col("user").alias(author), F.col("timestep").alias(ts))
    return posts.join(anchors, [author, ts], "left_anti")


def calendar_days(later: Column, earlier: Column) -> Column:
    """Midnight-to-midnight difference."""
    return F.datediff(later.cast("date"), earlier.cast("date"))


def elapsed_days(later: Column, earlier: Column) -> Column:
    """Whole days elapsed, rounded down: one hour before is -1."""
    micros = F.unix_micros(later) - F.unix_micros(earlier)
    return F.floor(micros / F.lit(MICROS_PER_DAY))


def with_anchor(
    posts: DataFrame, users: DataFrame, author: str, value: str, how: str, by_layout: bool = False
) -> DataFrame:
    """Joins anchor time and anchor value to the posts of each user.

    ``by_layout`` is for posts from ``snapshots.load_bucketed``: they are not shuffled.
    """
    anchors = users.select(
        F.col("user").alias(author),
        F.col("timestep").alias("anchor_ts"),
        F.col(value).try_cast("int").alias("anchor_value"),
    )
    return lookup_join(posts, anchors, [author], how, by_layout)


def add_offsets(
    posts: DataFrame,
    users: DataFrame,
    author: str = "author",
    ts: str = "ts_utc",
    anchor_value: str = "offset_from_cd1",
    by_layout: bool = False,
) -> DataFrame:
    """Anchor value plus calendar days since the anchor; null for users without one.

    The new column is named like the anchor value: offset_from_cd1 or dpo_days.
    """
    joined = with_anchor(posts, users, author, anchor_value, "left", by_layout)
    offset = F.col("anchor_value") + calendar_days(F.col(ts), F.col("anchor_ts"))
    return joined.select(*posts.columns, offset.alias(anchor_value))


def within_months(
    posts: DataFrame,
    users: DataFrame,
    months: int = WINDOW_MONTHS,
    author: str = "author",
    ts: str = "ts_utc",
    anchor_value: str = "offset_from_cd1",
    by_layout: bool = False,
) -> DataFrame:
    """Posts within ``months`` of the anchor by elapsed days; other users fall out."""
    limit = int(months * DAYS_PER_MONTH)
    joined = with_anchor(posts, users, author, anchor_value, "inner", by_layout)
    return joined.where(
        F.abs(elapsed_days(F.col(ts), F.col("anchor_ts"))) <= limit
    ).select(*posts.columns)


def within_calendar_days(
    posts: DataFrame,
    users: DataFrame,
    days: int = CALENDAR_WINDOW_DAYS,
    author: str = "author",
    ts: str = "ts_utc",
    anchor_value: str = "offset_from_cd1",
    by_layout: bool = False,
) -> DataFrame:
    """Posts within ``days`` midnights of the anchor, both ends included."""
    joined = with_anchor(posts, users, author, anchor_value, "inner", by_layout)
    return joined.where(
        F.abs(calendar_days(F.col(ts), F.col("anchor_ts"))) <= days
    ).select(*posts.columns)


def placed_window(
    posts: DataFrame,
    users: DataFrame,
    months: int = WINDOW_MONTHS,
    author: str = "author",
    ts: str = "ts_utc",
    anchor_value: str = "offset_from_cd1",
    by_layout: bool = False,
) -> DataFrame:
    """Offsets, named like the anchor value, and the elapsed-day window in one join."""
    limit = int(months * DAYS_PER_MONTH)
    joined = with_anchor(posts, users, author, anchor_value, "inner", by_layout)
    offset = F.col("anchor_value") + calendar_days(F.col(ts), F.col("anchor_ts"))
    return joined.where(
        F.col("anchor_value").isNotNull()
        & (F.abs(elapsed_days(F.col(ts), F.col("anchor_ts"))) <= limit)
    ).select(*posts.columns, offset.alias(anchor_value))
