"""Queries: cohort against control on events."""

from __future__ import annotations

from pyspark.sql import functions as F

from cyclewright.catalog.base import OFFSETS_SQL, event_posts, event_users, query, r6
from cyclewright.catalog.cycles import CONSENSUS_SQL, EVENT_PEAKS_SQL, _event_peaks
from cyclewright.catalog.phasing import PHASE_CASE, WRAP, four_phase_sql, pymod
from cyclewright.operators import clean, cohorts, consensus
from cyclewright.operators.anchors import add_offsets

# A category is the event type, with a suffix for large values.
HIGH = 150
MARKERS = ["error_high"]
SETS = {
    "clicks": ["click", "click_high"],
    "buying": ["purchase", "purchase_high"],
    "alarm": ["purchase_high", "error_high", "view_high"],
}


def _posts(spark, sf_dir):
    posts = event_posts(spark, sf_dir)
    kind = F.when(F.col("value") >= HIGH, F.concat("subreddit", F.lit("_high"))).otherwise(
        F.col("subreddit")
    )
    return posts, posts.withColumn("category", kind)


def _in(items: list[str]) -> str:
    return "category in (" + ", ".join(f"'{i}'" for i in items) + ")"


GROUPS_SQL = OFFSETS_SQL + f""",
  posts as (select *, case when value >= {HIGH} then event_type || '_high' else event_type end as category
            from placed),
  everyone as (select *, case when value >= {HIGH} then event_type || '_high' else event_type end as category
               from ev),
  grouped as (select user_id as "user", case when user_id in
      (select user_id from everyone where {_in(MARKERS)}) then 'cohort' else 'control' end as grp from us)"""


def _groups(spark, sf_dir):
    posts, categorised = _posts(spark, sf_dir)
    users = event_users(posts)
    return users, categorised, cohorts.label_cohorts(users, categorised, MARKERS, "category")


@query("with" + GROUPS_SQL + """ select "user", grp as "group" from grouped""")
def cohort_split(spark, sf_dir):
    return _groups(spark, sf_dir)[2]


@query("with" + GROUPS_SQL + f""", flags as (select user_id as "user",
    bool_or({_in(SETS['clicks'])}) as c, bool_or({_in(SETS['buying'])}) as b,
    bool_or({_in(SETS['alarm'])}) as a from everyone group by 1)
  select grp as "group", count(*) as n_users, count(*) filter (c) as n_clicks,
    count(*) filter (b) as n_buying, count(*) filter (a) as n_alarm,
    round(count(*) filter (c) * 100 / count(*), 6) as pct_clicks,
    round(count(*) filter (b) * 100 / count(*), 6) as pct_buying,
    round(count(*) filter (a) * 100 / count(*), 6) as pct_alarm
  from grouped left join flags using ("user") group by 1""")
def ever_posted(spark, sf_dir):
    _, posts, groups = _groups(spark, sf_dir)
    out = cohorts.ever_posted(posts, groups, SETS, "category")
    pct = [f"pct_{n}" for n in SETS]
    return out.select("group", "n_users", *[f"n_{n}" for n in SETS], *r6(*pct))


def _volumes_sql(cycles: str) -> str:
    """Box of volumes: from cycles ("user", period) and posts to statistics per group and phase."""
    wanted = _in(sorted({x for s in SETS.values() for x in s}))
    raws = ", ".join(
        f"count(p.user_id) filter ({_in(s)}) as {n}_raw" for n, s in SETS.items()
    )
    vols = ", ".join(
        f"case when length_days > 0 then {n}_raw / length_days else 0 end as {n}_volume" for n in SETS
    )
    zs = ", ".join(
        f"({n}_volume - avg({n}_volume) over w) / case when stddev_samp({n}_volume) over w < 1e-10 "
        f"then 1.0 else stddev_samp({n}_volume) over w end as {n}_z, sum({n}_raw) over w > 0 as {n}_ever"
        for n in SETS
    )
    any_raw = " or ".join(f"{n}_raw > 0" for n in SETS)
    stats = ", ".join(
        f"round(coalesce(avg({n}_volume) filter ({any_raw}), 0), 6) as {n}_volume, "
        f"cast(sum({n}_raw) as bigint) as {n}_raw, "
        f"round(coalesce(avg({n}_z) filter ({n}_ever), 0), 6) as {n}_zscore, "
        f"count(*) filter ({n}_raw > 0) as n_users_{n}"
        for n in SETS
    )
    return f"""{cycles}, {four_phase_sql('cycles')},
  defs as (
    select "user", 'Menstrual' as phase, 4.0::double as length_days from bounded
    union all select "user", 'Follicular', ov - 4 from bounded
    union all select "user", 'Ovulation', 3.0 from bounded
    union all select "user", 'Luteal', le - ov - 2 from bounded),
  dated as (
    select p.* exclude (d), g.grp, b.ov, b.le, {pymod('offset_from_cd1', WRAP)} as d
    from posts p join grouped g on g."user" = p.user_id join bounded b on b."user" = p.user_id
    where offset_from_cd1 between -90 and 90 and {wanted}),
  phased as (select *, {PHASE_CASE} as phase from dated),
  members as (select distinct grp, user_id as "user" from phased where phase is not null),
  cells as (
    select m.grp, m."user", d.phase, any_value(d.length_days) as length_days,
      count(p.user_id) as n_posts, {raws}
    from members m join defs d using ("user")
      left join phased p on p.user_id = m."user" and p.phase = d.phase
    group by m.grp, m."user", d.phase),
  vols as (select *, {vols} from cells),
  scored as (select *, {zs} from vols window w as (partition by grp, "user"))
  select grp as "group", phase, count(*) filter (n_posts > 0) as n_users, {stats}
  from scored group by all"""


def _report_columns(df):
    stats = []
    for n in SETS:
        stats += [*r6(f"{n}_volume"), f"{n}_raw", *r6(f"{n}_zscore"), f"n_users_{n}"]
    return df.select("group", "phase", "n_users", *stats)


@query("with" + GROUPS_SQL + _volumes_sql(
    ", cycles as (select user_id as \"user\", 29.0::double as period from us)"))
def phase_volumes(spark, sf_dir):
    """Volumes by phase with the fallback length for everyone."""
    users, posts, groups = _groups(spark, sf_dir)
    placed = add_offsets(posts, users)
    return _report_columns(
        cohorts.cohort_report(placed, users, groups, None, SETS, "category")
    )


EVENT_CONSENSUS_SQL = (
    EVENT_PEAKS_SQL
    + ", kept as (select * from found where peak_to_background >= 3)"
    + CONSENSUS_SQL.format(tolerance=1, min_features=2)
)


@query("with" + EVENT_CONSENSUS_SQL + GROUPS_SQL.removeprefix(OFFSETS_SQL) + _volumes_sql(
    ', cycles as (select "user", consensus_period as period from elected)'))
def cohort_phase_report(spark, sf_dir):
    """Events to volumes by phase and group, on each user's own consensus period."""
    users, posts, groups = _groups(spark, sf_dir)
    placed = add_offsets(posts, users)
    voted = consensus.consensus_periods(
        clean.filter_snr(_event_peaks(spark, sf_dir), 3.0), min_features=2, tolerance=1
    )
    return _report_columns(
        cohorts.cohort_report(placed, users, groups, voted, SETS, "category")
    )


COUNTS_SQL = OFFSETS_SQL + """,
  c as (select user_id, count(*) filter (offset_from_cd1 < 0) as posts_before,
          count(*) filter (offset_from_cd1 > 0) as posts_after
        from placed where offset_from_cd1 <> 0 group by 1)"""


def _counts(spark, sf_dir):
    posts = event_posts(spark, sf_dir)
    return cohorts.before_after_counts(
        add_offsets(posts, event_users(posts)), "author", "offset_from_cd1"
    )


@query("with" + COUNTS_SQL + """
  select user_id as author, posts_before, posts_after,
    round(posts_after / nullif(posts_before, 0), 6) as ratio from c""")
def before_after_counts(spark, sf_dir):
    return _counts(spark, sf_dir).select("author", "posts_before", "posts_after", *r6("ratio"))


@query("with" + COUNTS_SQL + """
  select round(avg(posts_after / posts_before) filter (posts_before > 0 and posts_after > 0), 6) as mean_ratio,
    round(median(posts_after / posts_before) filter (posts_before > 0 and posts_after > 0), 6) as median_ratio,
    count(*) filter (posts_before > 0 and posts_after > 0) as n_users,
    count(*) filter (posts_after = 0) as n_users_before_only,
    count(*) filter (posts_before = 0) as n_users_after_only from c""")
def before_after_ratio(spark, sf_dir):
    return cohorts.before_after_summary(_counts(spark, sf_dir)).select(
        *r6("mean_ratio", "median_ratio"), "n_users", "n_users_before_only", "n_users_after_only"
    )

