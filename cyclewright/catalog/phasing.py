"""Queries: phase tables, phase assignment and features by phase."""

from __future__ import annotations

from pyspark.sql import functions as F

from cyclewright.catalog.base import (
    ITEM_DAILY_SQL,
    ITEM_FEATURES,
    ITEM_MEANS,
    item_daily,
    item_timeline,
    query,
    r6,
    table,
)
from cyclewright.catalog.cycles import ITEM_CONSENSUS_SQL, _item_consensus
from cyclewright.operators import contrasts, phases
from cyclewright.operators.scaling import zscore_daily_per_user


def four_phase_sql(source: str, cl: str = "period") -> str:
    """CTEs ``bounded`` (limits beside the rows of a source with a cycle length)."""
    return f"""
    bounded as (select *, greatest(3.0, {cl} - 21) + 4 as ov, floor({cl} - 1.0) as le from {source})"""


FOUR_ROWS = """
  select "user", 0 as phase_order, 'Menstrual' as phase, 0.0::double as start_day, 3.0::double as end_day from bounded
  union all select "user", 1, 'Follicular', 4.0, ov - 1 from bounded
  union all select "user", 2, 'Ovulation', ov, ov + 2 from bounded
  union all select "user", 3, 'Luteal', ov + 3, le from bounded"""

PHASE_CASE = """case
    when d between 0 and 3 then 'Menstrual' when d between 4 and ov - 1 then 'Follicular'
    when d between ov and ov + 2 then 'Ovulation' when d between ov + 3 and le then 'Luteal' end"""

WRAP = "greatest(ov + 2, le) + 1"


def pymod(a: str, b: str) -> str:
    """Modulo with the sign of the divisor."""
    return f"({a} - ({b}) * floor({a} / ({b})))"


LENGTHS_SQL = """lengths as (
  select s_suppkey as "user", cast(18 + s_suppkey % 19 as double) + 0.5 * (s_suppkey % 2) as period from supplier)"""


def _lengths(spark, sf_dir):
    """Cycle lengths from 18 to 36 days, every other one with half a day."""
    key = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        key.alias("user"), (18 + key % 19 + 0.5 * (key % 2)).cast("double").alias("period")
    )


@query(f"with {LENGTHS_SQL}, {four_phase_sql('lengths')}" + """
  select *, end_day - start_day + 1 as length_days from (""" + FOUR_ROWS + ")")
def phase_table(spark, sf_dir):
    return phases.phase_table(_lengths(spark, sf_dir))


@query(f"with {LENGTHS_SQL}, {four_phase_sql('lengths')}" + """
  select *, end_day - start_day + 1 as length_days from (""" + FOUR_ROWS.replace(
    "union all select \"user\", 3, 'Luteal', ov + 3, le from bounded",
    "union all select \"user\", 3, 'Early Luteal', ov + 3, ov + 9 from bounded "
    "union all select \"user\", 4, 'Late Luteal', ov + 10, le from bounded",
) + ")")
def split_phase_table(spark, sf_dir):
    return phases.phase_table(_lengths(spark, sf_dir), split_luteal=True)


FIVE_SQL = f"""{LENGTHS_SQL},
  five as (select *, round_even(period, 0) as cl, round_even(period, 0) - 14 as mid from lengths)"""


@query(f"with {FIVE_SQL}" + """
  select "user", mid < 10 as early, * exclude ("user", mid) from (
  select "user", mid, 'Perimenstrual' as phase, -3.0::double as start_day, 2.0::double as end_day from five
  union all select "user", mid, 'Midfollicular', greatest(mid - 7, 3), mid - 3 from five
  union all select "user", mid, 'Periovulatory', mid - 2, mid + 1 from five
  union all select "user", mid, 'Early Luteal', mid + 2, least(mid + 5, cl - 10) from five
  union all select "user", mid, 'Midluteal', cl - 9, cl - 5 from five)""")
def five_phase_table(spark, sf_dir):
    return phases.five_phase_table(_lengths(spark, sf_dir))


@query(f"with {FIVE_SQL},{ITEM_DAILY_SQL}, placed as (select item.*, five.period, cl, mid, "
       f"{pymod('offset_from_cd1', 'period')} as d from item join five on five.\"user\" = l_suppkey)" + """
  select l_orderkey as id, l_linenumber, offset_from_cd1, case
    when d >= cl - 3 or d <= 2 then 'Perimenstrual'
    when d between greatest(mid - 7, 3) and mid - 3 then 'Midfollicular'
    when d between mid - 2 and mid + 1 then 'Periovulatory'
    when d between mid + 2 and least(mid + 5, cl - 10) then 'Early Luteal'
    when d between cl - 9 and cl - 5 then 'Midluteal' end as phase from placed""")
def five_phase_days(spark, sf_dir):
    placed = phases.with_cycle_length(
        item_timeline(spark, sf_dir), _lengths(spark, sf_dir)
    )
    return phases.assign_five_phases(placed, "offset_from_cd1", "period").select(
        "id", "l_linenumber", "offset_from_cd1", "phase"
    )


PHASED_SQL = f"""{LENGTHS_SQL}, {four_phase_sql('lengths')},{ITEM_DAILY_SQL},
  placed as (select item.*, ov, le, {pymod('offset_from_cd1', WRAP)} as d
             from item left join bounded on bounded."user" = l_suppkey)"""


@query(f"with {PHASED_SQL} select l_orderkey as id, l_linenumber, offset_from_cd1, {PHASE_CASE} as phase from placed")
def phase_of_day(spark, sf_dir):
    """Phases from the stored table of each user."""
    table_of_phases = phases.phase_table(_lengths(spark, sf_dir))
    phased = phases.assign_phases(
        item_timeline(spark, sf_dir), table_of_phases
    )
    return phased.select("id", "l_linenumber", "offset_from_cd1", "phase")


@query(f"with {PHASED_SQL} select l_orderkey as id, l_linenumber, offset_from_cd1, {PHASE_CASE} as phase from placed")
def phase_by_length(spark, sf_dir):
    """The same phases by arithmetic on the joined cycle length."""
    placed = phases.with_cycle_length(
        item_timeline(spark, sf_dir), _lengths(spark, sf_dir)
    )
    return phases.assign_phases_by_length(placed, "period").select(
        "id", "l_linenumber", "offset_from_cd1", "phase"
    )


@query(f"with fixed as (select 28.0::double as period), {four_phase_sql('fixed')},{ITEM_DAILY_SQL}, "
       f"placed as (select item.*, ov, le, {pymod('offset_from_cd1', WRAP)} as d from item, bounded)"
       f" select l_orderkey as id, l_linenumber, {PHASE_CASE} as phase from placed")
def fixed_cycle_phases(spark, sf_dir):
    fixed = phases.with_fixed_cycle_length(item_timeline(spark, sf_dir), 28)
    return phases.assign_phases_by_length(fixed, "period").select("id", "l_linenumber", "phase")


@query(f"with {ITEM_DAILY_SQL}, pairs as (select distinct o_custkey % 100 as k, o_orderstatus as s from orders)" + """
  select author, offset_from_cd1, s as period from daily left join pairs on k = author""")
def cycle_length_join(spark, sf_dir):
    """A user with several cycle lengths fans out; one without keeps a null."""
    pairs = (
        table(spark, sf_dir, "orders")
        .select((F.col("o_custkey") % 100).alias("user"), F.col("o_orderstatus").alias("period"))
    )
    joined = phases.with_cycle_length(item_daily(spark, sf_dir), pairs)
    return joined.select("author", "offset_from_cd1", "period")


# Daily z-scores (sample deviation, constants 0) with the phase of the consensus period.
BY_PHASE_SQL = (
    ITEM_CONSENSUS_SQL
    + f""",
  cycles as (select "user", consensus_period as period from elected), {four_phase_sql('cycles')},
  scaled as (
    select author, offset_from_cd1, feature,
      (v - avg(v) over (partition by author, feature))
        / (stddev_samp(v) over (partition by author, feature) + 1e-10) as z
    from daily unpivot (v for feature in
      (l_quantity_mean, l_extendedprice_mean, l_discount_mean, l_tax_mean))),
  placed as (select s.*, ov, le, {pymod('offset_from_cd1', WRAP)} as d
             from scaled s join bounded on bounded."user" = author
             where offset_from_cd1 between -60 and 60),
  phased as (select author, feature, z as v, {PHASE_CASE} as phase from placed),
  known as (select * from phased where phase is not null and v is not null)"""
)


def _cycles(spark, sf_dir):
    return _item_consensus(spark, sf_dir).select("user", F.col("consensus_period").alias("period"))


@query("with" + BY_PHASE_SQL + """, per_user as (
    select feature, phase, author, avg(v) as m, count(*) as days from known group by all)
  select feature, phase, round(avg(m), 6) as mean, round(stddev_samp(m), 6) as std,
    round(stddev_samp(m) / sqrt(count(*)), 6) as sem, cast(sum(days) as bigint) as n_user_days,
    count(*) as n_users from per_user group by all""")
def feature_by_phase(spark, sf_dir):
    out = contrasts.features_by_phase(
        item_daily(spark, sf_dir),
        ITEM_MEANS,
        _cycles(spark, sf_dir),
        time_window=(-60, 60),
    )
    return out.select("feature", "phase", *r6("mean", "std", "sem"), "n_user_days", "n_users")


@query("with" + BY_PHASE_SQL + """
  select feature, phase, round(avg(v), 6) as mean, round(stddev_samp(v), 6) as std,
    round(stddev_samp(v) / sqrt(count(*)), 6) as sem, count(*) as n_user_days,
    count(distinct author) as n_users from known group by all""")
def feature_by_phase_days(spark, sf_dir):
    out = contrasts.features_by_phase(
        item_daily(spark, sf_dir),
        ITEM_MEANS,
        _cycles(spark, sf_dir),
        time_window=(-60, 60),
        average_per_user=False,
    )
    return out.select("feature", "phase", *r6("mean", "std", "sem"), "n_user_days", "n_users")


ITEM_PHASED_SQL = f"""{LENGTHS_SQL}, {four_phase_sql('lengths')},{ITEM_DAILY_SQL},
  placed as (select daily.*, ov, le, {pymod('offset_from_cd1', WRAP)} as d
             from daily join bounded on bounded."user" = author),
  phased as (select *, {PHASE_CASE} as phase from placed)"""


def _phased_daily(spark, sf_dir):
    placed = phases.with_cycle_length(
        item_daily(spark, sf_dir), _lengths(spark, sf_dir)
    )
    return phases.assign_phases_by_length(placed, "period")


@query(f"with {ITEM_PHASED_SQL}" + """, m as (
    select phase, feature, avg(v) as m from (select phase, l_quantity_mean, l_discount_mean,
      l_extendedprice_mean, l_tax_mean from phased where phase is not null) unpivot (v for feature in
      (l_quantity_mean, l_discount_mean, l_extendedprice_mean, l_tax_mean)) group by all)
  select feature, round(max(m) - min(m), 6) as max_min_diff,
    arg_max(phase, m) as max_phase, arg_min(phase, m) as min_phase,
    round(max(m), 6) as mean_max, round(min(m), 6) as mean_min from m group by 1""")
def phase_range(spark, sf_dir):
    return contrasts.phase_range(_phased_daily(spark, sf_dir)).select(
        "feature",
        *r6("max_min_diff"),
        "max_phase",
        "min_phase",
        *r6("mean_max", "mean_min"),
    )


@query(f"with {ITEM_PHASED_SQL}" + """
  select phase, count(distinct author) as n_users, count(*) as n_user_days
  from phased where phase is not null group by 1""")
def phase_day_counts(spark, sf_dir):
    return contrasts.phase_counts(_phased_daily(spark, sf_dir), "author")


@query(f"with {ITEM_PHASED_SQL}" + """, z as (
    select author, phase, case when stddev_samp(l_quantity_mean) over w >= 1e-10 then
        (l_quantity_mean - avg(l_quantity_mean) over w) / (stddev_samp(l_quantity_mean) over w + 1e-10)
      end as l_quantity_zscore, l_extendedprice_mean, l_discount_mean, l_tax_mean
    from phased window w as (partition by author)),
  spread as (select author, max(l_quantity_zscore) - min(l_quantity_zscore) as l_quantity,
      max(l_extendedprice_mean) - min(l_extendedprice_mean) as l_extendedprice,
      max(l_discount_mean) - min(l_discount_mean) as l_discount,
      max(l_tax_mean) - min(l_tax_mean) as l_tax from z group by 1),
  seen as (select distinct l_suppkey as author, cast(floor(offset_from_cd1 / 30.5) as integer) as m
           from item where offset_from_cd1 >= 0 and offset_from_cd1 / 30.5 < 6)
  select feature, m || '-' || (m + 1) as months_bin, round(avg(v), 6) as max_min_diff,
    count(*) as n_users, round(stddev_pop(v), 6) as std_max_min
  from (select * from seen join spread using (author)) unpivot (v for feature in (l_quantity, l_extendedprice, l_discount, l_tax))
  group by all""")
def fading(spark, sf_dir):
    daily = zscore_daily_per_user(_phased_daily(spark, sf_dir), ["l_quantity_mean"], "author")
    return contrasts.signal_fading(
        item_timeline(spark, sf_dir), daily, ITEM_FEATURES
    ).select("feature", "months_bin", *r6("max_min_diff"), "n_users", *r6("std_max_min"))


