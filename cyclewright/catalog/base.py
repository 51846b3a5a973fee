"""Registry of runnable queries and the table mappings they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cyclewright.operators.anchors import add_offsets, latest_per_key, placed_window
from cyclewright.operators.timeline import as_series, daily_means
from cyclewright.session import prepare

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function name, with the SQL that must agree with it."""

    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(prepare(spark), sf_dir)

        QUERIES[fn.__name__] = run
        if sql is not None:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(*names: str) -> list:
    """Columns rounded to six places under their own names."""
    return [F.round(n, 6).alias(n) for n in names]


# --- events as posts of users ------------------------------------------------


def event_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """author, ts_utc, subreddit, id, value and the number k of the properties."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("author"),
        F.col("ts").cast("timestamp").alias("ts_utc"),
        F.col("event_type").alias("subreddit"),
        F.col("event_id").alias("id"),
        "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


def event_users(posts: DataFrame) -> DataFrame:
    """Anchor of a user: the newest signup, with k mod 7 as its day."""
    newest = latest_per_key(
        posts.where(F.col("subreddit") == "signup"), "author", "ts_utc", "id", ["ts_utc", "k"]
    )
    return newest.select(
        F.col("author").alias("user"),
        F.col("ts_utc").alias("timestep"),
        (F.col("k") % 7).alias("offset_from_cd1"),
    )


EVENTS_SQL = r"""
ev as (
  select user_id, event_id, ts, cast(ts as date) as d, event_type, value,
         cast(regexp_extract(props, '"k": *([0-9]+)', 1) as integer) as k
  from events),
us as (
  select user_id, ts as anchor_ts, k % 7 as anchor_value from (
    select *, row_number() over (partition by user_id order by ts desc, event_id desc) as rn
    from ev where event_type = 'signup') where rn = 1)"""

# Offset of each event from the user's anchor.
OFFSETS_SQL = (
    EVENTS_SQL
    + """,
placed as (
  select ev.*, us.anchor_ts, us.anchor_value,
         cast(us.anchor_value + date_diff('day', cast(us.anchor_ts as date), ev.d) as integer)
           as offset_from_cd1
  from ev join us using (user_id))"""
)

EVENT_FEATURES = ["value_avg", "value_max", "n_events", "k_avg"]


def event_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four features per user and day relative to the anchor."""
    posts = event_posts(spark, sf_dir)
    placed = add_offsets(posts, event_users(posts))
    return (
        placed.where(F.col("offset_from_cd1").isNotNull())
        .groupBy("author", "offset_from_cd1")
        .agg(
            F.avg("value").alias("value_avg"),
            F.max("value").alias("value_max"),
            F.count(F.lit(1)).cast("double").alias("n_events"),
            F.avg("k").alias("k_avg"),
        )
    )


def event_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_series(event_daily(spark, sf_dir), "author", "offset_from_cd1", EVENT_FEATURES)


EVENT_SERIES_SQL = (
    OFFSETS_SQL
    + """,
daily as (
  select user_id, offset_from_cd1, avg(value) as value_avg, max(value) as value_max,
         cast(count(*) as double) as n_events, avg(k) as k_avg
  from placed group by all),
series as (
  select user_id as "user", offset_from_cd1 as day, feature, value
  from daily unpivot (value for feature in (value_avg, value_max, n_events, k_avg)))"""
)

# --- line items as daily series of suppliers ------------------------------------

ITEM_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
ITEM_MEANS = [f"{f}_mean" for f in ITEM_FEATURES]


def item_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("author"),
        F.col("l_shipdate").cast("timestamp").alias("ts_utc"),
        F.col("l_orderkey").alias("id"),
        "l_linenumber",
        "l_returnflag",
        *ITEM_FEATURES,
    )


def item_users(posts: DataFrame) -> DataFrame:
    """Anchor of a supplier: its newest returned line."""
    returned = posts.where(F.col("l_returnflag") == "R")
    return latest_per_key(returned, "author", "ts_utc", "id", ["ts_utc"]).select(
        F.col("author").alias("user"),
        F.col("ts_utc").alias("timestep"),
        F.lit(0).alias("offset_from_cd1"),
    )


def item_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines within three months of the supplier's anchor."""
    posts = item_posts(spark, sf_dir)
    return placed_window(posts, item_users(posts))


def item_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily_means(item_timeline(spark, sf_dir), ITEM_FEATURES, "author", "offset_from_cd1")


def item_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_series(item_daily(spark, sf_dir), "author", "offset_from_cd1", ITEM_MEANS)


ITEM_DAILY_SQL = """
anchor as (
  select l_suppkey, max(l_shipdate) as anchor_ts from lineitem
  where l_returnflag = 'R' group by 1),
item as (
  select l.*, cast(date_diff('day', cast(a.anchor_ts as date), cast(l.l_shipdate as date)) as integer)
           as offset_from_cd1
  from lineitem l join anchor a using (l_suppkey)
  where abs(floor((epoch_us(l.l_shipdate) - epoch_us(a.anchor_ts)) / 86400000000.0)) <= 91),
daily as (
  select l_suppkey as author, offset_from_cd1, avg(l_quantity) as l_quantity_mean,
         avg(l_extendedprice) as l_extendedprice_mean, avg(l_discount) as l_discount_mean,
         avg(l_tax) as l_tax_mean
  from item group by all)"""

ITEM_SERIES_SQL = (
    ITEM_DAILY_SQL
    + """,
series as (
  select author as "user", offset_from_cd1 as day, feature, value
  from daily unpivot (value for feature in
    (l_quantity_mean, l_extendedprice_mean, l_discount_mean, l_tax_mean)))"""
)

# --- spectra in SQL ------------------------------------------------------------------

# From ``series`` (user, feature, day, value) to scaled series that pass the gate.
PREPARED_SQL = """,
gate as (
  select "user", feature, count(*) as n_points, min(day) as d0, max(day) as d1,
         avg(value) as mu, stddev_pop(value) as sd
  from series group by all
  having count(*) >= 10 and max(day) - min(day) >= {min_span} and min(value) < max(value)
     and stddev_pop(value) / (stddev_pop(value) + 1e-10) >= 1e-10),
prepared as (
  select s."user", s.feature, s.day, (s.value - g.mu) / (g.sd + 1e-10) as y,
         g.n_points, g.d0, g.d1
  from series s join gate g using ("user", feature))"""

# Daily grid with linear interpolation, and its mean.
GRID_SQL = """,
links as (
  select *, lead(day) over w as day2, lead(y) over w as y2
  from prepared window w as (partition by "user", feature order by day)),
grid as (
  select "user", feature, n_points, d0, d1, g - d0 as i,
         case when g = day then y else y + (y2 - y) * ((g - day) * 1.0 / (day2 - day)) end as v
  from (select *, unnest(range(day, coalesce(day2, day + 1))) as g from links)),
centre as (select "user", feature, avg(v) as m, count(*) as n from grid group by all)"""

# Power of the bins in range, from one of two transform lengths.
LINES_SQL = """,
sized as (
  select *, {size} as nf from centre),
bins as (
  select * from (
    select "user", feature, m, n, nf, unnest(range(1, cast(nf // 2 as bigint))) as k from sized)
  where 1.0 / (k * (1.0 / nf)) between {low} and {high}),
lines as (
  select b."user", b.feature, b.nf, b.k, 1.0 / (b.k * (1.0 / b.nf)) as period,
         power(sum((g.v - b.m) * cos(2 * pi() * ((b.k * g.i) % b.nf) / b.nf)), 2)
         + power(sum((g.v - b.m) * sin(2 * pi() * ((b.k * g.i) % b.nf) / b.nf)), 2) as power
  from bins b join grid g using ("user", feature) group by b."user", b.feature, b.nf, b.k)"""

# Strongest line and its ratio to the median of the others.
PEAK_SQL = """,
ranked as (
  select *, row_number() over (partition by "user", feature order by power desc, {tie}) as rn
  from lines),
peaks as (
  select "user", feature, max(period) filter (rn = 1) as period,
         max(power) filter (rn = 1) as best, median(power) filter (rn > 1) as med
  from ranked group by all),
found as (
  select g."user", g.feature, cast({period} as integer) as period, coalesce(p.best, 0.0) as power,
         case when p.best is null then 0.0 else {snr} end as peak_to_background,
         g.n_points, cast(g.d1 - g.d0 as double) as span_days
  from gate g left join peaks p using ("user", feature))"""

UNCAPPED = "case when p.med is null then p.best / 1e-10 else p.best / (p.med + 1e-10) end"
CAPPED = (
    "case when p.med is null or p.med < 1e-10 then least(p.best / 1e-10, 1000.0) "
    "else p.best / (p.med + 1e-10) end"
)
PADDED = "cast(power(2, ceil(log2(n))) as bigint)"


def peak_sql(
    source: str,
    low: float,
    high: float,
    padded: bool = False,
    capped: bool = False,
    min_span: float | None = None,
) -> str:
    """CTEs from a source of ``series`` up to ``found``, one row per valid series."""
    return (
        source
        + PREPARED_SQL.format(min_span=low if min_span is None else min_span)
        + GRID_SQL
        + LINES_SQL.format(size=PADDED if padded else "n", low=low, high=high)
        + PEAK_SQL.format(
            tie="k", period="round_even(p.period, 0)", snr=CAPPED if capped else UNCAPPED
        )
    )


# Ratios reach from below 1 to power / 1e-10, so they are compared to six places of their logarithm.
LOG_RATIO_SQL = """case when peak_to_background > 0
         then round(log10(peak_to_background), 6) end as log10_peak_to_background"""
PEAK_COLUMNS = f""""user", feature, period, round(power, 6) as power,
       {LOG_RATIO_SQL}, n_points, span_days"""


def log_ratio(ratio: str = "peak_to_background") -> Column:
    return F.when(F.col(ratio) > 0, F.round(F.log10(ratio), 6)).alias(f"log10_{ratio}")


def peak_columns(df: DataFrame) -> DataFrame:
    """Result columns in comparable form."""
    return df.select(
        "user",
        "feature",
        "period",
        F.round("power", 6).alias("power"),
        log_ratio(),
        "n_points",
        "span_days",
    )
