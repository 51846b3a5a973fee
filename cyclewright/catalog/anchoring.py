"""Queries: anchors, windows, set logic and sources on event and line-item tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cyclewright.catalog.base import (
    EVENTS_SQL,
    ITEM_DAILY_SQL,
    OFFSETS_SQL,
    event_posts,
    event_users,
    item_posts,
    item_users,
    query,
    r6,
    table,
)
from cyclewright.operators import anchors, clean, summaries, timeline
from cyclewright.settings import NON_FEATURE_COLUMNS
from cyclewright.sources import readers, snapshots


@query("with" + EVENTS_SQL + """
  select user_id as "user", epoch_us(anchor_ts) as anchor_us, anchor_value from us""")
def latest_anchor(spark, sf_dir):
    return event_users(event_posts(spark, sf_dir)).select(
        "user", F.unix_micros("timestep").alias("anchor_us"), F.col("offset_from_cd1").alias("anchor_value")
    )


@query("""select event_id as id, user_id as author from events
          where user_id in (select user_id from events where event_type = 'purchase')""")
def keep_target_users(spark, sf_dir):
    posts = event_posts(spark, sf_dir)
    buyers = posts.where(F.col("subreddit") == "purchase").select("author")
    return anchors.keep_users(posts, buyers.distinct(), "author").select("id", "author")


@query("with" + EVENTS_SQL + """
  select event_id as id, ev.user_id as author from ev
  where not exists (select 1 from us where us.user_id = ev.user_id and us.anchor_ts = ev.ts)""")
def drop_anchor_rows(spark, sf_dir):
    posts = event_posts(spark, sf_dir)
    return anchors.split_anchor_posts(posts, event_users(posts)).select("id", "author")


@query("with" + EVENTS_SQL + """, late as (
    select user_id, ts + interval 7 hour as anchor_ts from (
      select *, row_number() over (partition by user_id order by ts desc, event_id desc) as rn
      from ev where event_type = 'signup') where rn = 1)
  select event_id as id, user_id as author,
    cast(floor((epoch_us(ts) - epoch_us(anchor_ts)) / 86400000000.0) as bigint) as elapsed,
    cast(date_diff('day', cast(anchor_ts as date), cast(ts as date)) as integer) as calendar
  from ev join late using (user_id)
  where abs(floor((epoch_us(ts) - epoch_us(anchor_ts)) / 86400000000.0)) <= 9""")
def elapsed_and_calendar_days(spark, sf_dir):
    """Both day measures beside each other; the window is on elapsed days."""
    posts = event_posts(spark, sf_dir)
    late = event_users(posts).withColumn(
        "timestep", F.col("timestep") + F.expr("interval 7 hours")
    )
    joined = anchors.with_anchor(posts, late, "author", "offset_from_cd1", "inner")
    elapsed = anchors.elapsed_days(F.col("ts_utc"), F.col("anchor_ts"))
    return joined.select(
        "id",
        "author",
        elapsed.alias("elapsed"),
        anchors.calendar_days(F.col("ts_utc"), F.col("anchor_ts")).alias("calendar"),
    ).where(F.abs("elapsed") <= 9)


@query("with" + ITEM_DAILY_SQL + """
  select l_orderkey as id, l_linenumber, l_suppkey as author
  from lineitem l join anchor a using (l_suppkey)
  where abs(floor((epoch_us(l.l_shipdate) - epoch_us(a.anchor_ts)) / 86400000000.0)) <= 61""")
def elapsed_window(spark, sf_dir):
    posts = item_posts(spark, sf_dir)
    kept = anchors.within_months(posts, item_users(posts), months=2)
    return kept.select("id", "l_linenumber", "author")


@query("with" + ITEM_DAILY_SQL + """
  select l_orderkey as id, l_linenumber, l_suppkey as author
  from lineitem l join anchor a using (l_suppkey)
  where abs(date_diff('day', cast(a.anchor_ts as date), cast(l.l_shipdate as date))) <= 365""")
def calendar_window(spark, sf_dir):
    posts = item_posts(spark, sf_dir)
    kept = anchors.within_calendar_days(posts, item_users(posts))
    return kept.select("id", "l_linenumber", "author")


def _turns(spark, sf_dir):
    """Conversation turns dated four days apart."""
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("author"),
        "turn",
        "role",
        "text",
        F.timestamp_seconds(F.lit(1704067200) + F.col("turn") * 345600 + F.col("conv_id") * 977).alias(
            "ts_utc"
        ),
        F.when(F.col("role") == "user", "post").otherwise("comment").alias("source"),
    )


TURNS_SQL = """
turns as (
  select conv_id as author, turn, role, text, case when role = 'user' then 'post' else 'comment' end as source,
         make_timestamp((1704067200 + turn * 345600 + conv_id * 977) * 1000000) as ts_utc
  from conversations),
starts as (select author, min(ts_utc) as anchor_ts from turns where role = 'user' group by 1)"""


@query("with" + TURNS_SQL + """
  select author, epoch_us(ts_utc) as ts_us, md5(text) as text_md5, source,
         cast(3 + date_diff('day', cast(anchor_ts as date), cast(ts_utc as date)) as integer) as offset_from_cd1
  from turns join starts using (author)
  where abs(date_diff('day', cast(anchor_ts as date), cast(ts_utc as date))) <= 14""")
def unified_timeline(spark, sf_dir):
    turns = _turns(spark, sf_dir)
    posts, comments = (turns.where(F.col("source") == s) for s in ("post", "comment"))
    users = posts.groupBy(F.col("author").alias("user")).agg(
        F.min("ts_utc").alias("timestep"), F.lit(3).alias("offset_from_cd1")
    )
    return timeline.unified_timeline(users, comments, posts, days=14).select(
        "author",
        F.unix_micros("ts_utc").alias("ts_us"),
        F.md5("text").alias("text_md5"),
        "source",
        "offset_from_cd1",
    )


@query("""with a as (select user_id, max(ts) as t from events where event_type = 'error' group by 1),
  b as (select user_id, max(ts) as t from events where event_type = 'purchase' group by 1)
  select user_id as "user", epoch_us(t) as ts_us, 'first' as grp from a
  union all
  select user_id, epoch_us(t), 'second' from b where user_id not in (select user_id from a)""")
def priority_groups(spark, sf_dir):
    posts = event_posts(spark, sf_dir)

    def group(kind):
        newest = anchors.latest_per_key(
            posts.where(F.col("subreddit") == kind), "author", "ts_utc", "id", ["ts_utc"]
        )
        return newest.select(F.col("author").alias("user"), F.unix_micros("ts_utc").alias("ts_us"))

    first, second = group("error"), group("purchase")
    return first.withColumn("grp", F.lit("first")).unionByName(
        anchors.without_users_of(second, first).withColumn("grp", F.lit("second"))
    )


DEDUP_SQL = """with stacked as (
    select event_id, ts, user_id, event_type, value,
      nullif(cast(regexp_extract(props, '"k": *([0-9]+)', 1) as integer), 50) as id,
      list_position(['view', 'click', 'signup', 'purchase', 'error'], event_type) as src
    from events where user_id in (select user_id from events where event_type = 'signup'))
  select id, event_id, user_id as author, event_type, round(value, 6) as value from (
    select *, row_number() over (partition by id order by src, event_id) as rn from stacked)
  where rn = 1"""


@query(DEDUP_SQL)
def dedup_first(spark, sf_dir):
    """A source for each kind of event, of the users who signed up, first row per id; the null id is one key."""
    posts = event_posts(spark, sf_dir).withColumnsRenamed({"id": "event_id", "subreddit": "event_type"})
    rows = posts.withColumn("id", F.nullif(F.col("k"), F.lit(50)))
    users = posts.where(F.col("event_type") == "signup").select(
        F.col("author").cast("string").alias("user")
    )
    kinds = ("view", "click", "signup", "purchase", "error")
    sources = [rows.where(F.col("event_type") == e) for e in kinds]
    return readers.load_posts(sources, users.distinct(), "id", "event_id").select(
        "id", "event_id", F.col("author").cast("long").alias("author"), "event_type", *r6("value")
    )


@query("""with c as (select distinct user_id from events where event_type = 'error'),
  s as (select distinct user_id from events where event_type = 'signup')
  select user_id as "user", 'both' as part from (select * from c intersect select * from s)
  union all select user_id, 'only_first' from (select * from c except select * from s)
  union all select user_id, 'either' from (select * from c union select * from s)""")
def user_set_operations(spark, sf_dir):
    posts = event_posts(spark, sf_dir)

    def users(kind):
        rows = posts.where(F.col("subreddit") == kind)
        return rows.select(F.col("author").alias("user")).distinct()

    first, second = users("error"), users("signup")
    parts = {
        "both": first.intersect(second),
        "only_first": first.subtract(second),
        "either": first.union(second).distinct(),
    }
    out = None
    for name, df in parts.items():
        labelled = df.withColumn("part", F.lit(name))
        out = labelled if out is None else out.unionByName(labelled)
    return out


@query("with" + OFFSETS_SQL + """
  select user_id as author, offset_from_cd1, event_id as id from placed order by user_id, ts""")
def timeline_order(spark, sf_dir):
    """Dated timeline sorted by user and time: a range-partitioned sort on both columns."""
    posts = event_posts(spark, sf_dir)
    placed = clean.with_offset(anchors.add_offsets(posts, event_users(posts)))
    return placed.orderBy("author", "ts_utc").select("author", "offset_from_cd1", "id")


@query("""select event_id as id, user_id as author, event_type as subreddit from events
          where event_type in ('click', 'error') and user_id in (
            select user_id from events where event_type = 'signup')""")
def scan_categories(spark, sf_dir):
    posts = event_posts(spark, sf_dir)
    users = posts.where(F.col("subreddit") == "signup").select(F.col("author").alias("user"))
    early = F.col("ts_utc") < F.lit("2024-01-15").cast("timestamp")
    found = readers.scan_categories(
        [posts.where(early), posts.where(~early)],
        ["click", "error"],
        "subreddit",
        users.distinct(),
    )
    return found.select("id", "author", "subreddit")


@query("select event_id as id, event_type as subreddit from events where event_type not in ('view', 'click')")
def drop_categories(spark, sf_dir):
    return clean.drop_categories(event_posts(spark, sf_dir), ["view", "click"], "subreddit").select(
        "id", "subreddit"
    )


@query("""select event_id as id, strftime(cast(ts as date), '%Y-%m-%d') as run_ts from events
          where cast(ts as date) = (select max(cast(ts as date)) from events)""")
def newest_snapshot(spark, sf_dir):
    """Newest run only, where every day of events is a run."""
    runs = event_posts(spark, sf_dir).withColumn(
        snapshots.RUN, F.date_format("ts_utc", "yyyy-MM-dd")
    )
    return snapshots.newest_run(runs).select("id", "run_ts")


@query("""with e as (select user_id, event_type, nullif(value, 6.55) as value,
    nullif(cast(regexp_extract(props, '"k": *([0-9]+)', 1) as integer), 50) as k from events)
  select count(*) as n_rows, 'value' as column_name, round(avg(case when value is null then 1 else 0 end), 6) as null_share from e
  union all select count(*), 'k', round(avg(case when k is null then 1 else 0 end), 6) from e
  union all select count(*), 'author', round(avg(case when user_id is null then 1 else 0 end), 6) from e""")
def null_profile(spark, sf_dir):
    rows = event_posts(spark, sf_dir).withColumns(
        {"k": F.nullif(F.col("k"), F.lit(50)), "value": F.nullif(F.col("value"), F.lit(6.55))}
    )
    return summaries.null_profile(rows, ["value", "k", "author"]).select(
        "n_rows", "column_name", *r6("null_share")
    )


HOLES_SQL = """with e as (select event_id, user_id,
    nullif(cast(regexp_extract(props, '"k": *([0-9]+)', 1) as integer), 50) as k from events)"""


def _with_holes(spark, sf_dir):
    return event_posts(spark, sf_dir).withColumn("k", F.nullif(F.col("k"), F.lit(50)))


@query(HOLES_SQL + """ select event_id as id, user_id as author, k from e
  where user_id not in (select user_id from e where k is null)""")
def drop_incomplete_users(spark, sf_dir):
    return timeline.drop_incomplete_users(
        _with_holes(spark, sf_dir), ["k", "value"]
    ).select("id", "author", "k")


@query(HOLES_SQL + " select distinct user_id as author from e where k is null")
def incomplete_users(spark, sf_dir):
    return timeline.incomplete_users(_with_holes(spark, sf_dir), ["k", "value"])


@query("""select event_type as subreddit, count(*) as post_count,
    round(count(*) * 100.0 / (select count(*) from events), 2) as percentage
  from events group by 1 having count(*) >= 100 order by 2 desc, 1 limit 3""")
def category_share_topk(spark, sf_dir):
    return summaries.category_shares(event_posts(spark, sf_dir), "subreddit", 100, 3)


@query("with" + EVENTS_SQL + """
  select min(anchor_value) as min_offset, max(anchor_value) as max_offset,
    round(avg(anchor_value), 6) as mean_offset, median(anchor_value) as median_offset,
    count(*) as n_users from us""")
def offset_summary(spark, sf_dir):
    return summaries.offset_summary(event_users(event_posts(spark, sf_dir))).select(
        "min_offset", "max_offset", *r6("mean_offset"), "median_offset", "n_users"
    )


@query("""with r as (select event_type, event_id, row_number() over (
      partition by event_type order by md5('42:' || event_id), event_id) as rn from events)
  select event_type as subreddit, event_id as id,
    cast(row_number() over (partition by event_type order by event_id) as integer) as sample_index,
    30 as sample_size_target
  from r where rn <= 30""")
def group_sample(spark, sf_dir):
    return summaries.sample_per_group(event_posts(spark, sf_dir), "subreddit", "id").select(
        "subreddit", "id", "sample_index", "sample_size_target"
    )


@query("select event_id as id from events order by md5('7:' || event_id), event_id limit 500")
def random_rows(spark, sf_dir):
    return clean.random_rows(event_posts(spark, sf_dir), 500, "id", seed=7).select("id")


@query("""with u as (select c_custkey as "user", 'pattern_' || (1 + c_custkey % 9) as pattern_category from customer)
  select * from u where pattern_category = 'pattern_4' order by md5('42:' || "user"), "user" limit 50""")
def users_of_pattern(spark, sf_dir):
    users = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("user"),
        F.concat(F.lit("pattern_"), 1 + F.col("c_custkey") % 9).alias("pattern_category"),
    )
    return summaries.users_of_pattern(users, "pattern_4")


@query("""select c_custkey as "user", 'pattern_' || (1 + c_custkey % 9) as pattern_category
          from customer where c_custkey % 9 = 6""")
def users_by_pattern(spark, sf_dir):
    users = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("user"),
        F.concat(F.lit("pattern_"), 1 + F.col("c_custkey") % 9).alias("pattern_category"),
    )
    return readers.load_users(users, "pattern_7")


@query("""select 'pattern_' || (1 + c_custkey % 9) as pattern_category, count(*) as count
          from customer group by 1""")
def pattern_distribution(spark, sf_dir):
    users = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("pattern_"), 1 + F.col("c_custkey") % 9).alias("pattern_category")
    )
    return summaries.value_counts(users, "pattern_category")


@query("with" + OFFSETS_SQL + """
  select event_id as id, cast(anchor_value + date_diff('day', cast(anchor_ts as date), d) + 10 as integer) as dpo_days
  from placed""")
def offsets_from_ovulation(spark, sf_dir):
    """Offsets in the days-past-ovulation form of the users table."""
    posts = event_posts(spark, sf_dir)
    users = event_users(posts).withColumn("dpo_days", F.col("offset_from_cd1") + 10)
    placed = anchors.add_offsets(posts, users, anchor_value="dpo_days")
    return placed.where(F.col("dpo_days").isNotNull()).select("id", "dpo_days")


@query("with" + OFFSETS_SQL + """
  select event_id as id, cast(anchor_value + date_diff('day', cast(anchor_ts as date), d) + 10 as integer) as dpo_days
  from placed where abs(floor((epoch_us(ts) - epoch_us(anchor_ts)) / 86400000000.0)) <= 30""")
def window_from_ovulation(spark, sf_dir):
    """The one-month window around anchors that are days past ovulation."""
    posts = event_posts(spark, sf_dir)
    users = event_users(posts).withColumn("dpo_days", F.col("offset_from_cd1") + 10)
    placed = anchors.placed_window(posts, users, months=1, anchor_value="dpo_days")
    return placed.select("id", "dpo_days")


@query("""with names as (select unnest(['l_discount', 'l_extendedprice', 'l_linenumber', 'l_quantity', 'l_tax']) as feature),
  sums as (select sum(l_discount) as l_discount, sum(l_extendedprice) as l_extendedprice,
    cast(sum(l_linenumber) as double) as l_linenumber, sum(l_quantity) as l_quantity, sum(l_tax) as l_tax from lineitem)
  select feature, round(total, 2) as total from sums unpivot (total for feature in
    (l_discount, l_extendedprice, l_linenumber, l_quantity, l_tax))""")
def feature_totals(spark, sf_dir):
    """Features found by type and name, and their sums over the whole table."""
    rows = table(spark, sf_dir, "lineitem")
    keys = ["l_orderkey", "l_partkey", "l_suppkey"]
    names = clean.feature_columns(rows, [*NON_FEATURE_COLUMNS, *keys])
    sums = rows.agg(*[F.sum(n).cast("double").alias(n) for n in names])
    return sums.unpivot([], names, "feature", "total").select("feature", F.round("total", 2).alias("total"))
