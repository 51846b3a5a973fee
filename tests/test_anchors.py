import datetime as dt

import pytest
from pyspark.sql import functions as F

from cyclewright.operators import anchors, clean, summaries, timeline
from cyclewright.operators.scaling import zscore_posts_per_user
from cyclewright.plans.jobs import build_timeline, prepare_posts, user_cycles
from cyclewright.plans.joins import lookup_join


def ts(day, hour=0):
    return dt.datetime(2024, 3, 1, tzinfo=dt.timezone.utc) + dt.timedelta(days=day, hours=hour)


def posts(spark, rows):
    return spark.createDataFrame(rows, "author string, ts_utc timestamp, id int")


def users(spark, rows):
    return spark.createDataFrame(rows, "user string, timestep timestamp, offset_from_cd1 double")


def test_offsets_are_calendar_days_plus_the_anchor_value(spark):
    p = posts(spark, [("a", ts(3, 1), 1), ("a", ts(-1, 23), 2), ("b", ts(0), 3), ("c", ts(0), 4)])
    u = users(spark, [("a", ts(0, 23), 8.9), ("b", ts(1), None)])
    got = {r["id"]: r["offset_from_cd1"] for r in anchors.add_offsets(p, u).collect()}
    assert got == {1: 11, 2: 7, 3: None, 4: None}
    dpo = u.withColumnRenamed("offset_from_cd1", "dpo_days")
    assert "dpo_days" in anchors.add_offsets(p, dpo, anchor_value="dpo_days").columns


def test_window_is_elapsed_days(spark):
    u = users(spark, [("a", ts(0, 12), 0.0)])
    rows = [("a", ts(91, 12), 1), ("a", ts(92, 11), 2), ("a", ts(92, 12), 3), ("a", ts(-91, 12), 4)]
    rows += [("a", ts(-91, 11), 5), ("x", ts(0), 6)]
    p = posts(spark, rows)
    assert {r["id"] for r in anchors.within_months(p, u).collect()} == {1, 2, 4}
    hour = posts(spark, [("a", ts(0, 11), 1)]).withColumn("anchor", F.lit(ts(0, 12)))
    assert hour.select(anchors.elapsed_days(F.col("ts_utc"), F.col("anchor"))).first()[0] == -1
    assert hour.select(anchors.calendar_days(F.col("ts_utc"), F.col("anchor"))).first()[0] == 0
    placed = anchors.placed_window(p, u).orderBy("id").collect()
    assert [(r["id"], r["offset_from_cd1"]) for r in placed] == [(1, 91), (2, 92), (4, -91)]


def test_calendar_window_is_inclusive(spark):
    u = users(spark, [("a", ts(0, 12), 0.0)])
    p = posts(spark, [("a", ts(5, 23), 1), ("a", ts(6), 2), ("a", ts(-5), 3)])
    assert {r["id"] for r in anchors.within_calendar_days(p, u, days=5).collect()} == {1, 3}


def test_anchor_posts_go_with_all_posts_of_that_time(spark):
    p = posts(spark, [("a", ts(0), 1), ("a", ts(0), 2), ("a", ts(0, 1), 3), ("b", ts(0), 4)])
    u = users(spark, [("a", ts(0), 0.0)])
    assert {r["id"] for r in anchors.split_anchor_posts(p, u).collect()} == {3, 4}
    both = build_timeline(p, u), build_timeline(p, u, keep_anchors=False)
    assert [df.count() for df in both] == [3, 1]


def test_latest_row_breaks_ties_by_id(spark):
    p = posts(spark, [("a", ts(1), 1), ("a", ts(1), 2), ("a", ts(0), 3), ("b", ts(0), 4)])
    got = anchors.latest_per_key(p, "author", "ts_utc", "id", ["id", "ts_utc"]).collect()
    assert {r["author"]: r["id"] for r in got} == {"a": 2, "b": 4}


def test_lower_group_loses_shared_users(spark):
    upper = spark.createDataFrame([("a",), ("b",)], "user string")
    lower = spark.createDataFrame([("b",), ("c",)], "user string")
    assert [r["user"] for r in anchors.without_users_of(lower, upper).collect()] == ["c"]


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_lookup_join_equals_a_plain_join_on_a_hot_key(spark, no_broadcast, how):
    """A third of the rows has one key; the shuffled form gives the same rows."""
    facts = spark.range(9000).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k")
    )
    lookup = spark.range(40).select((F.col("id") * 2).alias("k"), (F.col("id") + 100).alias("v"))
    if how.startswith("left_"):
        lookup = lookup.select("k")
    got = lookup_join(facts, lookup, ["k"], how)
    want = facts.join(lookup, "k", how)
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(want.columns)
    assert sorted(map(str, got.select(cols).collect())) == sorted(map(str, want.select(cols).collect()))


def test_lookup_join_splits_a_hot_key(spark, no_broadcast):
    """A key with a third of the rows is several tasks, and the lookup is not multiplied."""
    facts = spark.range(0, 60_000, 1, 16).select(
        F.sha2(F.col("id").cast("string"), 256).alias("text"),
        F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("k"),
    )
    lookup = facts.groupBy("k").agg(F.count("*").alias("v"))
    small = {
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "8k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.1",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.shuffle.partitions": "32",
    }
    old = {k: spark.conf.get(k) for k in small}
    for k, v in small.items():
        spark.conf.set(k, v)
    try:
        joined = lookup_join(facts, lookup, ["k"])
        dealt = joined.select("text", "k", F.spark_partition_id().alias("p")).where("k = 1")
        tasks = len(dealt.groupBy("p").agg(F.max("text")).collect())
        hot = joined.where("k = 1").agg(F.count("*").alias("n"), F.max("v").alias("v")).first()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert tasks > 2
    assert (hot["n"], hot["v"]) == (20_001, 20_001)
    assert "Generate" not in joined._jdf.queryExecution().toString()


def test_unknown_join_kinds_are_refused(spark):
    one = spark.range(1).select(F.col("id").alias("k"))
    with pytest.raises(ValueError):
        lookup_join(one, one, ["k"], "full")


def test_one_missing_value_removes_the_user(spark):
    rows = [("a", 1.0, 1), ("a", float("nan"), 2), ("b", 2.0, 3), ("c", None, 4), ("b", 3.0, 5)]
    df = spark.createDataFrame(rows, "author string, x double, id int")
    kept = timeline.drop_incomplete_users(df, ["x", "absent"])
    assert {r["id"] for r in kept.collect()} == {3, 5}
    assert sorted(r["author"] for r in timeline.incomplete_users(df, ["x"]).collect()) == ["a", "c"]


def test_post_zscores_use_population_deviation(spark, no_broadcast):
    rows = [("a", 1.0, 1), ("a", 3.0, 2), ("b", 5.0, 3), ("c", 2.0, 4), ("c", 2.0, 5), ("a", None, 6)]
    df = spark.createDataFrame(rows, "author string, x double, id int")
    got = {r["id"]: r["x_zscore"] for r in zscore_posts_per_user(df, ["x"], "author").collect()}
    assert got[1] == pytest.approx(-1) and got[2] == pytest.approx(1)
    assert [got[i] for i in (3, 4, 5, 6)] == [None] * 4


def test_unified_timeline(spark):
    schema = "author string, ts_utc timestamp, text string, source string"
    p = spark.createDataFrame([("a", ts(2), "p", "post"), ("z", ts(2), "z", "post")], schema)
    c = spark.createDataFrame([("a", ts(-400), "old", "comment"), ("a", ts(-1), "c", "comment")], schema)
    out = timeline.unified_timeline(users(spark, [("a", ts(0), 1.0)]), c, p).collect()
    assert [(r["text"], r["source"], r["offset_from_cd1"]) for r in out] == [("c", "comment", 0), ("p", "post", 3)]


def test_samples_are_repeatable_and_bounded(spark):
    df = spark.range(1000).select(F.col("id"), F.when(F.col("id") > 5, F.col("id") % 3).alias("g"))
    a, b = (
        sorted(tuple(r) for r in summaries.sample_per_group(df, "g", "id", 7).collect()) for _ in range(2)
    )
    assert a == b and len(a) == 21
    assert sorted({r[2] for r in a}) == list(range(1, 8))
    plan = summaries.sample_per_group(df, "g", "id", 7)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    assert clean.random_rows(df, 10, "id").count() == 10


def test_significance(spark):
    rows = [(None, 5.0, 90.0), (28.0, 1.0, 90.0), (28.0, 2.0, 40.0), (28.0, 2.0, 90.0), (28.0, float("nan"), 90.0)]
    df = spark.createDataFrame(rows, "p double, s double, d double")
    got = [r[0] for r in df.select(clean.significance(F.col("p"), F.col("s"), F.col("d"))).collect()]
    assert got == ["no period", "low signal", "few cycles", None, None]


def test_snr_filter_does_not_keep_nan(spark):
    df = spark.createDataFrame([(float("nan"),), (3.0,), (3.1,), (None,)], "peak_to_background double")
    assert clean.filter_snr(df, 3.0).count() == 2
    assert clean.filter_snr(df, 3.0, strict=True).count() == 1


def test_feature_columns(spark):
    df = spark.createDataFrame([], "author string, zeta double, alpha int, flag boolean, score int, text string")
    assert clean.feature_columns(df) == ["alpha", "flag", "zeta"]


def test_posts_to_cycles(spark):
    """Raw posts and anchors to one period per user, through every stage."""
    rows = []
    for user, period in (("u28", 28), ("u24", 24)):
        for day in range(-84, 84):
            wave = 1.0 if (day % period) < period / 2 else -1.0
            rows.append(
                (user, 1704067200.0 + day * 86400, "title", "x" * 160, f"{user}/{day}", wave + day % 3 * 0.01, wave * 2)
            )
    raw = spark.createDataFrame(
        rows, "author string, created_utc double, title string, selftext string, id string, f double, g double"
    )
    prepared = prepare_posts(raw, ["f", "g"])
    assert prepared.count() == len(rows)
    start = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    anchor = users(spark, [("u28", start, 0.0), ("u24", start, 0.0)])
    out = {r["user"]: r["consensus_period"] for r in user_cycles(prepared, anchor, ["f", "g"], min_features=2).collect()}
    assert out == {"u28": 28.0, "u24": 24.0}
