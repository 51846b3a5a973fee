import math

import pytest
from pyspark.sql import functions as F

from cyclewright.operators import cohorts, contrasts, phases
from cyclewright.settings import FOUR_PHASES


def periods(spark, lengths):
    return spark.createDataFrame([(f"u{x}", float(x)) for x in lengths], "user string, period double")


def bounds(spark, length, **kw):
    rows = phases.phase_table(periods(spark, [length]), **kw).orderBy("phase_order").collect()
    return {r["phase"]: (r["start_day"], r["end_day"]) for r in rows}


def test_four_phases(spark):
    assert bounds(spark, 28) == {
        "Menstrual": (0, 3),
        "Follicular": (4, 10),
        "Ovulation": (11, 13),
        "Luteal": (14, 27),
    }
    assert bounds(spark, 32)["Follicular"] == (4, 14)
    assert bounds(spark, 32)["Luteal"] == (18, 31)
    assert bounds(spark, 21)["Luteal"] == (10, 20)
    assert bounds(spark, 28.5) == {
        "Menstrual": (0, 3),
        "Follicular": (4, 10.5),
        "Ovulation": (11.5, 13.5),
        "Luteal": (14.5, 27),
    }
    split = bounds(spark, 28, split_luteal=True)
    assert (split["Early Luteal"], split["Late Luteal"]) == ((14, 20), (21, 27))


@pytest.mark.parametrize("length", range(21, 36))
def test_phase_lengths_add_up_and_cover_every_day(spark, length):
    table = phases.phase_table(periods(spark, [length]))
    assert table.agg(F.sum("length_days")).first()[0] == length
    days = spark.range(-3, 2 * length + 1).select(
        F.lit(f"u{length}").alias("author"), F.col("id").alias("offset_from_cd1")
    )
    by_table = phases.assign_phases(days, table).orderBy("offset_from_cd1").collect()
    by_length = (
        phases.assign_phases_by_length(days.withColumn("p", F.lit(length)), "p").orderBy("offset_from_cd1").collect()
    )
    assert [r["phase"] for r in by_table] == [r["phase"] for r in by_length]
    named = {r["offset_from_cd1"]: r["phase"] for r in by_table}
    assert None not in named.values()
    assert (named[-1], named[0], named[length], named[2 * length]) == ("Luteal", *["Menstrual"] * 3)


def test_unknown_users_and_days_have_no_phase(spark):
    days = spark.createDataFrame([("u28", None), ("zz", 3), ("u28", 3)], "author string, offset_from_cd1 int")
    out = phases.assign_phases(days, phases.phase_table(periods(spark, [28])))
    assert sorted(str(r["phase"]) for r in out.collect()) == ["Menstrual", "None", "None"]


def test_five_phases(spark):
    days = spark.range(28).select(F.col("id").alias("d"), F.lit(28.0).alias("p"))
    got = {r["d"]: r["phase"] for r in phases.assign_five_phases(days, "d", "p").collect()}
    spans = {
        "Perimenstrual": [0, 1, 2, 25, 26, 27],
        "Midfollicular": [7, 8, 9, 10, 11],
        "Periovulatory": [12, 13, 14, 15],
        "Early Luteal": [16, 17, 18],
        "Midluteal": [19, 20, 21, 22, 23],
    }
    want = {d: None for d in range(28)} | {d: n for n, ds in spans.items() for d in ds}
    assert got == want
    rows = phases.five_phase_table(periods(spark, [23, 24.5])).collect()
    assert {r["user"]: r["early"] for r in rows} == {"u23": True, "u24.5": False}


def test_several_lengths_fan_out(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "author string, offset_from_cd1 int")
    p = spark.createDataFrame([("a", 28), ("a", 28), ("a", 30)], "user string, period int")
    out = phases.with_cycle_length(df, p).collect()
    assert sorted((r["author"], r["period"] or 0) for r in out) == [("a", 28), ("a", 30), ("b", 0)]


SETS = {"one": ["x", "both"], "two": ["y", "both"]}


def phase_posts(spark, rows):
    posts = spark.createDataFrame(rows, "author string, category string, phase string")
    cycle = F.when(F.col("author") == "u28", 28.0).when(F.col("author") == "u30", 30.0)
    return posts.withColumn("period", cycle)


def test_phase_volumes(spark):
    rows = [
        ("u28", "x", "Menstrual"),
        ("u28", "x", "Menstrual"),
        ("u28", "both", "Luteal"),
        ("u30", "y", "Ovulation"),
        ("u30", "z", "Luteal"),
        ("nobody", "x", "Luteal"),
        ("u28", "x", None),
    ]
    out = {r["phase"]: r for r in cohorts.phase_volumes(phase_posts(spark, rows), SETS, "category").collect()}
    assert set(out) == set(FOUR_PHASES)
    assert out["Menstrual"]["one_volume"] == pytest.approx(2 / 4)
    assert out["Menstrual"]["one_raw"] == 2
    assert out["Follicular"]["one_volume"] == 0.0
    assert out["Luteal"]["two_raw"] == 1 and out["Luteal"]["n_users"] == 2
    assert out["Luteal"]["n_users_one"] == 1 and out["Ovulation"]["n_users_one"] == 0
    volumes = [2 / 4, 0.0, 0.0, 1 / 14]
    mean = sum(volumes) / 4
    std = math.sqrt(sum((v - mean) ** 2 for v in volumes) / 3)
    assert out["Menstrual"]["one_zscore"] == pytest.approx((volumes[0] - mean) / std)
    a = [0.0, 0.0, 0.0, 1 / 14]
    b = [0.0, 0.0, 1 / 3, 0.0]

    def z(v, i):
        m = sum(v) / 4
        return (v[i] - m) / math.sqrt(sum((x - m) ** 2 for x in v) / 3)

    assert out["Luteal"]["two_zscore"] == pytest.approx((z(a, 3) + z(b, 3)) / 2)


def test_cohort_report_falls_back_without_periods(spark):
    users = spark.createDataFrame([("a",), ("b",), ("c",)], "user string")
    rows = [("a", "x", 1), ("a", "mark", 2), ("b", "y", 5), ("b", "x", 400), ("zz", "x", 1)]
    posts = spark.createDataFrame(rows, "author string, category string, offset_from_cd1 int")
    groups = cohorts.label_cohorts(users, posts, ["mark"], "category")
    assert {r["user"]: r["group"] for r in groups.collect()} == {"a": "cohort", "b": "control", "c": "control"}
    none = spark.createDataFrame([("a", None)], "user string, consensus_period double")
    args = (SETS, "category")
    fallback = cohorts.cohort_report(posts, users, groups, None, *args).collect()
    empty = cohorts.cohort_report(posts, users, groups, none, *args).collect()
    assert sorted(map(str, fallback)) == sorted(map(str, empty))
    assert sum(r["one_raw"] for r in fallback) == 1 and sum(r["two_raw"] for r in fallback) == 1
    some = spark.createDataFrame([("a", 28.0), ("q", 28.0)], "user string, consensus_period double")
    assert cohorts.cohort_report(posts, users, groups, some, *args).count() == 0
    cut = cohorts.cohort_report(posts, users, groups, some, *args, both=False).collect()
    assert {r["group"] for r in cut} == {"cohort"}
    rates = {r["group"]: r for r in cohorts.ever_posted(posts, groups, SETS, *args[1:]).collect()}
    assert (rates["cohort"]["n_one"], rates["cohort"]["pct_one"]) == (1, 100.0)
    assert (rates["control"]["n_users"], rates["control"]["pct_two"]) == (2, 50.0)


def test_before_after(spark):
    rows = [("both", -1), ("both", 2), ("both", 3), ("before", -4), ("after", 1), ("zero", 0), (None, 1), ("n", None)]
    counts = cohorts.before_after_counts(
        spark.createDataFrame(rows, "author string, d int"), "author", "d"
    )
    got = {r["author"]: (r["posts_before"], r["posts_after"], r["ratio"]) for r in counts.collect()}
    assert got == {"both": (1, 2, 2.0), "before": (1, 0, 0.0), "after": (0, 1, None)}
    s = cohorts.before_after_summary(counts).first()
    assert (s["mean_ratio"], s["median_ratio"], s["n_users"], s["n_users_before_only"], s["n_users_after_only"]) == (
        2.0,
        2.0,
        1,
        1,
        1,
    )
    empty = cohorts.before_after_summary(counts.where("author = 'none'")).first()
    assert empty["n_users"] == 0 and empty["median_ratio"] is None


def test_phase_range_ties_are_alphabetical(spark):
    rows = [("B", 1.0), ("A", 1.0), ("D", 0.0), ("C", 0.0), ("C", None), (None, 9.0)]
    df = spark.createDataFrame(rows, "phase string, x_mean double")
    r = contrasts.phase_range(df).first()
    assert (r["feature"], r["max_min_diff"], r["max_phase"], r["min_phase"]) == ("x_mean", 1.0, "A", "C")


def test_fading(spark):
    t = spark.createDataFrame([("a", 0), ("a", 31), ("b", 5), ("b", -3), ("c", 200)], "author string, offset_from_cd1 int")
    p = spark.createDataFrame(
        [("a", "M", 1.0), ("a", "L", 3.0), ("b", "M", 0.0), ("b", "L", 1.0), ("c", "M", 9.0)],
        "author string, phase string, x_mean double",
    )
    got = {r["months_bin"]: (r["max_min_diff"], r["n_users"], r["std_max_min"]) for r in contrasts.signal_fading(t, p, ["x", "none"]).collect()}
    assert got == {"0-1": (1.5, 2, 0.5), "1-2": (2.0, 1, 0.0)}


@pytest.mark.parametrize("per_user", [True, False])
def test_constant_series_count_as_zero(spark, per_user):
    daily = spark.createDataFrame(
        [("a", d, float(d % 2), 4.0) for d in range(28)] + [("b", 0, 1.0, 1.0)],
        "author string, offset_from_cd1 int, x double, flat double",
    )
    out = contrasts.features_by_phase(daily, ["x", "flat"], None, fixed_length=28, average_per_user=per_user)
    rows = {(r["feature"], r["phase"]): r for r in out.collect()}
    assert rows[("flat", "Luteal")]["mean"] == 0.0
    assert rows[("flat", "Menstrual")]["n_users"] == 1
    assert rows[("x", "Menstrual")]["n_user_days"] == 4
    assert contrasts.phase_counts(spark.createDataFrame([("a", "M"), ("a", "M"), ("b", None)], "u string, phase string"), "u").first()["n_users"] == 1


def test_cohort_report_is_one_keyed_pass(spark, tmp_path):
    """Facts and days of a user meet in one aggregate: no join, no subquery that plans the periods again."""
    for name, df in {
        "posts": spark.createDataFrame([("a", "x", 1)], "author string, category string, offset_from_cd1 int"),
        "users": spark.createDataFrame([("a",)], "user string"),
        "periods": spark.createDataFrame([("a", 28.0)], "user string, consensus_period double"),
    }.items():
        df.write.parquet(f"{tmp_path}/{name}")
    posts, users, periods = (spark.read.parquet(f"{tmp_path}/{n}") for n in ("posts", "users", "periods"))
    groups = cohorts.label_cohorts(users, posts, ["mark"], "category")
    plan = cohorts.cohort_report(posts, users, groups, periods, SETS, "category", both=False)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in text and "Subquery" not in text
    assert text.count("Exchange ") <= 5
