import math
import subprocess
import sys
import tracemalloc
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cyclewright.operators import clean, consensus, lomb, scaling, sinefit, spectral, timeline
from cyclewright.plans import jobs
from cyclewright.plans.jobs import all_methods, normalisation_grid, periodicity
from cyclewright.plans.quantiles import exact_median, exact_medians

EPS = 1e-10


def series_frame(spark, data):
    rows = [(u, f, int(d), float(v)) for (u, f), pts in data.items() for d, v in pts]
    return spark.createDataFrame(rows, "user string, feature string, day int, value double")


def random_series(seed, span, keep=0.6, start=-40):
    rng = np.random.default_rng(seed)
    days = np.arange(start, start + span + 1)
    mask = rng.random(len(days)) < keep
    mask[[0, -1]] = True
    days = days[mask]
    wave = np.sin(2 * np.pi * days / 27) + 0.5 * rng.standard_normal(len(days))
    return list(zip(days.tolist(), wave.tolist(), strict=True))


def grid_of(points):
    d = np.array([p[0] for p in points], float)
    v = np.array([p[1] for p in points])
    z = (v - v.mean()) / (v.std() + EPS)
    grid = np.arange(int(d.min()), int(d.max()) + 1)
    y = np.interp(grid, d, z)
    return y - y.mean()


def fft_peak(points, low, high, padded=False, capped=False):
    """The spectrum by numpy's transform."""
    y = grid_of(points)
    size = 2 ** int(np.ceil(np.log2(len(y)))) if padded else len(y)
    spectrum = np.abs(np.fft.fft(y, size)[: size // 2])[1:] ** 2
    periods = 1.0 / np.fft.fftfreq(size)[: size // 2][1:]
    keep = (periods >= low) & (periods <= high)
    periods, power = periods[keep], spectrum[keep]
    if len(power) == 0:
        return None, 0.0, 0.0
    at = int(power.argmax())
    return round(periods[at]), power[at], ratio(power, at, capped)


def ratio(power, at, capped):
    rest = np.delete(power, at)
    if len(rest) == 0:
        return min(power[at] / EPS, 1000.0) if capped else power[at] / EPS
    median = np.median(rest)
    if capped and median < EPS:
        return min(power[at] / EPS, 1000.0)
    return power[at] / (median + EPS)


SPANS = [21, 22, 34, 35, 36, 40, 41, 63, 104, 127, 179, 182, 209]


@pytest.fixture(scope="module")
def many(spark):
    data = {(f"u{s}", f): random_series(s * 7 + i, s, 0.9) for s in SPANS for i, f in enumerate("ab")}
    return data, series_frame(spark, data).cache()


@pytest.mark.parametrize(
    ("method", "low", "high", "padded", "capped"),
    [
        ("fft_interpolation", 21, 35, False, False),
        ("fft_zeropad", 21, 35, True, True),
        ("fft_interpolation_wide", 10, 50, False, False),
        ("fft_zeropad_wide", 10, 50, True, False),
    ],
)
def test_peaks_equal_numpy(spark, many, method, low, high, padded, capped):
    data, frame = many
    got = {(r["user"], r["feature"]): r for r in spectral.detect_periods(frame, methods=(method,)).collect()}
    assert set(got) == set(data)
    for key, points in data.items():
        period, power, snr = fft_peak(points, low, high, padded, capped)
        row = got[key]
        assert row["period"] == period, key
        assert row["power"] == pytest.approx(power, rel=1e-9, abs=1e-9)
        assert row["peak_to_background"] == pytest.approx(snr, rel=1e-8, abs=1e-8)
        assert row["n_points"] == len(points)
        assert row["span_days"] == points[-1][0] - points[0][0]


def test_all_methods_in_one_pass_equal_single_runs(many):
    frame = many[1]
    key = ["user", "feature", "method", "period", "power", "peak_to_background"]
    together = spectral.detect_periods(frame, methods=tuple(spectral.METHODS))
    apart = None
    for m in spectral.METHODS:
        one = spectral.detect_periods(frame, methods=(m,))
        apart = one if apart is None else apart.unionByName(one)

    def rows(df):
        return sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.select(key).collect()), key=str)

    assert rows(together) == rows(apart)


def test_integer_periods_equal_numpy(many):
    data, frame = many
    got = {(r["user"], r["feature"]): r for r in spectral.detect_integer_periods(frame).collect()}
    for key, points in data.items():
        y = grid_of(points)
        n = len(y)
        power = np.abs(np.fft.fft(y)[: n // 2])[1:] ** 2
        periods = 1.0 / np.fft.fftfreq(n)[: n // 2][1:]
        order = periods.argsort()
        whole = np.arange(21, 36)
        whole = whole[(whole >= periods.min()) & (whole <= periods.max())]
        row = got[key]
        if len(whole) == 0:
            assert row["period"] is None and row["power"] == 0.0
            continue
        at_whole = np.interp(whole, periods[order], power[order])
        best = int(at_whole.argmax())
        assert row["period"] == whole[best], key
        assert row["power"] == pytest.approx(at_whole[best], rel=1e-9)
        assert row["peak_to_background"] == pytest.approx(ratio(at_whole, best, True), rel=1e-8)


@pytest.mark.parametrize("period", [21, 25, 28, 35])
def test_pure_sine_peaks_at_its_period(spark, period):
    points = [(d, math.sin(2 * math.pi * d / period)) for d in range(period * 4)]
    row = spectral.detect_periods(series_frame(spark, {("u", "f"): points})).first()
    assert row["period"] == period


def test_padding_changes_nothing_at_a_power_of_two(spark):
    frame = series_frame(spark, {("u", "f"): random_series(3, 127)})
    a, b = (spectral.detect_periods(frame, methods=(m,)).first() for m in ("fft_interpolation", "fft_zeropad"))
    assert (a["period"], round(a["power"], 6)) == (b["period"], round(b["power"], 6))


def test_series_gate_and_detection_agree(spark):
    data = {
        ("few", "f"): [(3 * i, i % 4) for i in range(9)],
        ("ten", "f"): [(3 * i, i % 4) for i in range(10)],
        ("span20", "f"): [(2 * i, i % 4) for i in range(11)],
        ("span21", "f"): [(d, d % 4) for d in [*range(10), 21]],
        ("flat", "f"): [(3 * i, 2.5) for i in range(12)],
        ("one", "f"): [(0, 1.0)],
    }
    frame = series_frame(spark, data)
    gate = {r["user"]: r["reason"] for r in clean.series_gate(frame, ["user", "feature"], "day", "value").collect()}
    assert gate == {
        "few": "few points",
        "ten": None,
        "span20": "short span",
        "span21": None,
        "flat": "constant",
        "one": "few points",
    }
    assert {r["user"] for r in spectral.detect_periods(frame).collect()} == {"ten", "span21"}


def test_missing_values_are_not_points(spark):
    rows = [("u", "f", d, None if d == 0 else float("nan") if d == 1 else float(d % 3)) for d in range(40)]
    wide = spark.createDataFrame([(r[0], r[2], r[3]) for r in rows], "author string, day int, x double")
    series = timeline.as_series(wide, "author", "day", ["x"])
    assert series.count() == 38
    assert spectral.detect_periods(series).first()["n_points"] == 38


def test_grid_equals_numpy_interp(spark):
    points = random_series(9, 60, 0.3)
    rows = spectral.daily_grid(series_frame(spark, {("u", "f"): points})).orderBy("grid_day").collect()
    grid = np.arange(points[0][0], points[-1][0] + 1)
    want = np.interp(grid, [p[0] for p in points], [p[1] for p in points])
    assert [r["grid_day"] for r in rows] == grid.tolist()
    assert np.allclose([r["grid_value"] for r in rows], want)
    assert np.allclose([r["centred"] for r in rows], want - want.mean())


def ls_powers(points, periods):
    """Least-squares sine with a fitted mean: share of the variance explained."""
    t = np.array([p[0] for p in points], float)
    v = np.array([p[1] for p in points])
    out = []
    for p in periods:
        a = np.column_stack([np.ones_like(t), np.cos(2 * np.pi * t / p), np.sin(2 * np.pi * t / p)])
        fit = a @ np.linalg.lstsq(a, v, rcond=None)[0]
        out.append(1 - ((v - fit) ** 2).sum() / ((v - v.mean()) ** 2).sum())
    return np.array(out)


def test_lomb_scargle_is_the_explained_variance(spark):
    data = {(f"u{i}", "f"): random_series(i, 60 + 30 * i, 0.5) for i in range(4)}
    frame = series_frame(spark, data)
    got = {r["user"]: r for r in lomb.detect_periods_ls(frame).collect()}
    long = lomb.floating_mean_spectrum(frame).groupBy("user").agg(
        F.max(F.struct("power", -F.col("j"), "period")).alias("b")
    )
    expressions = {r["user"]: r["b"] for r in long.collect()}
    periods = 10 + 0.1 * np.arange(801)
    for (user, _), points in data.items():
        want = ls_powers(points, periods)
        row = got[user]
        assert row["power"] == pytest.approx(want.max(), abs=1e-9)
        assert row["period"] == pytest.approx(periods[want.argmax()])
        assert expressions[user]["power"] == pytest.approx(row["power"], abs=1e-9)
        assert expressions[user]["period"] == row["period"]
        assert 0.0 <= row["fap"] <= 1.0


def test_gamma_ratio(spark):
    rows = spark.range(5, 200).select(F.col("id").alias("n"), lomb.gamma_ratio(F.col("id")).alias("g")).collect()
    for r in rows:
        want = math.exp(math.lgamma((r["n"] - 1) / 2) - math.lgamma((r["n"] - 2) / 2))
        assert r["g"] == pytest.approx(want, rel=1e-9)


def test_false_alarm_levels_on_noise(spark):
    """About one noise series in ten has a bound under one tenth."""
    rng = np.random.default_rng(5)
    data = {}
    for i in range(200):
        days = np.sort(rng.choice(183, 40, replace=False))
        data[(f"u{i}", "f")] = list(zip(days.tolist(), rng.standard_normal(40).tolist(), strict=True))
    fap = [r["fap"] for r in lomb.detect_periods_ls(series_frame(spark, data), low=2.0, high=90.0, step=0.02).collect()]
    assert 0.02 <= np.mean(np.array(fap) < 0.1) <= 0.2


def test_classic_periodogram_without_mean(spark):
    points = random_series(21, 150, 0.6)
    frame = series_frame(spark, {("u", "f"): points})
    t = np.array([p[0] for p in points], float)
    v = np.array([p[1] for p in points])
    z = (v - v.mean()) / v.std()
    for literal in (False, True):
        powers = []
        for p in range(21, 36):
            w = 1 / p if literal else 2 * np.pi / p
            a = np.column_stack([np.cos(w * (t - t[0])), np.sin(w * (t - t[0]))])
            fit = a @ np.linalg.lstsq(a, z, rcond=None)[0]
            powers.append(1 - ((z - fit) ** 2).sum() / (z**2).sum())
        powers = np.array(powers)
        row = lomb.detect_periods_classic(frame, literal_frequency=literal).first()
        assert row["period"] == 21 + powers.argmax()
        assert row["power"] == pytest.approx(powers.max(), abs=1e-8)
        assert row["peak_to_background"] == pytest.approx(ratio(powers, powers.argmax(), True), rel=1e-6)


def test_sine_fit_recovers_parameters(spark):
    points = [(d, 3.0 * math.sin(2 * math.pi * d / 28 + 0.7) + 5.0) for d in range(0, 90, 2)]
    frame = series_frame(spark, {("u", "f"): points, ("flat", "f"): [(4, 2.0)]}).withColumn("period", F.lit(28))
    fits = {r["user"]: r for r in sinefit.fit_sine(frame, "period").collect()}
    assert fits["u"]["amplitude"] == pytest.approx(3.0)
    assert fits["u"]["phase"] == pytest.approx(0.7)
    assert fits["u"]["level"] == pytest.approx(5.0)
    assert (fits["flat"]["amplitude"], fits["flat"]["level"]) == (0.0, 2.0)
    curve = sinefit.sine_curve(sinefit.fit_sine(frame, "period").where("user = 'u'"), "period").collect()
    assert len(curve) == 1000
    assert (min(r["x"] for r in curve), max(r["x"] for r in curve)) == (0.0, 88.0)


@pytest.mark.parametrize("method", ["zscore", "minmax", "none"])
def test_scaling(spark, method):
    v = np.array([1.0, 4.0, 2.0, 9.0])
    frame = series_frame(spark, {("u", "f"): list(enumerate(v))})
    got = [r["scaled"] for r in spectral.scale_series(frame, method).orderBy("day").collect()]
    want = {
        "zscore": (v - v.mean()) / (v.std() + EPS),
        "minmax": (v - v.min()) / (v.max() - v.min() + EPS),
        "none": v,
    }[method]
    assert np.allclose(got, want)
    with pytest.raises(ValueError):
        spectral.scale_series(frame, "other")


def test_daily_zscore_is_null_for_constants_and_single_days(spark):
    rows = [("a", 0, 1.0, 5.0), ("a", 1, 3.0, 5.0), ("b", 0, 1.0, 1.0)]
    daily = spark.createDataFrame(rows, "author string, day int, x_mean double, y_mean double")
    out = scaling.zscore_daily_per_user(daily, ["x_mean", "y_mean"], "author").orderBy("author", "day").collect()
    assert [r["y_zscore"] for r in out] == [None, None, None]
    assert out[0]["x_zscore"] == pytest.approx(-1 / math.sqrt(2), abs=1e-6)
    assert out[2]["x_zscore"] is None


def test_daily_means(spark):
    rows = [("u", 0, 0.5), ("u", 0, 0.6), ("u", 0, 0.7), ("u", 1, None), ("u", None, 1.0)]
    df = spark.createDataFrame(rows, "author string, day int, x double")
    out = {r["day"]: r["x_mean"] for r in timeline.daily_means(df, ["x"], "author", "day").collect()}
    assert out[0] == pytest.approx(0.6)
    assert out == {0: pytest.approx(0.6), 1: None}
    with pytest.raises(ValueError):
        timeline.daily_means(df, ["absent"], "author", "day")
    with pytest.raises(ValueError):
        timeline.daily_value(df, ["author"], "day", "x", "mode")


def votes(spark, data):
    rows = [(u, f"f{i}", p) for u, ps in data.items() for i, p in enumerate(ps)]
    return spark.createDataFrame(rows, "user string, feature string, period int")


def test_consensus(spark):
    data = {
        "four": [28, 28, 28, 28],
        "five": [28, 28, 28, 29, 27],
        "tie": [22, 22, 22, 22, 22, 33, 33, 33, 33, 33],
        "apart": [21, 23, 25, 27, 29, 31],
        "nulls": [28, 28, 28, 28, None],
        "more": [28] * 5 + [35] * 5 + [34],
    }
    out = {r["user"]: r for r in consensus.consensus_periods(votes(spark, data)).collect()}
    assert set(out) == {"five", "tie", "more"}
    assert (out["five"]["consensus_period"], out["five"]["n_features_agreeing"], out["five"]["consensus_pct"]) == (28, 5, 100.0)
    assert (out["tie"]["consensus_period"], out["tie"]["consensus_pct"]) == (22, 50.0)
    assert (out["more"]["consensus_period"], out["more"]["n_features_agreeing"]) == (34, 6)


def test_histogram_counts_the_closed_end(spark):
    rows = [("f", "fft_interpolation", p) for p in (9.0, 10.0, 35.0, 36.0, 36.5)] + [
        ("f", "fft_zeropad_wide", p) for p in (10.0, 70.2)
    ]
    df = spark.createDataFrame(rows, "feature string, method string, period double")
    got = {(r["method"], r["bin"]): r["count"] for r in consensus.period_histogram(df).collect()}
    assert got == {
        ("fft_interpolation", 10): 1,
        ("fft_interpolation", 35): 2,
        ("fft_zeropad_wide", 10): 1,
        ("fft_zeropad_wide", 70): 1,
    }


def test_jobs_on_series(spark, many):
    frame = many[1]
    three = all_methods(frame).groupBy("method").count().collect()
    assert {r["method"]: r["count"] for r in three} == {
        "lombscargle": len(many[0]),
        "fft_interpolation": len(many[0]),
        "fft_zeropad": len(many[0]),
    }
    grid = normalisation_grid(frame, ["zscore", "minmax", "none"]).collect()
    assert {r["normalization"] for r in grid} == {"zscore", "minmax", "none"}
    assert all(r["fap"] < 0.1 for r in grid if r["method"] == "lombscargle")
    assert all(r["peak_to_background"] > 3 for r in grid if r["method"] != "lombscargle")
    daily = frame.where("feature = 'a'").select(
        F.col("user").alias("author"), F.col("day").alias("offset_from_cd1"), F.col("value").alias("x_mean")
    )
    kept = periodicity(daily).collect()
    assert kept and all(r["feature"] == "x" and r["peak_to_background"] >= 3 for r in kept)


@pytest.mark.parametrize("n", [0, 1, 2, 5, 1001, 4000])
def test_exact_median(spark, n):
    values = [((i * 7919) % 1013) / 7 for i in range(n)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    got = exact_median(df, "v").first()["median"]
    assert got is None if n == 0 else got == pytest.approx(float(np.median(values)))


def test_spectrum_plan_has_one_exchange_after_the_daily_table(spark, many, tmp_path):
    path = str(tmp_path / "series")
    many[1].write.parquet(path)
    plan = spectral.detect_periods(spark.read.parquet(path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    assert "Python" not in plan and "Cartesian" not in plan


def test_rows_of_one_day_are_their_mean(spark):
    """Repeated days neither fail nor count as further points."""
    rng = np.random.default_rng(1)
    days = np.arange(0, 120, 2)
    values = np.sin(days * 2 * np.pi / 28) + rng.normal(0, 0.1, len(days))
    once = [("u", "f", int(d), float(v)) for d, v in zip(days, values, strict=True)]
    twice = [(*r[:3], r[3] + e) for r in once for e in (-0.5, 0.5)] + [("u", "f", 4, None)]
    schema = "user string, feature string, day int, value double"
    a, b = (spark.createDataFrame(x, schema) for x in (once, twice))
    for detect in (spectral.detect_periods, lomb.detect_periods_ls):
        one, two = detect(a).first().asDict(), detect(b).first().asDict()
        assert one["n_points"] == two["n_points"] == len(days)
        assert one["period"] == two["period"] and one["power"] == pytest.approx(two["power"])


def test_row_series_takes_text_length_and_the_second_day(spark):
    rows = [("u", 1, 11, "ab"), ("u", 1, 11, "abcd"), ("u", 2, None, "x"), ("v", 3, None, None)]
    df = spark.createDataFrame(rows, "author string, offset_from_cd1 int, dpo_days int, text string")
    got = jobs.row_series(df, ["text"]).collect()
    assert [(r["user"], r["day"], r["value"]) for r in got] == [("u", 11, 3.0)]
    first = jobs.row_series(df.withColumn("dpo_days", F.lit(None).cast("int")), ["text"])
    assert sorted((r["user"], r["day"], r["value"]) for r in first.where("value is not null").collect()) == [
        ("u", 1, 3.0),
        ("u", 2, 1.0),
    ]


def test_median_of_counted_values_and_of_nothing(spark):
    df = spark.createDataFrame([(1.0, 3), (2.0, 1), (9.0, 4), (None, 7), (float("nan"), 2)], "v double, n int")
    assert exact_median(df, "v", "n").first()["median"] == 5.5
    assert exact_median(df.where("v is null"), "v").first()["median"] is None


def test_median_needs_no_shared_exchange(spark):
    rng = np.random.default_rng(7)
    for values in (rng.random(200_001), rng.normal(0, 1e-300, 2_000), np.r_[rng.normal(28, 1e-9, 999), -np.inf, np.inf]):
        df = spark.createDataFrame(pd.DataFrame({"v": values, "w": -values}))
        spark.conf.set("spark.sql.exchange.reuse", "false")
        try:
            got = exact_medians(df, ["v", "w"])
        finally:
            spark.conf.unset("spark.sql.exchange.reuse")
        assert got == {"v": np.median(values), "w": -np.median(values)}


def test_daily_median_counts_equal_values_and_leaves_out_missing_ones(spark):
    rows = [("u", 1, 1.0), ("u", 1, 1.0), ("u", 1, 5.0), ("u", 1, 9.0), ("u", 1, None), ("u", 1, float("nan"))]
    rows += [("u", 2, None), ("v", 1, -0.0), ("v", 1, 4.0), ("v", None, 4.0)]
    df = spark.createDataFrame(rows, "author string, day int, x double")
    got = {tuple(r) for r in timeline.daily_value(df, ["author"], "day", "x", "median").collect()}
    assert got == {("u", 1, 3.0, 4), ("v", 1, 2.0, 2)}


DAILY_MEDIAN_OF_A_HOT_DAY = """
from pyspark.sql import functions as F
from cyclewright.operators.timeline import daily_value
from cyclewright.session import local_session

spark = local_session(2, memory="1g")
rows = spark.range(5_000_000).select(F.lit("u").alias("author"), F.lit(1).alias("day"), (F.col("id") * 3).cast("double").alias("x"))
print("found", daily_value(rows, ["author"], "day", "x", "median").first())
"""


def test_daily_median_of_a_hot_day_fits_a_small_memory():
    """Five million distinct values of one user and day, with 1 GB for everything."""
    root = Path(__file__).resolve().parents[1]
    done = subprocess.run(
        [sys.executable, "-c", DAILY_MEDIAN_OF_A_HOT_DAY], cwd=root, capture_output=True, text=True, timeout=600, check=True
    )
    assert "feature_mean=7499998.5, n_entries=5000000" in done.stdout


def test_lomb_scargle_memory_does_not_grow_with_the_span():
    """A series over 200,000 days beside short ones: same peaks as alone, in a few hundred MB."""
    rng = np.random.default_rng(4)
    short = [np.sort(rng.choice(200, 60, replace=False)) for _ in range(400)]
    long = np.r_[np.sort(rng.choice(199_999, 300, replace=False)), 199_999]
    frames = []
    for k, days in enumerate([*short, long]):
        y = np.sin(2 * np.pi * days / 27.3) + 0.1 * rng.standard_normal(len(days))
        frames.append((f"u{k}", "f", len(days), int(np.ptp(days)), float(np.var(days)), days - days[0], y))
    names = ["user", "feature", "n_points", "span_days", "time_variance", "days", "points"]
    together = pd.DataFrame(frames, columns=names)
    score = lomb._best_trials(["user", "feature"], 10.0, 0.1, 801)
    tracemalloc.start()
    got = pd.concat(score(iter([together])), ignore_index=True)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    alone = pd.concat([r for i in (0, 7, 400) for r in score(iter([together.iloc[[i]]]))], ignore_index=True)
    assert most < 300e6
    assert got.iloc[[0, 7, 400]]["j"].tolist() == alone["j"].tolist()
    assert np.allclose(got.iloc[[0, 7, 400]]["power"], alone["power"])
    assert abs(10 + 0.1 * got.iloc[400]["j"] - 27.3) < 0.11


def test_partitions_follow_the_number_of_series(spark):
    changed = {
        "spark.sql.shuffle.partitions": "40",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100k",
        "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "10k",
    }
    kept = {k: spark.conf.get(k) for k in changed}
    try:
        for k, v in changed.items():
            spark.conf.set(k, v)
        counts = []
        for n in (50, 2000):
            series = spark.range(n * 60).select(
                F.format_string("u%d", F.col("id") % n).alias("user"),
                F.lit("f").alias("feature"),
                F.floor(F.col("id") / n).cast("int").alias("day"),
                F.sin(F.col("id") * 0.7).alias("value"),
            )
            counts.append(spectral.daily_points(series, ["user", "feature"]).rdd.getNumPartitions())
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert counts[0] < 5 < counts[1] <= 40


def test_partitions_of_series_follow_their_size(spark):
    setting = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    old = spark.conf.get(setting)
    spark.conf.set(setting, "64MB")
    try:
        i = F.col("id")
        series = spark.range(2_000_000).select(
            (i % 30_000).alias("user"), F.concat(F.lit("f"), i % 2).alias("feature"), F.floor(i / 30_000).alias("day"), F.rand(1).alias("value")
        )
        points = spectral.daily_points(series, ["user", "feature"])
        tasks = points.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()
        assert sum(r["n"] for r in tasks) == 2_000_000
        assert len(tasks) > 6 and max(r["n"] for r in tasks) < 400_000
    finally:
        spark.conf.set(setting, old)
