"""Discrete Fourier spectra of many short series at once.

A series is a set of rows ``keys + (day, value)``. One exchange on the series
keys serves scaling, gate, grid, spectrum and peak choice: every later step
groups by those keys or by a superset of them. Rows of one day become their mean
on that exchange, so a series holds one point per day.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cyclewright.functions.columns import let, nan_to_null, sorted_median
from cyclewright.operators.clean import gate_reason
from cyclewright.operators.scaling import scaled
from cyclewright.session import at_most
from cyclewright.settings import (
    EPSILON,
    PERIOD_MAX,
    PERIOD_MIN,
    SNR_CAP,
    WIDE_PERIOD_MAX,
    WIDE_PERIOD_MIN,
)

SERIES = ["user", "feature"]
#: Bytes of shuffled points that a task takes, and partitions they are dealt to before small ones are joined.
SERIES_BYTES, MOST_PARTITIONS = 2 << 20, 1024


@dataclass(frozen=True)
class SpectrumMethod:
    """Which spectrum a method reads and how its signal-to-noise ratio is bounded."""

    label: str
    padded: bool
    wide: bool
    capped: bool


METHODS = {
    "fft_interpolation": SpectrumMethod("fft_interpolation", False, False, False),
    "fft_zeropad": SpectrumMethod("fft_zeropad", True, False, True),
    "fft_interpolation_wide": SpectrumMethod("fft_interp_wide", False, True, False),
    "fft_zeropad_wide": SpectrumMethod("fft_zeropad_wide", True, True, False),
}


def spread_series(series: DataFrame, keys: list[str], partitions: int | None = None) -> DataFrame:
    """One partitioning by series for everything that follows.

    Partitions are coalesced by the size that AQE measures, up to SERIES_BYTES, so
    their number follows that of the series and a task's memory does not; Spark keeps as
    many as there are cores unless they would be very small. A task sorts its points and
    groups their bins: hundreds of bytes for each byte of shuffled points, which is why
    SERIES_BYTES is small. ``partitions`` sets a number instead.
    """
    if partitions:
        return series.repartition(partitions, *keys)
    at_most(series.sparkSession, "spark.sql.adaptive.advisoryPartitionSizeInBytes", SERIES_BYTES)
    return series.hint("rebalance", MOST_PARTITIONS, *keys)


def daily_points(
    series: DataFrame, keys: list[str], partitions: int | None = None
) -> DataFrame:
    """One point a day, the mean of its values, on the partitioning of ``spread_series``.

    Rows without a value are no points. The means need no exchange of their own.
    """
    points = series.select(*keys, "day", "value").where(nan_to_null(F.col("value")).isNotNull())
    return spread_series(points, keys, partitions).groupBy(*keys, "day").agg(F.avg("value").alias("value"))


def prepared_series(
    series: DataFrame,
    keys: list[str] = SERIES,
    scaling: str = "zscore",
    min_span: float = PERIOD_MIN,
    partitions: int | None = None,
) -> DataFrame:
    """Scaled points of the series that pass the quality gate.

    Beside the counts, each point carries ``bend``, the slope before it less the
    slope after it on the interpolated line, and the series' end values and grid
    mean: all that the transform of the daily grid needs. The ordered window
    comes first so that one sort serves both windows.
    """
    ordered = W.partitionBy(*keys).orderBy("day")
    whole = W.partitionBy(*keys)
    value = F.col("value")
    points = daily_points(series, keys, partitions).withColumns(
        {
            "next_day": F.lead("day").over(ordered),
            "next_value": F.lead("value").over(ordered),
            "prev_day": F.lag("day").over(ordered),
            "prev_value": F.lag("value").over(ordered),
        }
    )
    rise = F.col("next_value") - value
    gap = F.col("next_day") - F.col("day")
    before = (value - F.col("prev_value")) / (F.col("day") - F.col("prev_day"))
    bend = F.coalesce(before, F.lit(0.0)) - F.coalesce(rise / gap, F.lit(0.0))
    # Sum of the line over the days from this point up to the next one.
    stretch = F.coalesce(value * gap + rise * (gap - 1) / 2, value)
    if scaling == "zscore":
        center, unit = F.avg(value).over(whole), F.stddev_pop(value).over(whole) + EPSILON
    elif scaling == "minmax":
        center = F.min(value).over(whole)
        unit = F.max(value).over(whole) - center + EPSILON
    elif scaling == "none":
        center, unit = F.lit(0.0), F.lit(1.0)
    else:
        raise ValueError(f"unknown scaling: {scaling}")
    gated = (
        points.withColumns({"bend": bend, "stretch": stretch})
        .withColumns(
            {
                "n_points": F.count(F.lit(1)).over(whole),
                "first_day": F.min("day").over(whole),
                "last_day": F.max("day").over(whole),
                "low": F.min("value").over(whole),
                "high": F.max("value").over(whole),
                "raw_spread": F.stddev_pop("value").over(whole),
                "grid_sum": F.sum("stretch").over(whole),
                "first_value": F.max(F.when(F.col("prev_day").isNull(), value)).over(whole),
                "last_value": F.max(F.when(F.col("next_day").isNull(), value)).over(whole),
                "center": center,
                "unit": unit,
            }
        )
        .where(
            gate_reason(
                F.col("n_points"),
                F.col("n_points"),
                F.col("last_day") - F.col("first_day"),
                F.col("n_points"),
                F.when(F.col("low") < F.col("high"), F.col("raw_spread") / F.col("unit")),
                min_span=min_span,
            ).isNull()
        )
    )

    def rescaled(c: Column) -> Column:
        return (c - F.col("center")) / F.col("unit")

    span = F.col("last_day") - F.col("first_day")
    return gated.select(
        *keys,
        "day",
        rescaled(value).alias("value"),
        (F.col("bend") / F.col("unit")).alias("bend"),
        "first_day",
        "last_day",
        rescaled(F.col("first_value")).alias("first_value"),
        rescaled(F.col("last_value")).alias("last_value"),
        rescaled(F.col("grid_sum") / (span + 1)).alias("grid_mean"),
        "n_points",
        span.cast("double").alias("span_days"),
    )


def fill_days(rows: DataFrame) -> DataFrame:
    """One row per calendar day between neighbouring points, linear in between.

    Needs ``next_day`` and ``next_value``; adds ``grid_day`` and ``grid_value``.
    """
    until = F.coalesce(F.col("next_day") - 1, F.col("day"))
    share = (F.col("grid_day") - F.col("day")) / (F.col("next_day") - F.col("day"))
    line = F.col("value") + (F.col("next_value") - F.col("value")) * share
    return rows.withColumn("grid_day", F.explode(F.sequence("day", until))).withColumn(
        "grid_value",
        F.when(F.col("grid_day") == F.col("day"), F.col("value")).otherwise(line),
    )


def daily_grid(series: DataFrame, keys: list[str] = SERIES) -> DataFrame:
    """Series on a full daily grid, with the grid mean taken off in ``centred``."""
    ordered = W.partitionBy(*keys).orderBy("day")
    rows = series.select(*keys, "day", "value").withColumns(
        {"next_day": F.lead("day").over(ordered), "next_value": F.lead("value").over(ordered)}
    )
    mean = F.avg("grid_value").over(W.partitionBy(*keys))
    return fill_days(rows).select(
        *keys, "grid_day", "grid_value", (F.col("grid_value") - mean).alias("centred")
    )


def padded_length(n: Column) -> Column:
    """Next power of two, by counting the bits of n - 1."""
    bits = F.length(F.bin((n - 1).cast("long")))
    return F.when(n <= 1, F.lit(1)).otherwise(F.lit(2).cast("long") ** bits).cast("int")


def bin_period(k: Column, size: Column) -> Column:
    """Period of bin k, from the bin frequency; edges depend on this form."""
    return F.try_divide(F.lit(1.0), k * (1.0 / size))


def _bins_near(size: Column, low: float, high: float) -> Column:
    """Bin 0, which stands for the series itself, and the bins about the period range."""
    start = F.greatest(F.lit(1), F.floor(size / high).cast("int") - 1)
    stop = F.least(F.floor(size / 2).cast("int") - 1, F.ceil(size / low).cast("int") + 1)
    near = F.when(stop >= start, F.sequence(start, stop)).otherwise(F.array().cast("array<int>"))
    return F.concat(F.array(F.lit(0)), near)


def spectrum_lines(
    rows: DataFrame,
    keys: list[str],
    ranges: dict[bool, tuple[float, float]],
    margin: int = 0,
) -> DataFrame:
    """Power per series, transform and bin, for only the bins in range.

    ``ranges`` maps padded (True or False) to the period range; ``margin`` keeps
    the neighbouring bins. Each series also keeps bin 0, so that one without any
    bin in range is not lost.

    The daily grid is never built. With z the unit step of a bin and y the
    centred line over n days, summing by parts twice gives

        (z - 1) X = y[last] z^n - y[first] - z / (z - 1) * sum(bend * z^day),

    so a bin costs one term per point and not one per day, and two sums.
    """
    n = F.col("last_day") - F.col("first_day") + 1
    series = ["n_points", "span_days", "first_value", "last_value", "grid_mean"]
    columns = [*keys, *series, n.alias("n"), (F.col("day") - F.col("first_day")).alias("step"), "bend"]

    def with_bins(padded: bool) -> DataFrame:
        low, high = ranges[padded]
        sized = rows.select(*columns).select(
            "*",
            F.lit(padded).alias("padded"),
            (padded_length(F.col("n")) if padded else F.col("n")).alias("size"),
        )
        bins = sized.select("*", F.explode(_bins_near(F.col("size"), low, high)).alias("k"))
        if margin:
            return bins
        period = bin_period(F.col("k"), F.col("size"))
        return bins.where((F.col("k") == 0) | period.between(low, high))

    if len(ranges) == 1:
        spread = with_bins(next(iter(ranges)))
    else:
        # Both transforms from one pass over the points.
        (low, high), (padded_low, padded_high) = ranges[False], ranges[True]
        both = F.array(
            F.struct(F.lit(False).alias("padded"), n.alias("size")),
            F.struct(F.lit(True).alias("padded"), padded_length(n).alias("size")),
        )
        sized = rows.select(*columns, F.explode(both).alias("t")).select(
            *keys, *series, "n", "step", "bend", "t.padded", "t.size"
        )
        near = F.when(
            F.col("padded"), _bins_near(F.col("size"), padded_low, padded_high)
        ).otherwise(_bins_near(F.col("size"), low, high))
        bins = sized.select("*", F.explode(near).alias("k"))
        period = bin_period(F.col("k"), F.col("size"))
        inside = F.when(F.col("padded"), period.between(padded_low, padded_high)).otherwise(
            period.between(low, high)
        )
        spread = bins.where((F.col("k") == 0) | inside)

    def angle(steps: Column) -> Column:
        """Angle of the bin after whole steps, reduced to one turn while still whole."""
        turn = F.pmod(F.col("k").cast("long") * steps, F.col("size").cast("long"))
        return turn * (2 * math.pi) / F.col("size")

    sums = spread.groupBy(*keys, *series, "n", "padded", "size", "k").agg(
        F.sum(F.col("bend") * F.cos(angle(F.col("step")))).alias("gc"),
        F.sum(F.col("bend") * F.sin(angle(F.col("step")))).alias("gs"),
    )
    omega = angle(F.lit(1))
    half = F.sin(omega / 2)
    gain = 4 * half * half
    first = F.col("first_value") - F.col("grid_mean")
    last = F.col("last_value") - F.col("grid_mean")
    tilt = F.try_divide(F.sin(omega), gain)
    end = angle(F.col("n"))
    re = last * F.cos(end) - first - F.col("gc") / 2 - tilt * F.col("gs")
    im = last * F.sin(end) - F.col("gs") / 2 + tilt * F.col("gc")
    return sums.select(
        *keys,
        "n_points",
        "span_days",
        "padded",
        "size",
        "k",
        bin_period(F.col("k"), F.col("size")).alias("period"),
        F.try_divide(re * re + im * im, gain).alias("power"),
    )


def snr_of(best: Column, others: Column, capped: bool) -> Column:
    """Peak over the median of the other powers (ascending array)."""

    def ratio(median: Column) -> Column:
        lone = best / EPSILON
        plain = best / (median + EPSILON)
        if not capped:
            return F.when(median.isNull(), lone).otherwise(plain)
        return F.when(
            median.isNull() | (median < EPSILON), F.least(lone, F.lit(SNR_CAP))
        ).otherwise(plain)

    return let(sorted_median(others), ratio)


def _peak(lines: Column, capped: bool) -> Column:
    """Strongest line of an array (power, order, period); ties go to the lowest order.

    No line gives a null period, power 0 and ratio 0.
    """

    def choose(ranked: Column) -> Column:
        top = F.get(ranked, F.lit(0))
        best = -top["neg"]
        others = F.sort_array(
            F.transform(F.slice(ranked, 2, F.greatest(F.size(ranked) - 1, F.lit(1))), lambda x: -x["neg"])
        )
        return F.when(
            F.size(ranked) > 0,
            F.struct(
                top["period"].alias("period"),
                best.alias("power"),
                snr_of(best, others, capped).alias("snr"),
            ),
        ).otherwise(
            F.struct(
                F.lit(None).cast("double").alias("period"),
                F.lit(0.0).alias("power"),
                F.lit(0.0).alias("snr"),
            )
        )

    return let(F.sort_array(lines), choose)


def _lines_per_series(spectrum: DataFrame, keys: list[str]) -> DataFrame:
    """Collects each series' lines; their number is bounded by the bins in range."""
    line = F.when(
        F.col("k") > 0,
        F.struct((-F.col("power")).alias("neg"), F.col("k"), F.col("period"), F.col("padded")),
    )
    return spectrum.groupBy(*keys, "n_points", "span_days").agg(
        F.collect_list(line).alias("lines")
    )


def _lines_within(padded: bool, low: float, high: float) -> Column:
    return F.filter(
        "lines", lambda x: (x["padded"] == F.lit(padded)) & x["period"].between(low, high)
    )


def detect_periods(
    series: DataFrame,
    keys: list[str] = SERIES,
    methods: tuple[str, ...] = ("fft_interpolation",),
    period_range: tuple[float, float] = (PERIOD_MIN, PERIOD_MAX),
    wide_range: tuple[float, float] = (WIDE_PERIOD_MIN, WIDE_PERIOD_MAX),
    scaling: str = "zscore",
    prepared: DataFrame | None = None,
) -> DataFrame:
    """One row per series and method: period, power, ratio, points and span.

    All methods share one pass: the spectrum is summed once per transform over
    the widest range asked for, and each method picks its peak from it.
    """
    chosen = [METHODS[m] for m in methods]
    if prepared is None:
        prepared = prepared_series(series, keys, scaling, period_range[0])
    ranges: dict[bool, tuple[float, float]] = {}
    for m in chosen:
        low, high = wide_range if m.wide else period_range
        old = ranges.get(m.padded, (low, high))
        ranges[m.padded] = (min(old[0], low), max(old[1], high))
    per_series = _lines_per_series(spectrum_lines(prepared, keys, ranges), keys)
    rows = []
    for m in chosen:
        low, high = wide_range if m.wide else period_range
        own = _lines_within(m.padded, low, high)
        rows.append(
            F.struct(F.lit(m.label).alias("method"), _peak(own, m.capped).alias("peak"))
        )
    return per_series.select(
        *keys, "n_points", "span_days", F.explode(F.array(*rows)).alias("r")
    ).select(
        *keys,
        F.col("r.method").alias("method"),
        F.bround("r.peak.period").cast("int").alias("period"),
        F.col("r.peak.power").alias("power"),
        F.col("r.peak.snr").alias("peak_to_background"),
        "n_points",
        "span_days",
    )


def integer_period_powers(
    series: DataFrame,
    keys: list[str] = SERIES,
    period_range: tuple[float, float] = (PERIOD_MIN, PERIOD_MAX),
    scaling: str = "zscore",
) -> DataFrame:
    """Power at whole-day periods, linear in period between the two nearest bins."""
    low, high = period_range
    prepared = prepared_series(series, keys, scaling, low)
    spectrum = spectrum_lines(prepared, keys, {False: (low, high)}, margin=1)
    by_period = F.sort_array(
        F.collect_list(
            F.when(F.col("k") > 0, F.struct(F.col("period"), F.col("power")))
        )
    )
    per_series = spectrum.groupBy(*keys, "n_points", "span_days").agg(by_period.alias("lines"))

    def powers(lines: Column) -> Column:
        first = F.greatest(F.lit(math.ceil(low)), F.ceil(F.get(lines, F.lit(0))["period"]).cast("int"))
        last = F.least(
            F.lit(math.floor(high)), F.floor(F.element_at(lines, -1)["period"]).cast("int")
        )

        def at(p: Column) -> Column:
            below = F.element_at(F.filter(lines, lambda x: x["period"] <= p), -1)
            above = F.get(F.filter(lines, lambda x: x["period"] >= p), F.lit(0))
            slope = (above["power"] - below["power"]) / (above["period"] - below["period"])
            value = F.when(above["period"] == below["period"], below["power"]).otherwise(
                below["power"] + slope * (p - below["period"])
            )
            return F.struct((-value).alias("neg"), p.alias("k"), p.cast("double").alias("period"))

        return F.when(
            (F.size(lines) > 0) & (last >= first), F.transform(F.sequence(first, last), at)
        ).otherwise(F.array().cast("array<struct<neg:double,k:int,period:double>>"))

    return per_series.select(*keys, "n_points", "span_days", let(F.col("lines"), powers).alias("lines"))


def detect_integer_periods(
    series: DataFrame,
    keys: list[str] = SERIES,
    period_range: tuple[float, float] = (PERIOD_MIN, PERIOD_MAX),
    scaling: str = "zscore",
) -> DataFrame:
    """Strongest whole-day period; ties go to the shortest."""
    powers = integer_period_powers(series, keys, period_range, scaling)
    return powers.withColumn("peak", _peak(F.col("lines"), capped=True)).select(
        *keys,
        F.lit("fft_interpolation_integer").alias("method"),
        F.col("peak.period").cast("int").alias("period"),
        F.col("peak.power").alias("power"),
        F.col("peak.snr").alias("peak_to_background"),
        "n_points",
        "span_days",
    )


def spectrum(
    series: DataFrame,
    keys: list[str] = SERIES,
    period_range: tuple[float, float] = (PERIOD_MIN, PERIOD_MAX),
    padded: bool = False,
    scaling: str = "zscore",
) -> DataFrame:
    """Long spectrum of each valid series: k, period and power of the bins in range."""
    prepared = prepared_series(series, keys, scaling, period_range[0])
    lines = spectrum_lines(prepared, keys, {padded: period_range})
    return lines.where(F.col("k") > 0).select(*keys, "size", "k", "period", "power")


def scale_series(series: DataFrame, method: str, keys: list[str] = SERIES) -> DataFrame:
    """``scaled`` beside each value of its series."""
    over = W.partitionBy(*keys)
    return series.withColumn("scaled", scaled(F.col("value"), over, method))
