"""Lomb-Scargle periodograms of irregular daily series."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cyclewright.functions.columns import let
from cyclewright.operators.spectral import SERIES, prepared_series, snr_of
from cyclewright.settings import (
    LS_PERIOD_MAX,
    LS_PERIOD_MIN,
    LS_PERIOD_STEP,
    PERIOD_MAX,
    PERIOD_MIN,
)


SERIES_BLOCK = 512
TRIAL_BLOCK = 256
DAY_BLOCK = 4096
CONSTANTS = ["n_points", "span_days", "y", "yy", "time_variance"]


def _trial_sums(
    rows: DataFrame, keys: list[str], low: float, step: float, count: int, radians: float
) -> DataFrame:
    """Sums over each series for every trial period, in one partial aggregate.

    Groups by series and trial, which the partitioning on the series already
    satisfies; ``j`` numbers the trials. What does not depend on the trial is
    taken once per series, before the rows multiply.
    """
    whole = W.partitionBy(*keys)
    fixed = rows.select(
        *keys,
        "n_points",
        "span_days",
        (F.col("day") - F.col("first_day")).alias("t"),
        F.col("value").alias("v"),
        F.sum("value").over(whole).alias("y"),
        F.sum(F.col("value") * F.col("value")).over(whole).alias("yy"),
        F.var_pop("day").over(whole).alias("time_variance"),
    )
    trials = fixed.select("*", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("j"))
    angle = F.col("t") * radians / (F.col("j") * step + low)
    waves = trials.select("*", F.cos(angle).alias("c"), F.sin(angle).alias("s"))
    c, s, v = (F.col(x) for x in "csv")
    return waves.groupBy(*keys, *CONSTANTS, "j").agg(
        F.sum(c).alias("c"),
        F.sum(s).alias("s"),
        F.sum(c * c).alias("cc"),
        F.sum(c * s).alias("cs"),
        F.sum(v * c).alias("yc"),
        F.sum(v * s).alias("ys"),
    )


def _period(low: float, step: float) -> Column:
    return F.round(F.col("j") * step + low, 6)


def floating_mean_spectrum(
    series: DataFrame,
    keys: list[str] = SERIES,
    low: float = LS_PERIOD_MIN,
    high: float = LS_PERIOD_MAX,
    step: float = LS_PERIOD_STEP,
    scaling: str = "zscore",
    min_span: float = PERIOD_MIN,
    prepared: DataFrame | None = None,
) -> DataFrame:
    """Standard-normalised power with a fitted mean at every trial period.

    Closed form of the generalised periodogram (Zechmeister and Kuerster 2009).
    """
    if prepared is None:
        prepared = prepared_series(series, keys, scaling, min_span)
    count = int(round((high - low) / step)) + 1
    sums = _trial_sums(prepared, keys, low, step, count, 2 * math.pi)
    n = F.col("n_points")
    mean_c, mean_s, mean_y = (F.col(x) / n for x in "csy")
    yy = F.col("yy") / n - mean_y * mean_y
    yc = F.col("yc") / n - mean_y * mean_c
    ys = F.col("ys") / n - mean_y * mean_s
    cc = F.col("cc") / n - mean_c * mean_c
    ss = 1 - F.col("cc") / n - mean_s * mean_s
    cs = F.col("cs") / n - mean_c * mean_s
    det = cc * ss - cs * cs
    top = yc * yc * ss + ys * ys * cc - 2 * yc * ys * cs
    return sums.select(
        *keys,
        "n_points",
        "span_days",
        "time_variance",
        "j",
        _period(low, step).alias("period"),
        F.coalesce(F.try_divide(top, yy * det), F.lit(0.0)).alias("power"),
    )


def gamma_ratio(n: Column) -> Column:
    """Gamma((n-1)/2) / Gamma((n-2)/2) by its recurrence in steps of two."""
    odd = n % 2 == 1
    start = F.when(odd, F.lit(1 / math.sqrt(math.pi))).otherwise(F.lit(math.sqrt(math.pi) / 2))
    base = F.when(odd, F.lit(3)).otherwise(F.lit(4)).cast("int")
    steps = F.when(
        n >= base + 2, F.sequence(base, (n - 2).cast("int"), F.lit(2))
    ).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, start, lambda acc, m: acc * (m - 1) / (m - 2))


def false_alarm_probability(
    power: Column, n: Column, span: Column, time_variance: Column
) -> Column:
    """Baluev (2008) bound for the best peak of a standard-normalised periodogram."""
    width = 1 / (5 * span)
    steps = F.floor(12.5 * n)
    top_frequency = width / 2 + width * (steps - 1)
    w = top_frequency * F.sqrt(4 * math.pi * time_variance)
    rest = F.greatest(1 - power, F.lit(0.0))
    single = F.pow(rest, (n - 3) / 2)
    gamma = F.sqrt(2 / (n - 1)) * gamma_ratio(n)
    tau = gamma * w * F.pow(rest, (n - 4) / 2) * F.sqrt((n - 1) * power / 2)
    return 1 - (1 - single) * F.exp(-tau)


def _add_block(
    sums: np.ndarray,
    rows: np.ndarray,
    days: np.ndarray,
    points: np.ndarray,
    first: int,
    low: float,
    step: float,
) -> None:
    """Adds one block of days to cos, sin, cos^2, cos sin, y cos and y sin, each (series x trials)."""
    inside = (days >= first) & (days < first + DAY_BLOCK)
    own, row = np.unique(rows[inside], return_inverse=True)
    day = days[inside] - first
    present = np.zeros((len(own), int(day.max()) + 1))
    value = np.zeros_like(present)
    present[row, day] = 1.0
    value[row, day] = points[inside]
    for trial in range(0, sums.shape[2], TRIAL_BLOCK):
        j = np.arange(trial, min(trial + TRIAL_BLOCK, sums.shape[2]))
        angle = np.outer(np.arange(first, first + present.shape[1]), 2 * np.pi / (low + step * j))
        cos, sin = np.cos(angle), np.sin(angle)
        at = np.ix_(own, j)
        for k, (matrix, wave) in enumerate(
            [(present, cos), (present, sin), (present, cos * cos), (present, cos * sin), (value, cos), (value, sin)]
        ):
            sums[k][at] += matrix @ wave


def _best_trials(keys: list[str], low: float, step: float, count: int):
    """Arrow-batch kernel: best trial of each series by matrix products.

    Days are whole numbers, so all series share one table of sines and cosines
    and the sums of a batch are products of (series x days) with (days x trials)
    matrices. Days, trials and series go in blocks, so that the memory depends
    neither on how long a series is nor on how many there are.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), SERIES_BLOCK):
                yield score(batch.iloc[start : start + SERIES_BLOCK])

    def score(part: pd.DataFrame) -> pd.DataFrame:
        sizes = part["days"].str.len().to_numpy()
        rows = np.repeat(np.arange(len(part)), sizes)
        days = np.concatenate(part["days"].to_numpy())
        points = np.concatenate(part["points"].to_numpy())
        n = sizes[:, None].astype(float)
        mean = np.bincount(rows, points, len(part))[:, None] / n
        yy = np.bincount(rows, points * points, len(part))[:, None] / n - mean * mean
        sums = np.zeros((6, len(part), count))
        for block in np.unique(days // DAY_BLOCK):
            _add_block(sums, rows, days, points, int(block) * DAY_BLOCK, low, step)
        best_power = np.full(len(part), -np.inf)
        best_j = np.zeros(len(part), dtype=np.int32)
        for first in range(0, count, TRIAL_BLOCK):
            c, s, cos2, cs, yc, ys = sums[:, :, first : first + TRIAL_BLOCK] / n
            cc, ss = cos2 - c * c, 1 - cos2 - s * s
            cs = cs - c * s
            yc, ys = yc - mean * c, ys - mean * s
            det = yy * (cc * ss - cs * cs)
            top = yc * yc * ss + ys * ys * cc - 2 * yc * ys * cs
            power = np.divide(top, det, out=np.zeros_like(top), where=det != 0)
            at = power.argmax(1)
            peak = power[np.arange(len(part)), at]
            better = peak > best_power
            best_power[better] = peak[better]
            best_j[better] = first + at[better]
        out = part[[*keys, "n_points", "span_days", "time_variance"]].copy()
        return out.assign(j=best_j, power=best_power)

    return run


def detect_periods_ls(
    series: DataFrame,
    keys: list[str] = SERIES,
    low: float = LS_PERIOD_MIN,
    high: float = LS_PERIOD_MAX,
    step: float = LS_PERIOD_STEP,
    scaling: str = "zscore",
    min_span: float = PERIOD_MIN,
    prepared: DataFrame | None = None,
) -> DataFrame:
    """Best trial period per series with its false-alarm probability; ties go to the shortest.

    Same powers as ``floating_mean_spectrum``. Only the peak is wanted here, so
    the hundreds of trials per series are never rows: Spark partitions the
    series and a numpy kernel scores each Arrow batch.
    """
    if prepared is None:
        prepared = prepared_series(series, keys, scaling, min_span)
    count = int(round((high - low) / step)) + 1
    point = F.struct((F.col("day") - F.col("first_day")).alias("t"), F.col("value").alias("y"))
    folded = (
        prepared.groupBy(*keys, "n_points", "span_days")
        .agg(
            F.sort_array(F.collect_list(point)).alias("points"),
            F.var_pop("day").alias("time_variance"),
        )
        .select(
            *keys,
            "n_points",
            "span_days",
            "time_variance",
            F.col("points.t").alias("days"),
            F.col("points.y").alias("points"),
        )
    )
    fixed = [*keys, "n_points", "span_days", "time_variance"]
    schema = T.StructType(
        [f for f in folded.schema.fields if f.name in fixed]
        + [T.StructField("j", T.IntegerType()), T.StructField("power", T.DoubleType())]
    )
    best = folded.mapInPandas(_best_trials(keys, low, step, count), schema)
    return best.select(
        *keys,
        F.lit("lombscargle").alias("method"),
        _period(low, step).alias("period"),
        "power",
        false_alarm_probability(
            F.col("power"), F.col("n_points"), F.col("span_days"), F.col("time_variance")
        ).alias("fap"),
        "n_points",
        "span_days",
    )


def detect_periods_classic(
    series: DataFrame,
    keys: list[str] = SERIES,
    low: float = PERIOD_MIN,
    high: float = PERIOD_MAX,
    step: float = 1.0,
    scaling: str = "zscore",
    literal_frequency: bool = False,
) -> DataFrame:
    """Classic periodogram without a fitted mean, with the capped peak ratio.

    ``literal_frequency`` uses 1/period as angular frequency; the default is
    2 pi / period, so that a trial tests the period it is named after.
    """
    prepared = prepared_series(series, keys, scaling, low)
    count = int(round((high - low) / step)) + 1
    radians = 1.0 if literal_frequency else 2 * math.pi
    sums = _trial_sums(prepared, keys, low, step, count, radians)
    cc, cs, yc, ys = (F.col(x) for x in ("cc", "cs", "yc", "ys"))
    ss = F.col("n_points") - cc
    top = yc * yc * ss + ys * ys * cc - 2 * yc * ys * cs
    power = F.coalesce(F.try_divide(top, F.col("yy") * (cc * ss - cs * cs)), F.lit(0.0))
    per_series = (
        sums.select(
            *keys, "n_points", "span_days", "j", _period(low, step).alias("period"), power.alias("p")
        )
        .groupBy(*keys, "n_points", "span_days")
        .agg(F.sort_array(F.collect_list(F.struct((-F.col("p")).alias("neg"), "j", "period"))).alias("r"))
    )
    best = -F.col("r")[0]["neg"]
    others = F.sort_array(F.transform(F.slice("r", 2, count), lambda x: -x["neg"]))
    return per_series.select(
        *keys,
        F.lit("lombscargle_classic").alias("method"),
        F.col("r")[0]["period"].alias("period"),
        best.alias("power"),
        let(others, lambda o: snr_of(best, o, capped=True)).alias("peak_to_background"),
        "n_points",
        "span_days",
    )
