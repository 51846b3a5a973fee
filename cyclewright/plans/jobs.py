"""End-to-end jobs: each is one lazy plan from inputs to a result table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cyclewright.operators import anchors, clean, consensus, lomb, spectral, timeline
from cyclewright.operators.matching import anchor_candidates
from cyclewright.operators.scaling import scaled
from cyclewright.settings import (
    CONSENSUS_MIN_FEATURES,
    CONSENSUS_TOLERANCE,
    FAP_THRESHOLD,
    MIN_TEXT_CHARS,
    PERIOD_MAX,
    PERIOD_MIN,
    SNR_THRESHOLD,
    WIDE_PERIOD_MAX,
    WIDE_PERIOD_MIN,
    WINDOW_MONTHS,
)

FFT_METHODS = tuple(spectral.METHODS)


def prepare_posts(raw: DataFrame, features: list[str], min_chars: int = MIN_TEXT_CHARS) -> DataFrame:
    """Raw posts to cleaned posts: complete users, real authors, joined and long enough texts."""
    return (
        timeline.drop_incomplete_users(raw, features)
        .transform(clean.drop_deleted_authors)
        .transform(clean.blank_removed_bodies)
        .transform(clean.join_title_and_body)
        .transform(clean.add_timestamps)
        .transform(clean.min_text_length, min_chars)
    )


def anchor_users(sources: dict[str, DataFrame], row_id: str = "id") -> tuple[DataFrame, DataFrame]:
    """Users tables (cycle day, days past ovulation) from raw posts of several sources."""
    candidates = []
    for name, raw in sources.items():
        posts = (
            clean.drop_deleted_authors(raw)
            .transform(clean.add_timestamps, date_string=True)
            .transform(clean.blank_removed_bodies)
            .transform(clean.join_title_and_body)
        )
        candidates.append(anchor_candidates(posts, name))
    return anchors.users_tables(candidates, row_id)


def build_timeline(
    posts: DataFrame, users: DataFrame, keep_anchors: bool = True, months: int = WINDOW_MONTHS
) -> DataFrame:
    """Posts with offsets inside the window, with or without the anchor posts themselves."""
    kept = posts if keep_anchors else anchors.split_anchor_posts(posts, users)
    return anchors.placed_window(kept, users, months)


def row_series(
    rows: DataFrame,
    features: list[str],
    user: str = "author",
    day: str = "offset_from_cd1",
    second_day: str = "dpo_days",
) -> DataFrame:
    """Daily series of rows with any number of values a day.

    ``second_day`` is the day column if it has any value at all, else ``day``. The
    feature named "text" is the length of the text. Rows without a day are no points.
    """
    values = [
        F.length(f).cast("double").alias(f) if f == "text" else F.col(f).cast("double").alias(f)
        for f in features
    ]
    at = F.col(day)
    if second_day in rows.columns:
        # One scalar for the whole table, so that no series mixes the two columns.
        known = rows.agg(F.count(second_day)).scalar() > 0
        at = F.when(known, F.col(second_day)).otherwise(at)
    placed = rows.select(F.col(user).alias("user"), at.cast("int").alias("day"), *values)
    daily = placed.where("day is not null").groupBy("user", "day").agg(
        *[F.avg(f).alias(f) for f in features]
    )
    return timeline.as_series(daily, "user", "day", features)


def periodicity(
    daily: DataFrame,
    features: list[str] | None = None,
    user: str = "author",
    day: str = "offset_from_cd1",
    snr_threshold: float = SNR_THRESHOLD,
    period_range: tuple[float, float] = (PERIOD_MIN, PERIOD_MAX),
) -> DataFrame:
    """Periods of every user and daily feature with a ratio at or above the threshold."""
    columns = features or sorted(c for c in daily.columns if c.endswith("_mean"))
    series = timeline.as_series(daily, user, day, columns).withColumn(
        "feature", F.regexp_replace("feature", "_mean$", "")
    )
    return clean.filter_snr(
        spectral.detect_periods(series, period_range=period_range), snr_threshold
    )


def user_cycles(
    posts: DataFrame,
    users: DataFrame,
    features: list[str],
    allowed: list[str] | None = None,
    min_features: int = CONSENSUS_MIN_FEATURES,
    tolerance: int = CONSENSUS_TOLERANCE,
    snr_threshold: float = SNR_THRESHOLD,
) -> DataFrame:
    """Posts and anchors to one consensus period per user."""
    placed = build_timeline(posts, users)
    daily = timeline.daily_means(placed, features, "author", "offset_from_cd1")
    found = periodicity(daily, snr_threshold=snr_threshold)
    voting = found.where(F.col("feature").isin(allowed)) if allowed else found
    return consensus.consensus_periods(voting, min_features, tolerance)


def all_methods(
    series: DataFrame,
    period_range: tuple[float, float] = (PERIOD_MIN, PERIOD_MAX),
    scaling: str = "zscore",
) -> DataFrame:
    """Three rows per valid series: Lomb-Scargle, plain and zero-padded Fourier."""
    fft = spectral.detect_periods(
        series,
        methods=("fft_interpolation", "fft_zeropad"),
        period_range=period_range,
        scaling=scaling,
    ).withColumn("period", F.col("period").cast("double"))
    ls = lomb.detect_periods_ls(series, scaling=scaling, min_span=period_range[0])
    return ls.unionByName(fft, allowMissingColumns=True)


def normalisation_grid(
    series: DataFrame,
    scalings: list[str],
    methods: tuple[str, ...] = (*FFT_METHODS, "lomb_scargle"),
    period_range: tuple[float, float] = (PERIOD_MIN, PERIOD_MAX),
    wide_range: tuple[float, float] = (WIDE_PERIOD_MIN, WIDE_PERIOD_MAX),
    fap_threshold: float = FAP_THRESHOLD,
    snr_threshold: float = SNR_THRESHOLD,
    filter_range: bool = False,
) -> DataFrame:
    """Every scaling with every method, filtered by false-alarm probability or ratio.

    The scalings become part of the series key, so all of them, and all Fourier
    methods, share one pass.
    """
    keys = ["user", "feature", "normalization"]
    over = W.partitionBy("user", "feature")
    value = F.col("value")
    columns = [scaled(value, over, s).alias(s) for s in scalings]
    rows = (
        spectral.daily_points(series, ["user", "feature"])
        .select("user", "feature", "day", *columns)
        .unpivot(["user", "feature", "day"], scalings, "normalization", "value")
    )
    # The gate applies to the scaled values.
    prepared = spectral.prepared_series(rows, keys, "none", period_range[0])
    parts = []
    fft = tuple(m for m in methods if m in spectral.METHODS)
    if "lomb_scargle" in methods:
        ls = lomb.detect_periods_ls(rows, keys, prepared=prepared)
        parts.append(clean.filter_fap(ls, fap_threshold))
    if fft:
        found = spectral.detect_periods(
            rows, keys, fft, period_range, wide_range, prepared=prepared
        ).withColumn("period", F.col("period").cast("double"))
        parts.append(clean.filter_snr(found, snr_threshold, strict=True))
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return clean.filter_period_range(out, *period_range) if filter_range else out
