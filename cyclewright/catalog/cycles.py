"""Queries: day series, spectra and the consensus period."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cyclewright.catalog.base import (
    EVENT_SERIES_SQL,
    GRID_SQL,
    ITEM_DAILY_SQL,
    ITEM_FEATURES,
    ITEM_MEANS,
    ITEM_SERIES_SQL,
    LINES_SQL,
    LOG_RATIO_SQL,
    OFFSETS_SQL,
    PEAK_COLUMNS,
    PREPARED_SQL,
    event_posts,
    event_series,
    event_users,
    item_daily,
    item_posts,
    item_series,
    item_timeline,
    item_users,
    log_ratio,
    peak_columns,
    peak_sql,
    query,
    r6,
)
from cyclewright.operators import clean, consensus, lomb, sinefit, spectral, summaries
from cyclewright.operators.anchors import add_offsets
from cyclewright.operators.scaling import zscore_daily_per_user, zscore_posts_per_user
from cyclewright.operators.timeline import daily_value
from cyclewright.plans import jobs
from cyclewright.settings import FAP_THRESHOLD

SHORT = (3, 10)


def _event_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spectral.detect_periods(event_series(spark, sf_dir), period_range=SHORT)


EVENT_PEAKS_SQL = peak_sql(EVENT_SERIES_SQL, *SHORT)

CONSENSUS_SQL = """,
votes as (
  select c."user", c.period, count(*) as votes
  from (select distinct "user", period from kept where period is not null) c
  join kept r on r."user" = c."user" and abs(r.period - c.period) <= {tolerance}
  group by all),
rows_of as (select "user", count(*) as n from kept where period is not null group by 1),
elected as (
  select v."user", cast(v.period as double) as consensus_period, v.votes as n_features_agreeing,
         v.votes / r.n * 100 as consensus_pct
  from (select *, row_number() over (partition by "user" order by votes desc, period) as rn
        from votes) v join rows_of r using ("user")
  where rn = 1 and votes >= {min_features} and r.n >= {min_features})"""


@query(
    "with"
    + EVENT_PEAKS_SQL
    + ", kept as (select * from found where peak_to_background >= 3)"
    + CONSENSUS_SQL.format(tolerance=1, min_features=2)
    + """ select "user", consensus_period, n_features_agreeing,
          round(consensus_pct, 6) as consensus_pct from elected"""
)
def flagship_cycles(spark, sf_dir):
    """Events to one period per user: offsets, daily features, spectra, vote."""
    kept = clean.filter_snr(_event_peaks(spark, sf_dir), 3.0)
    voted = consensus.consensus_periods(kept, min_features=2, tolerance=1)
    return voted.select(
        "user", "consensus_period", "n_features_agreeing", *r6("consensus_pct")
    )


@query(
    "with"
    + OFFSETS_SQL
    + """ select ev.event_id as id, ev.user_id as author, p.offset_from_cd1
          from ev left join placed p using (event_id)"""
)
def offsets_from_anchor(spark, sf_dir):
    posts = event_posts(spark, sf_dir)
    return add_offsets(posts, event_users(posts)).select("id", "author", "offset_from_cd1")


@query(
    "with"
    + OFFSETS_SQL
    + """ select user_id as author, offset_from_cd1, round(avg(value), 6) as feature_mean,
                 count(value) as n_entries from placed group by all"""
)
def daily_mean(spark, sf_dir):
    posts = event_posts(spark, sf_dir)
    placed = add_offsets(posts, event_users(posts))
    return daily_value(placed, ["author"], "offset_from_cd1", "value").select(
        "author", "offset_from_cd1", *r6("feature_mean"), "n_entries"
    )


@query(
    "with"
    + OFFSETS_SQL
    + """ select user_id as author, offset_from_cd1, round(median(value), 6) as feature_mean,
                 count(value) as n_entries from placed group by all"""
)
def daily_median(spark, sf_dir):
    posts = event_posts(spark, sf_dir)
    placed = add_offsets(posts, event_users(posts))
    return daily_value(placed, ["author"], "offset_from_cd1", "value", "median").select(
        "author", "offset_from_cd1", *r6("feature_mean"), "n_entries"
    )


@query(
    "with"
    + ITEM_DAILY_SQL
    + """ select author, offset_from_cd1, round(l_quantity_mean, 6) as l_quantity_mean,
                 round(l_extendedprice_mean, 6) as l_extendedprice_mean,
                 round(l_discount_mean, 6) as l_discount_mean, round(l_tax_mean, 6) as l_tax_mean
          from daily"""
)
def daily_features_wide(spark, sf_dir):
    daily = item_daily(spark, sf_dir)
    return daily.select(
        "author",
        "offset_from_cd1",
        *r6(*[c for c in daily.columns if c.endswith("_mean")]),
    )


@query(
    "with"
    + ITEM_DAILY_SQL
    + """ select count(*) as user_days, count(distinct author) as users,
                 round(count(*) / count(distinct author), 6) as days_per_user from daily"""
)
def days_per_user(spark, sf_dir):
    return summaries.days_per_user(item_daily(spark, sf_dir), "author").select(
        "user_days", "users", *r6("days_per_user")
    )




@query(
    "with"
    + ITEM_DAILY_SQL
    + " select author, offset_from_cd1, "
    + ", ".join(
        f"""round(case when stddev_samp({f}_mean) over w >= 1e-10 then
              ({f}_mean - avg({f}_mean) over w) / (stddev_samp({f}_mean) over w + 1e-10) end, 6) as {f}_zscore"""
        for f in ITEM_FEATURES
    )
    + " from daily window w as (partition by author)"
)
def zscore_sample(spark, sf_dir):
    out = zscore_daily_per_user(item_daily(spark, sf_dir), ITEM_MEANS, "author")
    return out.select("author", "offset_from_cd1", *r6(*[f"{f}_zscore" for f in ITEM_FEATURES]))


@query(
    """select event_id as id, user_id as author,
         round(case when count(value) over w >= 2 and stddev_pop(value) over w >= 1e-10 then
           (value - avg(value) over w) / (stddev_pop(value) over w + 1e-10) end, 6) as value_zscore
       from events window w as (partition by user_id)"""
)
def zscore_posts(spark, sf_dir):
    posts = event_posts(spark, sf_dir)
    return zscore_posts_per_user(posts, ["value"], "author").select(
        "id", "author", *r6("value_zscore")
    )


def _scaling_sql(expr: str) -> str:
    return (
        "with"
        + ITEM_SERIES_SQL
        + f""" select "user", feature, day, round({expr}, 6) as scaled
               from series window w as (partition by "user", feature)"""
    )


def _scaled(spark, sf_dir, method):
    return spectral.scale_series(item_series(spark, sf_dir), method).select(
        "user", "feature", "day", *r6("scaled")
    )


@query(_scaling_sql("(value - avg(value) over w) / (stddev_pop(value) over w + 1e-10)"))
def zscore_population(spark, sf_dir):
    return _scaled(spark, sf_dir, "zscore")


@query(
    _scaling_sql(
        "(value - min(value) over w) / (max(value) over w - min(value) over w + 1e-10)"
    )
)
def minmax_scaling(spark, sf_dir):
    return _scaled(spark, sf_dir, "minmax")


@query(
    "with"
    + EVENT_SERIES_SQL
    + """, g as (
      select "user", feature, count(*) as n_points, count(distinct day) as n_days,
             cast(max(day) - min(day) as double) as span_days, count(value) as n_valid,
             stddev_pop(value) as sd from series group by all)
    select "user", feature, n_points, n_days, span_days, n_valid, reason is null as is_valid, reason
    from (select *, case when n_points < 10 then 'few points' when n_days < 10 then 'few days'
            when span_days < 21 then 'short span' when n_valid = 0 then 'all missing'
            when n_valid < 2 then 'one value' when sd < 1e-10 then 'constant' end as reason
          from g)"""
)
def series_gate(spark, sf_dir):
    return clean.series_gate(event_series(spark, sf_dir), ["user", "feature"], "day", "value")


@query(
    "with"
    + EVENT_SERIES_SQL
    + PREPARED_SQL.format(min_span=0).replace(
        "(s.value - g.mu) / (g.sd + 1e-10) as y", "s.value as y"
    ).replace(
        """
  having count(*) >= 10 and max(day) - min(day) >= 0 and min(value) < max(value)
     and stddev_pop(value) >= 1e-10""",
        "",
    )
    + GRID_SQL
    + """ select g."user", g.feature, cast(i + d0 as integer) as grid_day,
                 round(v, 6) as grid_value, round(v - m, 6) as centred
          from grid g join centre using ("user", feature)"""
)
def interpolate_grid(spark, sf_dir):
    return spectral.daily_grid(event_series(spark, sf_dir)).select(
        "user", "feature", "grid_day", *r6("grid_value", "centred")
    )


@query(
    "with"
    + ITEM_SERIES_SQL
    + PREPARED_SQL.format(min_span=21)
    + GRID_SQL
    + LINES_SQL.format(size="n", low=21, high=35)
    + """ select "user", feature, cast(k as integer) as k, round(period, 6) as period,
                 round(power, 6) as power from lines"""
)
def dft_spectrum(spark, sf_dir):
    return spectral.spectrum(item_series(spark, sf_dir)).select(
        "user", "feature", "k", *r6("period", "power")
    )


@query("with" + peak_sql(ITEM_SERIES_SQL, 21, 35) + f" select {PEAK_COLUMNS} from found")
def dft_peak(spark, sf_dir):
    return peak_columns(spectral.detect_periods(item_series(spark, sf_dir)))


@query(
    "with"
    + peak_sql(ITEM_SERIES_SQL, 21, 35, padded=True, capped=True)
    + f" select {PEAK_COLUMNS} from found"
)
def zeropad_peak(spark, sf_dir):
    return peak_columns(
        spectral.detect_periods(item_series(spark, sf_dir), methods=("fft_zeropad",))
    )


@query(
    "with"
    + peak_sql(ITEM_SERIES_SQL, 10, 50, min_span=21)
    + f" select {PEAK_COLUMNS} from found"
)
def wide_peak(spark, sf_dir):
    return peak_columns(
        spectral.detect_periods(item_series(spark, sf_dir), methods=("fft_interpolation_wide",))
    )


@query(
    "with"
    + peak_sql(ITEM_SERIES_SQL, 10, 50, padded=True, min_span=21)
    + f" select {PEAK_COLUMNS} from found"
)
def wide_zeropad_peak(spark, sf_dir):
    return peak_columns(
        spectral.detect_periods(item_series(spark, sf_dir), methods=("fft_zeropad_wide",))
    )


# Power at whole-day periods: the full spectrum, its neighbours by period, a line between.
INTEGER_SQL = (
    ITEM_SERIES_SQL
    + PREPARED_SQL.format(min_span=21)
    + GRID_SQL
    + LINES_SQL.format(size="n", low=0, high=100000)
    + """,
spans as (
  select "user", feature, period as p0, power as w0,
         lead(period) over w as p1, lead(power) over w as w1
  from lines window w as (partition by "user", feature order by period)),
days as (select unnest(range(21, 36)) as p),
at_days as (
  select s."user", s.feature, d.p,
         case when s.p0 = d.p then s.w0 else s.w0 + (s.w1 - s.w0) / (s.p1 - s.p0) * (d.p - s.p0) end
           as power
  from spans s join days d on d.p >= s.p0 and (d.p < s.p1 or (s.p1 is null and d.p = s.p0)))"""
)


@query(
    "with"
    + INTEGER_SQL
    + """ select "user", feature, cast(p as integer) as period, round(power, 6) as power
          from at_days"""
)
def integer_period_power(spark, sf_dir):
    rows = spectral.integer_period_powers(item_series(spark, sf_dir))
    return rows.select("user", "feature", F.explode("lines").alias("l")).select(
        "user",
        "feature",
        F.col("l.k").alias("period"),
        F.round(-F.col("l.neg"), 6).alias("power"),
    )


@query(
    "with"
    + INTEGER_SQL
    + """, lines2 as (select "user", feature, p as period, power from at_days),
    ranked as (select *, row_number() over (partition by "user", feature order by power desc, period) as rn
               from lines2),
    p as (select "user", feature, max(period) filter (rn = 1) as period,
            max(power) filter (rn = 1) as best, median(power) filter (rn > 1) as med
          from ranked group by all)
    select g."user", g.feature, cast(p.period as integer) as period,
           round(coalesce(p.best, 0.0), 6) as power,
           case when p.best > 0 then round(log10(case when p.med is null or p.med < 1e-10
             then least(p.best / 1e-10, 1000.0) else p.best / (p.med + 1e-10) end), 6) end
             as log10_peak_to_background,
           g.n_points, cast(g.d1 - g.d0 as double) as span_days
    from gate g left join p using ("user", feature)"""
)
def integer_period_peak(spark, sf_dir):
    return peak_columns(spectral.detect_integer_periods(item_series(spark, sf_dir)))


@query(
    "with"
    + peak_sql(ITEM_SERIES_SQL, 21, 35)
    + f" select {PEAK_COLUMNS} from found where peak_to_background >= 3"
)
def periodicity_results(spark, sf_dir):
    """All features and users, kept by signal-to-noise ratio."""
    found = spectral.detect_periods(item_series(spark, sf_dir))
    return peak_columns(clean.filter_snr(found, 3.0))


SCALED_SERIES_SQL = (
    ITEM_SERIES_SQL
    + """,
scaled0 as (
  select "user", day, 'zscore:' || feature as feature,
    (value - avg(value) over w) / (stddev_pop(value) over w + 1e-10) as value
  from series window w as (partition by "user", feature)
  union all
  select "user", day, 'minmax:' || feature as feature,
    (value - min(value) over w) / (max(value) over w - min(value) over w + 1e-10) as value
  from series window w as (partition by "user", feature))"""
)


def _of_scaled(sql: str) -> str:
    """SQL over ``series`` turned to the scaled series, which are not scaled again."""
    return (
        sql.replace("from series group by all", "from scaled0 group by all")
        .replace("(s.value - g.mu) / (g.sd + 1e-10) as y", "s.value as y")
        .replace("from series s join gate", "from scaled0 s join gate")
    )


def _grid_sql(method: str, padded: bool, low: int, high: int, capped: bool) -> str:
    """One Fourier method of the scaling grid, for the two scalings."""
    body = _of_scaled(peak_sql(SCALED_SERIES_SQL, low, high, padded, capped, min_span=21))
    return f"""select "user", feature, '{method}' as method, cast(period as double) as period, power,
         peak_to_background, cast(null as double) as fap, n_points, span_days
       from (with{body} select * from found) where peak_to_background > 3"""


def _ls_grid_sql() -> str:
    """The Lomb-Scargle rows of the scaling grid."""
    body = _of_scaled(SCALED_SERIES_SQL + LS_FAP_SQL)
    return f"""select "user", feature, 'lombscargle' as method, period, power,
         cast(null as double) as peak_to_background, fap, n_points, span_days
       from (with{body} select * from alarms) where fap < {FAP_THRESHOLD}"""


def method_grid_sql() -> str:
    methods = [
        ("fft_interpolation", False, 21, 35, False),
        ("fft_zeropad", True, 21, 35, True),
        ("fft_interp_wide", False, 10, 50, False),
        ("fft_zeropad_wide", True, 10, 50, False),
    ]
    return f"""select "user", split_part(feature, ':', 2) as feature,
         split_part(feature, ':', 1) as normalization, method, period, round(power, 6) as power,
         {LOG_RATIO_SQL}, round(fap, 6) as fap, n_points, span_days
       from ({" union all ".join([*(_grid_sql(*m) for m in methods), _ls_grid_sql()])})
       where period between 21 and 35"""


@query(
    "with"
    + peak_sql(ITEM_SERIES_SQL, 21, 35)
    + """ select "user", feature, case when period is null then 'no period'
            when peak_to_background < 1.5 then 'low signal'
            when span_days / period < 1.5 then 'few cycles' end as reason from found"""
)
def period_significance(spark, sf_dir):
    found = spectral.detect_periods(item_series(spark, sf_dir))
    return found.select(
        "user",
        "feature",
        clean.significance(
            F.col("period"), F.col("peak_to_background"), F.col("span_days")
        ).alias("reason"),
    )


ITEM_KEPT_SQL = (
    peak_sql(ITEM_SERIES_SQL, 21, 35)
    + ", kept as (select * from found where peak_to_background >= 1)"
)


def _item_consensus(spark, sf_dir):
    found = clean.filter_snr(spectral.detect_periods(item_series(spark, sf_dir)), 1.0)
    return consensus.consensus_periods(found, min_features=2, tolerance=2)


ITEM_CONSENSUS_SQL = ITEM_KEPT_SQL + CONSENSUS_SQL.format(tolerance=2, min_features=2)


@query(
    "with"
    + ITEM_CONSENSUS_SQL
    + """ select "user", consensus_period, n_features_agreeing,
          round(consensus_pct, 6) as consensus_pct from elected"""
)
def consensus_vote(spark, sf_dir):
    return _item_consensus(spark, sf_dir).select(
        "user", "consensus_period", "n_features_agreeing", *r6("consensus_pct")
    )


@query(
    "with"
    + ITEM_CONSENSUS_SQL
    + """ select count(*) as n_users, round(avg(consensus_period), 6) as mean_period,
            median(consensus_period) as median_period,
            round(avg(n_features_agreeing), 6) as mean_agreeing,
            round(avg(consensus_pct), 6) as mean_pct from elected"""
)
def consensus_summary(spark, sf_dir):
    return consensus.consensus_summary(_item_consensus(spark, sf_dir)).select(
        "n_users", *r6("mean_period"), "median_period", *r6("mean_agreeing", "mean_pct")
    )


@query(
    "with"
    + ITEM_CONSENSUS_SQL
    + " select consensus_period, count(*) as n_users from elected group by 1"
)
def consensus_distribution(spark, sf_dir):
    return consensus.consensus_distribution(_item_consensus(spark, sf_dir))


@query(
    "with"
    + ITEM_CONSENSUS_SQL
    + """, ends as (
      select cast(floor(min(consensus_period)) as bigint) as lo,
             cast(floor(max(consensus_period)) as bigint) as hi, avg(consensus_period) as mean,
             median(consensus_period) as median, stddev_pop(consensus_period) as std, count(*) as n,
             min(n_features_agreeing) as min_agreeing from elected),
    b as (select unnest(range(lo, hi + 1)) as bin from ends)
    select b.bin, count(e."user") as n_users, round(any_value(ends.mean), 6) as mean,
           any_value(ends.median) as median, round(any_value(ends.std), 6) as std,
           any_value(ends.n) as n, any_value(ends.min_agreeing) as min_agreeing
    from ends, b left join elected e on floor(e.consensus_period) = b.bin group by b.bin"""
)
def consensus_histogram(spark, sf_dir):
    return consensus.consensus_histogram(_item_consensus(spark, sf_dir)).select(
        "bin", "n_users", *r6("mean"), "median", *r6("std"), "n", "min_agreeing"
    )


@query(
    "with"
    + peak_sql(ITEM_SERIES_SQL, 21, 35)
    + """ select feature, round(avg(period), 1) as mean_period,
            round(median(period), 1) as median_period, count(period) as n
          from found where period is not null group by 1"""
)
def period_stats(spark, sf_dir):
    return consensus.period_stats(spectral.detect_periods(item_series(spark, sf_dir)))


@query(
    "with"
    + peak_sql(ITEM_SERIES_SQL, 21, 35)
    + """ select count(period) as n, round(avg(period), 6) as mean_period,
            median(period) as median_period, round(log10(avg(peak_to_background)), 6) as log10_mean_snr,
            round(median(peak_to_background), 6) as median_snr from found"""
)
def overall_period_stats(spark, sf_dir):
    found = spectral.detect_periods(item_series(spark, sf_dir))
    return summaries.overall_period_stats(found).select(
        "n", *r6("mean_period"), "median_period", log_ratio("mean_snr"), *r6("median_snr")
    )


HISTOGRAM_SQL = (
    """select feature, method, bin, round(any_value(mean), 6) as mean, any_value(median) as median,
         any_value(n) as n, count(*) as count from (
       select *, cast(least(floor(period), last) as integer) as bin from (
         select *, avg(period) over w as mean, median(period) over w as median, count(*) over w as n,
                case when method like '%wide%' then greatest(ceil(max(period) over w), 50)
                     else 35 end as last
         from ("""
    + " union all ".join(
        f"select feature, period, '{name}' as method from (with "
        + peak_sql(ITEM_SERIES_SQL, low, high, padded, capped, min_span=21)
        + " select * from found)"
        for name, padded, low, high, capped in [
            ("fft_interpolation", False, 21, 35, False),
            ("fft_zeropad_wide", True, 10, 50, False),
        ]
    )
    + """) where period is not null window w as (partition by feature, method))
       where period between 10 and last + 1) group by feature, method, bin"""
)


@query(HISTOGRAM_SQL)
def period_histogram(spark, sf_dir):
    found = spectral.detect_periods(
        item_series(spark, sf_dir), methods=("fft_interpolation", "fft_zeropad_wide")
    )
    return consensus.period_histogram(found).select(
        "feature", "method", "bin", *r6("mean"), "median", "n", "count"
    )


# --- Lomb-Scargle and sine fit -----------------------------------------------------------

LS_SUMS_SQL = """,
trial as (select unnest(range(0, {count})) as j),
sums as (
  select p."user", p.feature, t.j, any_value(p.n_points) as n, any_value(p.d1 - p.d0) as span,
    cast(round(t.j * {step} + {low}, 6) as double) as period,
    sum(cos((p.day - p.d0) * 2 * pi() / (t.j * {step} + {low}))) as c,
    sum(sin((p.day - p.d0) * 2 * pi() / (t.j * {step} + {low}))) as s,
    sum(power(cos((p.day - p.d0) * 2 * pi() / (t.j * {step} + {low})), 2)) as cc,
    sum(cos((p.day - p.d0) * 2 * pi() / (t.j * {step} + {low}))
        * sin((p.day - p.d0) * 2 * pi() / (t.j * {step} + {low}))) as cs,
    sum(p.y * cos((p.day - p.d0) * 2 * pi() / (t.j * {step} + {low}))) as yc,
    sum(p.y * sin((p.day - p.d0) * 2 * pi() / (t.j * {step} + {low}))) as ys,
    sum(p.y) as y, sum(p.y * p.y) as yy
  from prepared p, trial t group by p."user", p.feature, t.j)"""

LS_POWER_SQL = """,
hats as (
  select "user", feature, j, period, n, span, yy / n - (y / n) * (y / n) as hyy,
    yc / n - (y / n) * (c / n) as hyc, ys / n - (y / n) * (s / n) as hys,
    cc / n - (c / n) * (c / n) as hcc, 1 - cc / n - (s / n) * (s / n) as hss,
    cs / n - (c / n) * (s / n) as hcs from sums),
powers as (
  select *, (hyc * hyc * hss + hys * hys * hcc - 2 * hyc * hys * hcs)
            / (hyy * (hcc * hss - hcs * hcs)) as power from hats)"""


@query(
    "with"
    + ITEM_SERIES_SQL
    + PREPARED_SQL.format(min_span=21)
    + LS_SUMS_SQL.format(count=801, step=0.1, low=10.0)
    + LS_POWER_SQL
    + """ select "user", feature, period, round(power, 6) as power, n as n_points,
            cast(span as double) as span_days
          from (select *, row_number() over (partition by "user", feature order by power desc, j) as rn
                from powers) where rn = 1"""
)
def ls_peak(spark, sf_dir):
    return lomb.detect_periods_ls(item_series(spark, sf_dir)).select(
        "user", "feature", "period", *r6("power"), "n_points", "span_days"
    )


def _gamma_ratio_sql(n: str) -> str:
    return f"exp(lgamma(({n} - 1) / 2) - lgamma(({n} - 2) / 2))"


LS_FAP_SQL = (
    PREPARED_SQL.format(min_span=21)
    + LS_SUMS_SQL.format(count=801, step=0.1, low=10.0)
    + LS_POWER_SQL
    + f""", spread as (select "user", feature, var_pop(day) as vt from prepared group by all),
    best as (
      select "user", feature, n, span, power as z, period
      from (select *, row_number() over (partition by "user", feature order by power desc, j) as rn from powers)
      where rn = 1),
    w as (
      select *, (1 / (5 * span) / 2 + 1 / (5 * span) * (floor(12.5 * n) - 1))
                * sqrt(4 * pi() * vt) as w from best join spread using ("user", feature)),
    alarms as (
      select "user", feature, period, z as power, n as n_points, cast(span as double) as span_days,
        1 - (1 - power(1 - z, (n - 3) / 2))
          * exp(-(sqrt(2 / (n - 1)) * {_gamma_ratio_sql("n")} * w * power(1 - z, (n - 4) / 2)
                  * sqrt((n - 1) * z / 2))) as fap from w)"""
)


@query("with" + ITEM_SERIES_SQL + LS_FAP_SQL + """ select "user", feature, round(fap, 6) as fap from alarms""")
def ls_false_alarm(spark, sf_dir):
    return lomb.detect_periods_ls(item_series(spark, sf_dir)).select("user", "feature", *r6("fap"))


@query(method_grid_sql())
def normalisation_grid(spark, sf_dir):
    """Every scaling with every method, by ratio or false-alarm probability and in range."""
    found = jobs.normalisation_grid(
        item_series(spark, sf_dir), ["zscore", "minmax"], filter_range=True
    )
    return found.select(
        "user",
        "feature",
        "normalization",
        "method",
        "period",
        *r6("power"),
        log_ratio(),
        *r6("fap"),
        "n_points",
        "span_days",
    )


ALL_METHODS_SQL = (
    """select "user", feature, 'lombscargle' as method, period, round(power, 6) as power,
         cast(null as double) as log10_peak_to_background, round(fap, 6) as fap, n_points, span_days
       from (with"""
    + ITEM_SERIES_SQL
    + LS_FAP_SQL
    + " select * from alarms)"
    + "".join(
        f""" union all select "user", feature, '{method}' as method, cast(period as double) as period,
         round(power, 6) as power, {LOG_RATIO_SQL}, cast(null as double) as fap, n_points, span_days
       from (with{peak_sql(ITEM_SERIES_SQL, 21, 35, padded=padded, capped=padded)} select * from found)"""
        for method, padded in (("fft_interpolation", False), ("fft_zeropad", True))
    )
)


@query(ALL_METHODS_SQL)
def all_methods(spark, sf_dir):
    """Lomb-Scargle, plain and zero-padded Fourier over all users and features."""
    return jobs.all_methods(item_series(spark, sf_dir)).select(
        "user", "feature", "method", "period", *r6("power"), log_ratio(), *r6("fap"), "n_points", "span_days"
    )


@query(
    "with"
    + ITEM_SERIES_SQL
    + PREPARED_SQL.format(min_span=21)
    + LS_SUMS_SQL.format(count=15, step=1.0, low=21)
    + """, powers as (
      select *, (yc * yc * (n - cc) + ys * ys * cc - 2 * yc * ys * cs)
                / (yy * (cc * (n - cc) - cs * cs)) as power from sums),
    ranked as (select *, row_number() over (partition by "user", feature order by power desc, j) as rn
               from powers),
    p as (select "user", feature, max(period) filter (rn = 1) as period, any_value(n) as n_points,
            max(power) filter (rn = 1) as best, median(power) filter (rn > 1) as med
          from ranked group by all)
    select "user", feature, period, round(best, 6) as power,
      round(case when med < 1e-10 then least(best / 1e-10, 1000.0) else best / (med + 1e-10) end, 6)
        as peak_to_background, n_points from p"""
)
def ls_classic_peak(spark, sf_dir):
    return lomb.detect_periods_classic(item_series(spark, sf_dir)).select(
        "user", "feature", "period", *r6("power", "peak_to_background"), "n_points"
    )


SINE_SQL = (
    peak_sql(ITEM_SERIES_SQL, 21, 35)
    + """,
pts as (
  select s."user", s.feature, f.period, s.day, s.value as y,
         sin(s.day * 2 * pi() / f.period) as s, cos(s.day * 2 * pi() / f.period) as c
  from series s join found f using ("user", feature) where f.period is not null),
m as (
  select "user", feature, period, count(*) as n, avg(y) as my, avg(s) as ms, avg(c) as mc,
    covar_pop(s, s) as ss, covar_pop(c, c) as cc, covar_pop(s, c) as sc,
    covar_pop(s, y) as sy, covar_pop(c, y) as cy, min(day) as d0, max(day) as d1
  from pts group by all),
ab as (
  select *, (sy * cc - cy * sc) / (ss * cc - sc * sc) as a,
            (cy * ss - sy * sc) / (ss * cc - sc * sc) as b from m),
fits as (
  select "user", feature, period, n, d0, d1, sqrt(a * a + b * b) as amplitude, atan2(b, a) as phase,
         my - a * ms - b * mc as level from ab)"""
)


def _fits(spark, sf_dir):
    series = item_series(spark, sf_dir)
    periods = (
        spectral.detect_periods(series)
        .where(F.col("period").isNotNull())
        .select("user", "feature", "period")
    )
    return sinefit.fit_sine(series.join(periods, ["user", "feature"]), "period")


@query(
    "with"
    + SINE_SQL
    + """ select "user", feature, period, n, round(amplitude, 6) as amplitude,
            round(phase, 6) as phase, round(level, 6) as level from fits"""
)
def sine_fit(spark, sf_dir):
    return _fits(spark, sf_dir).select(
        "user", "feature", "period", "n", *r6("amplitude", "phase", "level")
    )


@query(
    "with"
    + SINE_SQL
    + """ select "user", feature, round(d0 + (d1 - d0) * i / 999, 6) as x,
            round(amplitude * sin((d0 + (d1 - d0) * i / 999) * 2 * pi() / period + phase) + level, 4)
              as fitted
          from fits, (select unnest(range(0, 1000)) as i)"""
)
def sine_curve(spark, sf_dir):
    return sinefit.sine_curve(_fits(spark, sf_dir), "period").select(
        "user", "feature", *r6("x"), F.round("fitted", 4).alias("fitted")
    )


@query(
    "with"
    + ITEM_DAILY_SQL
    + """ select l_orderkey as id, l_linenumber, offset_from_cd1 from item
          where offset_from_cd1 between -30 and 60"""
)
def offset_range_rows(spark, sf_dir):
    return clean.offset_range(item_timeline(spark, sf_dir), 30, 60).select(
        "id", "l_linenumber", "offset_from_cd1"
    )


# --- series and jobs straight from rows -------------------------------------------------------

# Lines of a supplier as rows of several a day; the day column of the second kind is used where it has a value.
ROWS_SQL = (
    ITEM_DAILY_SQL
    + """,
raw as (select l_suppkey as author, offset_from_cd1, offset_from_cd1 + 3 as dpo_days,
          repeat('x', cast(l_quantity as integer)) as text, l_discount from item),
series as (
  select author as "user", {day} as day, 'text' as feature, avg(length(text)) as value from raw group by all
  union all
  select author, {day}, 'l_discount', avg(l_discount) from raw group by all)"""
)


def _rows(spark, sf_dir):
    return item_timeline(spark, sf_dir).select(
        "author",
        "offset_from_cd1",
        (F.col("offset_from_cd1") + 3).alias("dpo_days"),
        F.repeat(F.lit("x"), F.col("l_quantity").cast("int")).alias("text"),
        "l_discount",
    )


@query(
    "with" + peak_sql(ROWS_SQL.format(day="dpo_days"), 21, 35) + f" select {PEAK_COLUMNS} from found"
)
def series_from_rows(spark, sf_dir):
    """Periods of rows with several values a day: text by its length, days since ovulation first."""
    series = jobs.row_series(_rows(spark, sf_dir), ["text", "l_discount"])
    return peak_columns(spectral.detect_periods(series))


@query(
    "with"
    + peak_sql(ROWS_SQL.format(day="offset_from_cd1"), 21, 35)
    + f" select {PEAK_COLUMNS} from found"
)
def series_without_second_day(spark, sf_dir):
    """The same rows where the second day column has no value."""
    rows = _rows(spark, sf_dir).withColumn("dpo_days", F.lit(None).cast("int"))
    return peak_columns(spectral.detect_periods(jobs.row_series(rows, ["text", "l_discount"])))


@query(
    "with"
    + peak_sql(ITEM_SERIES_SQL, 21, 35)
    + f""", kept as (select * exclude (feature), replace(feature, '_mean', '') as feature from found
          where peak_to_background >= 3
            and feature in ('l_quantity_mean', 'l_discount_mean', 'l_tax_mean'))"""
    + CONSENSUS_SQL.format(tolerance=2, min_features=2)
    + """ select "user", consensus_period, n_features_agreeing,
          round(consensus_pct, 6) as consensus_pct from elected"""
)
def user_cycles(spark, sf_dir):
    """The whole job from posts and anchors to one period per user, three features allowed to vote."""
    posts = item_posts(spark, sf_dir)
    allowed = ["l_quantity", "l_discount", "l_tax"]
    found = jobs.user_cycles(
        posts, item_users(posts), ITEM_FEATURES, allowed, min_features=2, tolerance=2, snr_threshold=3.0
    )
    return found.select("user", "consensus_period", "n_features_agreeing", *r6("consensus_pct"))


@query(
    "with"
    + peak_sql(ITEM_SERIES_SQL, 21, 35)
    + """ select "user", replace(feature, '_mean', '') as feature, period, round(power, 6) as power,
         """
    + LOG_RATIO_SQL
    + """, n_points, span_days from found where peak_to_background >= 3"""
)
def periodicity_job(spark, sf_dir):
    """The periodicity job on a wide daily table; its features are the mean columns."""
    return peak_columns(jobs.periodicity(item_daily(spark, sf_dir), snr_threshold=3.0))
