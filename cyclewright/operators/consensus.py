"""One period per user by a vote of features, and summaries of periods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cyclewright.settings import CONSENSUS_MIN_FEATURES, CONSENSUS_TOLERANCE


def consensus_periods(
    results: DataFrame,
    min_features: int = CONSENSUS_MIN_FEATURES,
    tolerance: int = CONSENSUS_TOLERANCE,
    user: str = "user",
) -> DataFrame:
    """Period with most rows within ``tolerance`` days per user; ties go to the smallest.

    Rows are counted per distinct period first, and the votes are a range frame
    over those counts, so no pairs of rows are built.
    """
    counts = (
        results.where(F.col("period").isNotNull())
        .groupBy(user, F.col("period").cast("double").alias("period"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    near = W.partitionBy(user).orderBy("period").rangeBetween(-tolerance, tolerance)
    voted = counts.select(user, "period", "n", F.sum("n").over(near).alias("votes"))
    best = voted.groupBy(user).agg(
        F.max(F.struct(F.col("votes"), (-F.col("period")).alias("order"))).alias("b"),
        F.sum("n").alias("rows"),
    )
    return (
        best.where((F.col("rows") >= min_features) & (F.col("b.votes") >= min_features))
        .select(
            user,
            (-F.col("b.order")).alias("consensus_period"),
            F.col("b.votes").alias("n_features_agreeing"),
            (F.col("b.votes") / F.col("rows") * 100).alias("consensus_pct"),
        )
    )


def consensus_summary(consensus: DataFrame) -> DataFrame:
    """Users, mean and median period, mean agreeing features and mean share.

    Periods are whole days in a short range, so the exact median holds few values.
    """
    return consensus.agg(
        F.count(F.lit(1)).alias("n_users"),
        F.avg("consensus_period").alias("mean_period"),
        F.median("consensus_period").alias("median_period"),
        F.avg("n_features_agreeing").alias("mean_agreeing"),
        F.avg("consensus_pct").alias("mean_pct"),
    )


def consensus_distribution(consensus: DataFrame) -> DataFrame:
    return (
        consensus.groupBy("consensus_period")
        .agg(F.count(F.lit(1)).alias("n_users"))
        .orderBy("consensus_period")
    )


def consensus_histogram(consensus: DataFrame) -> DataFrame:
    """Users per whole-day bin, with the bins of no user between the ends, and the spread.

    Periods lie in a short range of days, so users are counted by period first and all
    figures, the median too, are arithmetic on those few rows.
    """
    p, n = F.col("consensus_period"), F.col("n_period")
    counts = (
        consensus.where(p.isNotNull())
        .groupBy("consensus_period")
        .agg(F.count(F.lit(1)).alias("n_period"), F.min("n_features_agreeing").alias("least"))
    )
    seen = F.sort_array(F.collect_list(F.struct(p.cast("double").alias("p"), n.alias("n"))))
    mean = F.sum(p * n) / F.sum(n)
    folded = counts.agg(
        seen.alias("seen"),
        F.floor(F.min(p)).alias("lo"),
        F.floor(F.max(p)).alias("hi"),
        mean.alias("mean"),
        F.sum(n).alias("n"),
        F.min("least").alias("min_agreeing"),
    ).where(F.col("n") > 0)

    def at(rank: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("upto"), F.lit(None).cast("double").alias("v"))
        return F.aggregate(
            "seen",
            start,
            lambda acc, x: F.struct(
                (acc["upto"] + x["n"]).alias("upto"),
                F.coalesce(acc["v"], F.when(acc["upto"] + x["n"] >= rank, x["p"])).alias("v"),
            ),
            lambda acc: acc["v"],
        )

    far = F.aggregate(
        "seen",
        F.lit(0.0),
        lambda acc, x: acc + x["n"] * (x["p"] - F.col("mean")) * (x["p"] - F.col("mean")),
    )
    median = (at(F.floor((F.col("n") + 1) / 2)) + at(F.floor((F.col("n") + 2) / 2))) / 2
    rows = folded.withColumns({"median": median, "std": F.sqrt(far / F.col("n"))})
    inside = F.filter("seen", lambda x: F.floor(x["p"]) == F.col("bin"))
    users = F.aggregate(inside, F.lit(0).cast("long"), lambda acc, x: acc + x["n"])
    return rows.withColumn("bin", F.explode(F.sequence("lo", "hi"))).select(
        "bin", users.alias("n_users"), "mean", "median", "std", "n", "min_agreeing"
    )


def period_stats(results: DataFrame) -> DataFrame:
    """Mean, median and count of the period per feature, one decimal, sorted by mean."""
    return (
        results.where(F.col("period").isNotNull())
        .groupBy("feature")
        .agg(
            F.round(F.avg("period"), 1).alias("mean_period"),
            F.round(F.median("period"), 1).alias("median_period"),
            F.count("period").alias("n"),
        )
        .orderBy("mean_period", "feature")
    )


def period_histogram(results: DataFrame, wide_max: float | None = None) -> DataFrame:
    """Rows per feature, method and whole-day bin.

    The bins run from 10 to 50 or the group's largest period for wide methods,
    to 90 for lombscargle and to 35 otherwise; a value on the upper end counts in
    the last bin and values outside in none. Mean and median are of all rows.
    """
    known = results.where(F.col("period").isNotNull())
    stats = known.groupBy("feature", "method").agg(
        F.avg("period").alias("mean"),
        F.median("period").alias("median"),
        F.count(F.lit(1)).alias("n"),
        F.ceil(F.max("period")).alias("top"),
    )
    wide_top = F.lit(int(-(-wide_max // 1))) if wide_max is not None else F.greatest("top", F.lit(50))
    last = (
        F.when(F.col("method").contains("wide"), wide_top)
        .when(F.col("method") == "lombscargle", F.lit(90))
        .otherwise(F.lit(35))
    )
    cells = known.groupBy("feature", "method", F.col("period").cast("double").alias("period")).agg(
        F.count(F.lit(1)).alias("c")
    )
    edged = cells.join(stats, ["feature", "method"]).withColumn("last", last.cast("double"))
    inside = edged.where(F.col("period").between(F.lit(10.0), F.col("last") + 1))
    return inside.groupBy(
        "feature",
        "method",
        F.least(F.floor("period"), F.col("last")).cast("int").alias("bin"),
        "mean",
        "median",
        "n",
    ).agg(F.sum("c").alias("count"))
