"""Cohort against control: membership, ever-posted rates, volumes by phase, balance."""

from __future__ import annotations

from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cyclewright.functions.phases import adaptive_bounds, adaptive_phase
from cyclewright.operators.clean import keep_categories, offset_range
from cyclewright.plans.quantiles import exact_medians
from cyclewright.settings import COHORT_WINDOW_DAYS, EPSILON, FALLBACK_PERIOD

CategorySets = dict[str, list[str]]


def label_cohorts(
    users: DataFrame,
    posts: DataFrame,
    marker_categories: list[str],
    category: str,
    author: str = "author",
    names: tuple[str, str] = ("cohort", "control"),
) -> DataFrame:
    """(user, group): the cohort has at least one post in the marker categories."""
    marked = keep_categories(posts, marker_categories, category).select(
        F.col(author).alias("user"), F.lit(False).alias("__user"), F.lit(True).alias("__marked")
    )
    known = users.select("user", F.lit(True).alias("__user"), F.lit(False).alias("__marked"))
    # One aggregate instead of two and a join.
    flags = known.unionByName(marked).where(F.col("user").isNotNull()).groupBy("user")
    flags = flags.agg(F.max("__user").alias("__user"), F.max("__marked").alias("__marked"))
    group = F.when(F.col("__marked"), F.lit(names[0])).otherwise(F.lit(names[1]))
    return flags.where("__user").select("user", group.alias("group"))


def ever_posted(
    posts: DataFrame,
    cohorts: DataFrame,
    categories: CategorySets,
    category: str,
    author: str = "author",
) -> DataFrame:
    """Users of each group that ever posted in each category set, and their share."""
    flags = [F.max(F.col(category).isin(c).cast("int")).alias(f"__{n}") for n, c in categories.items()]
    # One row per posting user before any join.
    by_user = (
        keep_categories(posts, sorted({x for c in categories.values() for x in c}), category)
        .groupBy(F.col(author).alias("user"))
        .agg(*flags)
    )
    labelled = cohorts.join(by_user, "user", "left")
    return labelled.groupBy("group").agg(
        F.count(F.lit(1)).alias("n_users"),
        *[F.coalesce(F.sum(f"__{n}"), F.lit(0).cast("long")).alias(f"n_{n}") for n in categories],
        *[
            (F.coalesce(F.sum(f"__{n}"), F.lit(0).cast("long")) / F.count(F.lit(1)) * 100).alias(
                f"pct_{n}"
            )
            for n in categories
        ],
    )


def phase_volumes(
    posts: DataFrame,
    categories: CategorySets,
    category: str,
    author: str = "author",
    group: str | None = None,
    cycle: str = "period",
) -> DataFrame:
    """Posting volume of each category set by phase (and by a group column of the posts).

    Posts carry their ``phase`` and their user's cycle length. One aggregate counts the
    posts of every phase per user; the phases without posts are zeros of the same row,
    so no grid is joined. Raw sums run over users and phases; volumes are means over
    phases with any counted post; z-scores, taken per user over the phases with the
    sample deviation, are means over users with a post of that set anywhere. Users need
    a phased post and a cycle length.
    """
    by = [group] if group else []
    lengths = _phase_lengths(cycle)

    def count(phase: str, wanted: list[str] | None) -> Column:
        hit = F.col("phase") == phase
        if wanted is not None:
            hit = hit & F.coalesce(F.col(category).isin(wanted), F.lit(False))
        return F.count_if(hit)

    per_user = (
        posts.where(F.col("phase").isNotNull() & F.col(cycle).isNotNull())
        .groupBy(*by, F.col(author).alias("user"), cycle)
        .agg(
            *[count(p, None).alias(f"{p}:posts") for p in lengths],
            *[count(p, c).alias(f"{p}:{n}") for p in lengths for n, c in categories.items()],
        )
    )
    return _volume_stats(per_user, list(categories), by, lengths)


def _phase_lengths(cycle: str) -> dict[str, Column]:
    return {name: end - start + 1 for name, start, end in adaptive_bounds(F.col(cycle))}


def _volume_stats(
    per_user: DataFrame, names: list[str], by: list[str], lengths: dict[str, Column]
) -> DataFrame:
    """Statistics by phase from one row a user with the counts ``phase:posts`` and ``phase:set``."""

    def volume(phase: str, n: str) -> Column:
        length = lengths[phase]
        return F.when(length > 0, F.col(f"{phase}:{n}") / length).otherwise(0.0)

    k = len(lengths)
    moments = {}
    for n in names:
        volumes = [volume(p, n) for p in lengths]
        mean = reduce(lambda a, b: a + b, volumes) / k
        squares = reduce(lambda a, b: a + b, [(v - mean) * (v - mean) for v in volumes])
        raws = reduce(lambda a, b: a + b, [F.col(f"{p}:{n}") for p in lengths])
        moments |= {f"{n}:mean": mean, f"{n}:std": F.sqrt(squares / (k - 1)), f"{n}:ever": raws > 0}

    def cell(phase: str) -> Column:
        fields = [F.lit(phase).alias("phase"), (F.col(f"{phase}:posts") > 0).alias("posted")]
        for n in names:
            std = F.col(f"{n}:std")
            unit = F.when(std < EPSILON, F.lit(1.0)).otherwise(std)
            fields += [
                F.col(f"{phase}:{n}").alias(f"{n}_raw"),
                volume(phase, n).alias(f"{n}_volume"),
                ((volume(phase, n) - F.col(f"{n}:mean")) / unit).alias(f"{n}_z"),
                F.col(f"{n}:ever").alias(f"{n}_ever"),
            ]
        return F.struct(*fields)

    scored = (
        per_user.withColumns(moments)
        .select(*by, F.explode(F.array(*map(cell, lengths))).alias("c"))
        .select(*by, "c.*")
    )
    any_post = reduce(lambda a, b: a | b, [F.col(f"{n}_raw") > 0 for n in names])
    return scored.groupBy(*by, "phase").agg(
        *[
            F.coalesce(F.avg(F.when(any_post, F.col(f"{n}_volume"))), F.lit(0.0)).alias(f"{n}_volume")
            for n in names
        ],
        *[F.sum(f"{n}_raw").alias(f"{n}_raw") for n in names],
        *[
            F.coalesce(F.avg(F.when(F.col(f"{n}_ever"), F.col(f"{n}_z"))), F.lit(0.0)).alias(
                f"{n}_zscore"
            )
            for n in names
        ],
        F.count_if("posted").alias("n_users"),
        *[F.count_if(F.col(f"{n}_raw") > 0).alias(f"n_users_{n}") for n in names],
    )


def cohort_report(
    posts: DataFrame,
    users: DataFrame,
    cohorts: DataFrame,
    consensus: DataFrame | None,
    categories: CategorySets,
    category: str,
    author: str = "author",
    offset: str = "offset_from_cd1",
    window_days: int = COHORT_WINDOW_DAYS,
    fallback_period: float = FALLBACK_PERIOD,
    both: bool = True,
) -> DataFrame:
    """Category volumes by phase for each group, from posts that carry an offset.

    Groups are cut to users with a consensus period; without any period, or with
    ``consensus=None``, all users get the fallback length. A lone group compares with
    nothing and gives no rows, unless ``both`` is off.
    """
    wanted = sorted({x for c in categories.values() for x in c})
    inside = keep_categories(offset_range(posts, window_days, window_days, offset), wanted, category)
    sets = {f":{n}": F.count_if(F.col(category).isin(c)).alias(f":{n}") for n, c in categories.items()}
    daily = inside.groupBy(F.col(author).alias("user"), F.col(offset).cast("double").alias("day")).agg(
        F.count(F.lit(1)).alias(":posts"), *sets.values()
    )
    facts = {
        "days": F.struct("day", ":posts", *sets),
        "group": F.col("group"),
        "period": F.col("consensus_period").cast("double"),
        "member": F.lit(True),
    }

    def carrying(df: DataFrame, name: str) -> DataFrame:
        return df.select("user", facts[name].alias(name))

    # The days of a user, which the window bounds, and all that is known of it: one keyed pass.
    rows = carrying(daily, "days")
    sources = [(cohorts, "group"), (users, "member")]
    if consensus is not None:
        sources.append((consensus.where(F.col("consensus_period").isNotNull()), "period"))
    for df, name in sources:
        rows = rows.unionByName(carrying(df, name), allowMissingColumns=True)
    if consensus is None:
        rows = rows.withColumn("period", F.lit(None).cast("double"))
    state = rows.where(F.col("user").isNotNull()).groupBy("user").agg(
        F.collect_list("days").alias("days"),
        F.collect_set("group").alias("groups"),
        F.max("period").alias("period"),
        F.max("member").alias("member"),
    )
    # Users without a period only count where no user has one; both are told apart to the end.
    known = F.col("period").isNotNull()
    state = state.withColumns(
        {"known": known, "period": F.coalesce("period", F.lit(float(fallback_period)))}
    )
    lengths = _phase_lengths("period")
    days = state.select("user", "groups", "period", "known", "member", F.inline_outer("days"))
    phased = days.withColumn("phase", adaptive_phase(F.col("day"), F.col("period")))
    per_user = phased.groupBy("user", "groups", "period", "known", "member").agg(
        *[
            F.coalesce(F.sum(F.when(F.col("phase") == p, F.col(f":{n}"))), F.lit(0).cast("long")).alias(f"{p}:{n}")
            for p in lengths
            for n in ("posts", *categories)
        ]
    )
    counted = reduce(lambda x, y: x + y, [F.col(f"{p}:posts") for p in lengths]) > 0
    counted = counted & F.coalesce(F.col("member"), F.lit(False))
    # A user that isn't counted still says whether a period is known.
    per_user = per_user.withColumn(
        "group", F.explode_outer(F.when(counted, F.col("groups")))
    ).drop("groups", "member")
    stats = _volume_stats(per_user, list(categories), ["known", "group"], lengths)
    # A few rows: a group, phase and flag each.
    whole = W.partitionBy()
    out = stats.withColumn("__known", F.max("known").over(whole))
    out = out.where((F.col("known") == F.col("__known")) & F.col("group").isNotNull()).drop("known", "__known")
    if not both:
        return out
    # A few rows: a group and phase each.
    groups = F.size(F.collect_set("group").over(W.partitionBy()))
    return out.withColumn("__groups", groups).where("__groups = 2").drop("__groups")


def before_after_counts(df: DataFrame, user: str, offset: str) -> DataFrame:
    """Posts before and after day zero per user, and their ratio; null ratio without posts before.

    A null ratio stands for an infinite one: the user only posts afterwards.
    """
    counts = (
        df.where(F.col(offset).isNotNull() & F.col(user).isNotNull() & (F.col(offset) != 0))
        .groupBy(user)
        .agg(
            F.count_if(F.col(offset) < 0).alias("posts_before"),
            F.count_if(F.col(offset) > 0).alias("posts_after"),
        )
    )
    return counts.withColumn(
        "ratio", F.try_divide(F.col("posts_after"), F.col("posts_before"))
    )


def before_after_summary(counts: DataFrame) -> DataFrame:
    """Mean and median ratio of users with posts on both sides, and the one-sided users, in one row.

    Runs when called: equal ratios are counted once, with their number of users, and
    kept on the executors' disks; all figures come from that table.
    """
    before, after = F.col("posts_before") > 0, F.col("posts_after") > 0
    ratios = counts.groupBy(
        F.when(before & after, F.col("ratio")).alias("ratio"),
        before.alias("before"),
        after.alias("after"),
    ).agg(F.count(F.lit(1)).alias("n"))
    ratios = ratios.persist(StorageLevel.DISK_ONLY)
    both = F.col("before") & F.col("after")

    def users(c: Column) -> Column:
        return F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0).cast("long"))

    try:
        row = ratios.agg(
            F.try_divide(F.sum(F.col("ratio") * F.col("n")), users(both)).alias("mean_ratio"),
            users(both).alias("n_users"),
            users(~F.col("after")).alias("n_users_before_only"),
            users(~F.col("before")).alias("n_users_after_only"),
        ).first()
        median = exact_medians(ratios, ["ratio"], "n")["ratio"]
    finally:
        ratios.unpersist()
    return counts.sparkSession.createDataFrame(
        [(*row, median)],
        "mean_ratio double, n_users long, n_users_before_only long, n_users_after_only long, median_ratio double",
    )
