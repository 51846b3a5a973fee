"""Exact medians without gathering values: of whole columns by counted digits, of groups by running counts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Bits of a value's image that one round of the selection counts.
DIGIT_BITS = 16
LOW_BITS = np.int64((1 << 63) - 1)


def _flipped(bits: np.ndarray) -> np.ndarray:
    """Bits of doubles to longs that sort as the doubles do, and back: negative ones in reverse."""
    return bits ^ ((bits >> np.int64(63)) & LOW_BITS)


def ordered_image(value: Column) -> Column:
    """A double as a long of the same order; -0.0 is 0.0."""

    @F.arrow_udf("long")
    def image(batch: pa.Array) -> pa.Array:
        numbers = batch.to_numpy(zero_copy_only=False) + 0.0
        return pa.array(_flipped(numbers.view(np.int64)))

    return image(value)


def _number(image: int) -> float:
    return float(_flipped(np.array([image], np.int64)).view(np.float64)[0])


def exact_medians(df: DataFrame, values: list[str], weight: str | None = None) -> dict[str, float | None]:
    """The exact median of each column; None without values. Nulls and NaN don't count.

    ``weight`` is a column of how often each row counts. Distinct values are counted
    once and kept on the executors' disks while the middle ranks are selected: a round
    counts one digit of the values' images behind the digits that are known, for all
    columns together, and sends the driver at most ``2^DIGIT_BITS`` counts a rank. What
    it finds depends on the values alone, not on how a plan shares or deals them.
    """
    n = F.col(weight).cast("long") if weight else F.lit(1).cast("long")
    each = [F.struct(F.lit(v).alias("of"), F.col(v).cast("double").alias("v")) for v in values]
    rows = df.select(n.alias("n"), F.explode(F.array(*each)).alias("x")).select("n", "x.of", "x.v")
    counted = rows.where(F.col("v").isNotNull() & ~F.isnan("v")).groupBy("of", "v").agg(F.sum("n").alias("n"))
    counted = counted.select("of", ordered_image(F.col("v")).alias("image"), "n").persist(StorageLevel.DISK_ONLY)
    try:
        totals = {r["of"]: r["n"] for r in counted.groupBy("of").agg(F.sum("n").alias("n")).collect()}
        # (column, rank) to (digits known so far, values before them).
        wanted = {(v, k): (None, 0) for v, t in totals.items() for k in ((t + 1) // 2, (t + 2) // 2)}
        for shift in range(64 - DIGIT_BITS, -1, -DIGIT_BITS):
            prefix = F.shiftright("image", min(shift + DIGIT_BITS, 63))
            known = {(v, p) for (v, _), (p, _) in wanted.items()}
            inside = F.lit(False)
            for v, p in sorted(known, key=repr):
                inside = inside | ((F.col("of") == v) & (F.lit(True) if p is None else prefix == p))
            found = counted.where(inside).groupBy("of", F.shiftright("image", shift).alias("digits"))
            digits = found.agg(F.sum("n").alias("n")).toPandas().sort_values(["of", "digits"])
            for (v, k), (p, before) in wanted.items():
                own = digits[digits["of"] == v]
                if p is not None:
                    own = own[own["digits"].to_numpy() >> DIGIT_BITS == p]
                upto = before + own["n"].cumsum().to_numpy()
                at = int(np.searchsorted(upto, k))
                wanted[v, k] = int(own["digits"].iloc[at]), int(upto[at] - own["n"].iloc[at])
    finally:
        counted.unpersist()
    middle: dict[str, list[float]] = {v: [] for v in values}
    for v, t in totals.items():
        middle[v] = [_number(wanted[v, k][0]) for k in ((t + 1) // 2, (t + 2) // 2)]
    return {v: (m[0] + m[1]) / 2 if m else None for v, m in middle.items()}


def exact_median(df: DataFrame, value: str, weight: str | None = None) -> DataFrame:
    """One row, column ``median``: the exact median of ``df[value]``; null without values."""
    return df.sparkSession.createDataFrame([(exact_medians(df, [value], weight)[value],)], "median double")


def grouped_median(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``keys``, ``median`` and ``n`` (values) of each group; null and 0 for a group without values.

    Equal values are counted before they are shuffled. A group's distinct values then
    come by in order with running counts, in a sort that spills, so that no buffer
    holds a group.
    """
    counts = df.groupBy(*keys, F.col(value).alias("__v")).agg(F.count(value).alias("__n"))
    ordered = W.partitionBy(*keys).orderBy("__v")
    upto = F.sum("__n").over(ordered.rowsBetween(W.unboundedPreceding, W.currentRow))
    total = F.sum("__n").over(W.partitionBy(*keys))
    ranked = counts.withColumns({"__upto": upto, "__total": total})
    # The middle ranks are the first whose running count reaches them.
    low, high = F.floor((F.col("__total") + 1) / 2), F.floor((F.col("__total") + 2) / 2)
    known = F.col("__v").isNotNull()
    return ranked.groupBy(*keys).agg(
        (
            (
                F.min(F.when(known & (F.col("__upto") >= low), F.col("__v")))
                + F.min(F.when(known & (F.col("__upto") >= high), F.col("__v")))
            )
            / 2
        ).alias("median"),
        F.max("__total").alias("n"),
    )
