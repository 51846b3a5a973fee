"""Chat formatting with cumulative-snapshot collapse.

Logs often hold a conversation many times, each time a few turns longer. Turn hashes summed over the turns so far
are rolling prefix hashes: a conversation whose whole hash is a proper prefix hash of another is a snapshot of it
and goes, by an anti-join on (hash, number of turns). Of equal conversations the smallest conv_id stays. Only the
conversations that stay are rendered.

Running sums are taken inside blocks of turn numbers and then over the blocks, so that a conversation of any length
is spread over tasks; prefix hashes are made distinct before they are joined, so common first turns are one row.

Defined results: rows without conv_id or turn are left out, as they belong to no place; equal rows of one turn count
once, unequal ones follow each other by role and text; null role or text counts as empty; empty tables give no
rows. Turn numbers need not start at 0 or be dense: only their order counts. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cyclewright.llm.common import settled

#: Turn numbers of one block of running sums.
BLOCK = 256
WIDE = "decimal(38,0)"
#: Opens and closes a turn in the rendered text.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def numbered(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv_id, block, place (from 1 over the whole conversation), role, text of each distinct turn row."""
    rows = (
        turns.where("conv_id is not null and turn is not null")
        .select(
            F.col("conv_id").cast("long").alias("conv_id"),
            F.col("turn").cast("long").alias("turn"),
            F.coalesce("role", F.lit("")).alias("role"),
            F.coalesce("text", F.lit("")).alias("text"),
        )
        .distinct()
        .withColumn("block", F.floor(F.col("turn") / block).cast("long"))
    )
    inside = Window.partitionBy("conv_id", "block").orderBy("turn", "role", "text")
    rows = rows.withColumn("inner", F.row_number().over(inside))
    sizes = rows.groupBy("conv_id", "block").agg(F.count("*").alias("n"))
    return _with_start(rows, sizes, {"start": "n"}).withColumn("place", F.col("start") + F.col("inner"))


def _with_start(rows: DataFrame, sums: DataFrame, names: dict[str, str]) -> DataFrame:
    """Adds to each row the sums of the blocks before its own; a window over blocks, not over turns."""
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(
        F.col("conv_id").alias("s_conv"),
        F.col("block").alias("s_block"),
        *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(new) for new, n in names.items()],
    )
    return rows.join(starts, (F.col("conv_id") == F.col("s_conv")) & (F.col("block") == F.col("s_block"))).drop("s_conv", "s_block")


def turn_hashes() -> list[Column]:
    """Two independent 64-bit hashes of a turn at its place."""
    return [
        F.xxhash64(F.lit(1), "place", "role", "text").cast(WIDE),
        F.xxhash64("text", F.lit(2), "role", "place").cast(WIDE),
    ]


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, place, p1, p2: rolling hashes of the first `place` turns."""
    a, b = turn_hashes()
    rows = turns.select("conv_id", "block", "place", a.alias("h1"), b.alias("h2"))
    sums = rows.groupBy("conv_id", "block").agg(F.sum("h1").alias("n1"), F.sum("h2").alias("n2"))
    inside = Window.partitionBy("conv_id", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("r1", F.sum("h1").over(inside)).withColumn("r2", F.sum("h2").over(inside))
    rows = _with_start(rows, sums, {"s1": "n1", "s2": "n2"})
    return rows.select("conv_id", "place", (F.col("s1") + F.col("r1")).alias("p1"), (F.col("s2") + F.col("r2")).alias("p2"))


def maximal(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, copies of the conversations that stay. turns: of `numbered`."""
    rolling = settled(prefixes(turns))
    last = rolling.groupBy("conv_id").agg(F.max("place").alias("n_turns"))
    ends = last.withColumnRenamed("conv_id", "l_conv")
    marked = rolling.join(ends, F.col("conv_id") == F.col("l_conv"))
    whole = (
        marked.where("place = n_turns").groupBy("n_turns", "p1", "p2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("copies"))
    )
    inner = marked.where("place < n_turns").select(F.col("place").alias("i_place"), F.col("p1").alias("i1"), F.col("p2").alias("i2")).distinct()
    snapshot = (F.col("n_turns") == F.col("i_place")) & (F.col("p1") == F.col("i1")) & (F.col("p2") == F.col("i2"))
    return whole.join(inner, snapshot, "left_anti").select("conv_id", "n_turns", "copies")


def formatted(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, copies, text: one rendered conversation a row, of those that stay."""
    rows = settled(numbered(turns))
    stay = maximal(rows).select(F.col("conv_id").alias("k_conv"), "n_turns", "copies")
    line = F.concat(F.lit(OPEN), F.col("role"), F.lit("\n"), F.col("text"), F.lit(CLOSE), F.lit("\n"))
    return (
        rows.join(stay, F.col("conv_id") == F.col("k_conv"))
        .groupBy("conv_id", "n_turns", "copies")
        .agg(F.sort_array(F.collect_list(F.struct("place", line.alias("line")))).alias("lines"))
        .select("conv_id", "n_turns", "copies", F.array_join("lines.line", "").alias("text"))
    )
