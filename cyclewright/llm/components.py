"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cyclewright.llm.common import settled


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("node", "root").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """node, root: the smallest node that each linked node reaches; unlinked nodes and roots are left out.

    links: columns a and b of one orderable type. Rounds grow with the logarithm of the longest path; each
    is two aggregates and joins, kept by a checkpoint. Empty links give no rows.
    """
    edges = settled(
        links.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root")).where("node > root").distinct()
    )
    mark = _mark(edges)
    while mark[0]:
        both = edges.select("node", F.col("root").alias("near")).union(edges.select(F.col("root").alias("node"), F.col("node").alias("near")))
        least = both.groupBy("node").agg(F.min("near").alias("least")).select(F.col("node").alias("of"), F.least("node", "least").alias("least"))
        large = (
            both.join(least, F.col("node") == F.col("of"))
            .where("near > node")
            .select(F.col("near").alias("node"), F.col("least").alias("root"))
            .distinct()
        )
        least = large.groupBy("node").agg(F.min("root").alias("least")).select(F.col("node").alias("of"), "least")
        small = large.join(least, F.col("node") == F.col("of")).where("root <> least").select(F.col("root").alias("node"), F.col("least").alias("root"))
        edges = settled(small.union(least.select(F.col("of").alias("node"), F.col("least").alias("root"))).distinct())
        if (now := _mark(edges)) == mark:
            break
        mark = now
    return edges
