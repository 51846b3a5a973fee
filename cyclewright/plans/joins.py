"""Equi joins that stay balanced when one key holds a large part of the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lookup_join(
    facts: DataFrame, lookup: DataFrame, on: list[str], how: str = "inner", by_layout: bool = False
) -> DataFrame:
    """Join a large fact table to a table with one row per key.

    The lookup stays as it is and there is no broadcast hint: Spark broadcasts it
    when its estimate, or the size AQE measures, is under
    ``spark.sql.autoBroadcastJoinThreshold`` and shuffles otherwise. The keys are
    compared as one struct, so neither side's earlier partitioning serves the join
    and each gets an exchange of its own, and so does a following ``groupBy`` on the
    key. That is what AQE needs to split the partition of a hot key into several
    tasks, each with a copy of the few lookup rows it needs.

    ``by_layout`` is for facts that are stored in buckets by the keys: they are compared
    as they are, so that the facts stay where they are and only the lookup moves.
    """
    if how not in {"inner", "left", "left_semi", "left_anti"}:
        raise ValueError(f"lookup_join keeps fact rows only: {how}")
    key, other = "__key", "__lookup_key"
    types = {f.name: f.dataType for f in facts.schema.fields}
    own = F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(on)])
    theirs = F.struct(*[F.col(c).cast(types[c]).alias(f"k{i}") for i, c in enumerate(on)])
    added = [] if how in {"left_semi", "left_anti"} else [c for c in lookup.columns if c not in on]
    if by_layout:
        renamed = lookup.select(
            *[F.col(c).cast(types[c]).alias(f"{other}{i}") for i, c in enumerate(on)], *added
        )
        same = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"{other}{i}") for i, c in enumerate(on)])
        return facts.join(renamed, same, how).select(*facts.columns, *added)
    # Structs of nulls are equal, unlike nulls.
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in on])
    left = facts.withColumn(key, own)
    right = lookup.where(known).select(
        theirs.alias(other), *[c for c in lookup.columns if c not in on]
    )
    return left.join(right, F.col(key) == F.col(other), how).select(*facts.columns, *added)
