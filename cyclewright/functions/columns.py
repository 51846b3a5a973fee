"""Small expression helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``.

    An expression named inside a higher-order function is otherwise evaluated
    again for every array element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def nan_to_null(c: Column) -> Column:
    """pandas has one missing value; Spark keeps NaN and null apart."""
    return F.when(~F.isnan(c), c)


# White space as text functions understand it: ASCII, control separators, Unicode.
SPACE = r"\s\x1c-\x1f\x85\p{Z}"


def strip(c: Column) -> Column:
    """Trim every kind of white space, not spaces only."""
    return F.regexp_replace(c, rf"^[{SPACE}]+|[{SPACE}]+\z", "")


def words(c: Column) -> Column:
    """White-space tokens; null gives an empty array."""
    return F.array_remove(F.split(F.coalesce(c, F.lit("")), rf"[{SPACE}]+"), "")


def sorted_median(ordered: Column) -> Column:
    """Median of an ascending array of doubles; null when empty."""
    return let(
        ordered,
        lambda a: let(
            F.size(a),
            lambda m: F.when(
                m > 0,
                (
                    F.get(a, F.floor((m - 1) / 2).cast("int"))
                    + F.get(a, F.floor(m / 2).cast("int"))
                )
                / 2,
            ),
        ),
    )


def first_index_of(items: list[str], c: Column) -> Column:
    """1-based position of ``c`` in a fixed list, 0 when absent."""
    return F.array_position(F.array(*[F.lit(i) for i in items]), c)
