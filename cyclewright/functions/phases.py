"""Cycle phases as arithmetic on the cycle length."""

from __future__ import annotations


from pyspark.sql import Column
from pyspark.sql import functions as F

from cyclewright.settings import FIVE_PHASES, FOUR_PHASES, SPLIT_PHASES


def adaptive_bounds(cycle: Column, split_luteal: bool = False) -> list[tuple[str, Column, Column]]:
    """(phase, first day, last day) counted from zero.

    Only the second phase stretches with the cycle, and never below three days.
    """
    cl = cycle.cast("double")
    ovulation = F.greatest(F.lit(3.0), cl - 21) + 4
    luteal = ovulation + 3
    end = F.floor(cl - 1).cast("double")
    days = [(F.lit(0.0), F.lit(3.0)), (F.lit(4.0), ovulation - 1), (ovulation, ovulation + 2)]
    if split_luteal:
        days += [(luteal, luteal + 6), (luteal + 7, end)]
        return [(n, a, b) for n, (a, b) in zip(SPLIT_PHASES, days, strict=True)]
    days.append((luteal, end))
    return [(n, a, b) for n, (a, b) in zip(FOUR_PHASES, days, strict=True)]


def adaptive_phase(day: Column, cycle: Column, split_luteal: bool = False) -> Column:
    """Phase of a day; days before zero and past the end wrap around."""
    bounds = adaptive_bounds(cycle, split_luteal)
    wrap = F.greatest(*[end for _, _, end in bounds]) + 1
    at = F.pmod(day.cast("double"), wrap)
    return F.coalesce(*[F.when(at.between(a, b), F.lit(n)) for n, a, b in bounds])


def five_phase_bounds(cycle: Column) -> list[tuple[str, Column, Column]]:
    """Phases around day zero and the estimated mid-cycle day; days between are gaps.

    The first one starts at -3, which stands for the last three days.
    """
    cl = F.bround(cycle.cast("double"))
    mid = cl - 14
    days = [
        (F.lit(-3.0), F.lit(2.0)),
        (F.greatest(mid - 7, F.lit(3.0)), mid - 3),
        (mid - 2, mid + 1),
        (mid + 2, F.least(mid + 5, cl - 10)),
        (cl - 9, cl - 5),
    ]
    return [(n, a, b) for n, (a, b) in zip(FIVE_PHASES, days, strict=True)]


def five_phase(day_in_cycle: Column, cycle: Column) -> Column:
    """Phase of a day already reduced to the cycle; null on gap days."""
    cl = F.bround(cycle.cast("double"))
    day = day_in_cycle.cast("double")
    (wrap_name, wrap_start, wrap_end), *rest = five_phase_bounds(cycle)
    wraps = (day >= cl + wrap_start) | (day <= wrap_end)
    return F.coalesce(
        F.when(wraps, F.lit(wrap_name)),
        *[F.when(day.between(a, b), F.lit(n)) for n, a, b in rest],
    )


