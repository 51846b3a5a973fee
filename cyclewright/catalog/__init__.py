"""Runnable queries over the given tables, each with its SQL twin where one exists."""

from cyclewright.catalog import anchoring, cohorting, cycles, files, phasing, texts
from cyclewright.catalog.base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "anchoring", "cohorting", "cycles", "files", "phasing", "texts"]
