"""Anchor candidates: catalogue matching and the columns derived from a match."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cyclewright.functions.daynumbers import dpo_number, offset_by_rule
from cyclewright.functions.matching import first_match, folded, hedged, normalised_phrase
from cyclewright.settings import ANCHOR_PATTERNS, DPO_PATTERNS, OVULATION_DAY, PATTERN_RULES


def match_patterns(
    df: DataFrame, patterns: list[tuple[str, str]] = ANCHOR_PATTERNS, text: str = "text"
) -> DataFrame:
    """Adds regex_type, matched_phrase and matched_sentence.

    The match is a generated row: a filter on its columns, or on columns made
    from them, then stays above it instead of running the regexes once more for
    each mention.
    """
    read = df.withColumn("__low", folded(F.col(text)))
    found = first_match(F.col(text), patterns, F.col("__low"))
    return read.select(*df.columns, F.explode_outer(F.array(found)).alias("__m")).select(
        *df.columns,
        F.col("__m.name").alias("regex_type"),
        F.col("__m.phrase").alias("matched_phrase"),
        F.col("__m.sentence").alias("matched_sentence"),
    )


def add_normalised_phrase(df: DataFrame) -> DataFrame:
    return df.withColumn("matched_phrase_norm", normalised_phrase(F.col("matched_phrase")))


def add_hedge_flag(df: DataFrame) -> DataFrame:
    return df.withColumn(
        "has_uncertainty", hedged(F.col("matched_sentence"), F.col("matched_phrase"))
    )


def add_offsets_by_pattern(
    df: DataFrame,
    posted: str = "ts_utc",
    rules: dict[str, str] = PATTERN_RULES,
    ovulation_day: int = OVULATION_DAY,
) -> DataFrame:
    """Adds offset_from_cd1 and, for the days-past-ovulation patterns, dpo_days."""
    name, phrase = F.col("regex_type"), F.col("matched_phrase")
    return df.withColumns(
        {
            "offset_from_cd1": offset_by_rule(
                name, phrase, F.col("matched_sentence"), F.col(posted), rules, ovulation_day
            ),
            "dpo_days": F.when(name.isin(DPO_PATTERNS), dpo_number(phrase)),
        }
    )


def anchor_candidates(
    posts: DataFrame,
    source: str,
    patterns: list[tuple[str, str]] = ANCHOR_PATTERNS,
    ovulation_day: int = OVULATION_DAY,
) -> DataFrame:
    """All match columns in one projection chain, tagged with the source they came from."""
    return (
        match_patterns(posts, patterns)
        .transform(add_normalised_phrase)
        .transform(add_hedge_flag)
        .transform(add_offsets_by_pattern, ovulation_day=ovulation_day)
        .withColumn("source_cut", F.lit(source))
    )
