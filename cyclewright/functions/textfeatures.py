"""Row-local text measures. Whole texts, linear or n log n in their length.

Measures of one token at a time are plain expressions; those that compare tokens with
each other are made in Arrow batches (``textkernel``), several at once by its struct.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cyclewright.functions.columns import SPACE, let, words
from cyclewright.functions.textkernel import text_measures
from cyclewright.settings import MATTR_WINDOW


def _count(text: Column, regex: str) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(regex))


def word_count(text: Column) -> Column:
    """White-space tokens."""
    return F.size(words(text))


def average_word_length(text: Column) -> Column:
    """Mean token length, 0 without tokens."""
    return let(
        words(text),
        lambda w: F.coalesce(
            F.try_divide(F.length(F.array_join(w, "")), F.size(w)), F.lit(0.0)
        ),
    )


def sentences(text: Column) -> Column:
    """Parts between single ``.``, ``!``, ``?`` marks that are not blank."""
    return F.filter(
        F.split(F.coalesce(text, F.lit("")), "[.!?]"), lambda s: s.rlike(f"[^{SPACE}]")
    )


def sentence_count(text: Column) -> Column:
    """Number of parts that are not blank, without building them."""
    return _count(text, rf"[^{SPACE}.!?][^.!?]*")


def words_per_sentence(text: Column) -> Column:
    """Mean tokens per sentence, 0 without sentences; marks also end a token."""
    inside = _count(text, rf"[^{SPACE}.!?]+")
    return F.coalesce(F.try_divide(inside, sentence_count(text)), F.lit(0.0))


def unique_word_fraction(text: Column) -> Column:
    """Distinct lower-cased tokens over all tokens, 0 without tokens."""
    return text_measures(text, "unique_word_fraction")["unique_word_fraction"]


def reading_grade(text: Column) -> Column:
    """Published Flesch-Kincaid formula with vowel groups as syllables, at least one a word.

    0 without words or sentences.
    """
    return text_measures(text, "reading_grade")["reading_grade"]


def moving_type_token_ratio(text: Column, window: int = MATTR_WINDOW) -> Column:
    """Mean share of distinct tokens over all windows; shorter texts are one window.

    Letters and digits make a token, in lower case; null without tokens. Linear in
    the tokens after one sort, whatever the window.
    """
    return text_measures(text, "mattr", window=window)["mattr"]


def neighbour_overlap(text: Column) -> Column:
    """Mean Jaccard overlap of the token sets of neighbouring sentences.

    Null with fewer than two sentences.
    """
    return text_measures(text, "cohesion")["cohesion"]
