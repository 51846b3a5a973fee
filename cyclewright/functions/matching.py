"""Regex catalogue matching, sentence cutting and hedge detection on text columns.

Patterns are ordered ``(name, regex)`` pairs in Java syntax, tried ignoring
case. Everything stays a native expression.
"""

from __future__ import annotations

import re
from functools import reduce
from re import _parser as parser

from pyspark.sql import Column
from pyspark.sql import functions as F

from cyclewright.functions.columns import SPACE, let, strip, words
from cyclewright.settings import HEDGE_PATTERNS, HEDGE_WINDOW_WORDS

IGNORE_CASE = "(?iu)"


def matched_phrase(text: Column, regex: str) -> Column:
    """Whole text of the first match, null without one."""
    return F.regexp_substr(text, F.lit(IGNORE_CASE + regex))


def sentence_around(text: Column, regex: str) -> Column:
    """Sentence holding the first match; null without one."""
    return F.when(text.rlike(IGNORE_CASE + regex), _sentence_of_match(text, regex))


def _sentence_of_match(text: Column, regex: str) -> Column:
    """Sentence of a text that is known to match.

    It starts after the last ``.``, ``!``, ``?`` or newline before the match
    and ends with the first one at or after the start of the match.
    """
    # The text before the match is taken by splitting and not by position, because
    # Spark's match positions count UTF-16 units and substrings code points.
    before = F.get(F.split(text, IGNORE_CASE + regex, 2), F.lit(0))

    def cut(prefix: Column) -> Column:
        head = F.substring_index(F.translate(prefix, "!?\n", "..."), ".", -1)
        rest = F.substring(text, F.length(prefix) + 1, F.length(text))
        return strip(F.concat(head, F.regexp_substr(rest, F.lit(r"^[^.!?\n]*[.!?\n]?"))))

    return let(before, cut)


def folded(text: Column) -> Column:
    """Lower case in which every letter that a caseless regex takes for an ASCII one is that letter."""
    return F.lower(F.translate(text, "\u017f\u0131\u0130\u212a", "siik"))


def required_literals(regex: str) -> list[str]:
    """Lower-case ASCII strings of which every match holds one at least; empty where none are sure.

    Of the parts of a sequence the one with the longest strings is taken; an alternative
    needs a string in each branch, and only what stands at least once counts.
    """

    def best(found: list[list[str]]) -> list[str]:
        return max(found, key=lambda strings: min(map(len, strings)), default=[])

    def of(parts) -> list[str]:
        found, run = [], ""
        for kind, value in [*parts, (None, None)]:
            if kind is parser.LITERAL and value < 128:
                run += chr(value).lower()
                continue
            if run:
                found.append([run])
                run = ""
            inner = []
            if kind is parser.SUBPATTERN and not value[2]:
                inner = of(value[3])
            elif kind in (parser.MAX_REPEAT, parser.MIN_REPEAT) and value[0] > 0:
                inner = of(value[2])
            elif kind is parser.BRANCH:
                branches = [of(b) for b in value[1]]
                inner = sorted({s for b in branches for s in b}) if all(branches) else []
            if inner:
                found.append(inner)
        return best(found)

    if "&&" in regex or "[[" in regex:  # nested classes of Java, which Python would read as literals
        return []
    try:
        return of(parser.parse(regex))
    except re.error:  # Java syntax that Python lacks
        return []


def first_match(text: Column, patterns: list[tuple[str, str]], low: Column | None = None) -> Column:
    """Struct (name, phrase, sentence) of the first catalogue entry that matches anywhere.

    A regex only runs on texts that hold one of its required literals; ``low`` is the
    ``folded`` text, from a column of its own where it shall be made once.
    """
    low = folded(text) if low is None else low

    def matches(regex: str) -> Column:
        literals = [low.contains(s) for s in required_literals(regex)]
        found = text.rlike(IGNORE_CASE + regex)
        return reduce(lambda x, y: x | y, literals) & found if literals else found

    branches = [
        F.when(
            matches(regex),
            F.struct(
                F.lit(name).alias("name"),
                matched_phrase(text, regex).alias("phrase"),
                _sentence_of_match(text, regex).alias("sentence"),
            ),
        )
        for name, regex in patterns
    ]
    return F.coalesce(*branches)


def normalised_phrase(phrase: Column) -> Column:
    """Trimmed, single-spaced, lower case; blank becomes null."""
    return F.nullif(F.lower(F.regexp_replace(strip(phrase), rf"[{SPACE}]+", " ")), F.lit(""))


def hedged(sentence: Column, phrase: Column, window_words: int = HEDGE_WINDOW_WORDS) -> Column:
    """True when hedge wording or a question mark stands right before the phrase."""
    at = F.instr(F.lower(sentence), F.lower(phrase))

    def judge(tokens: Column) -> Column:
        start = F.greatest(F.lit(1), F.size(tokens) - (window_words - 1))
        tail = F.lower(F.concat_ws(" ", F.slice(tokens, start, window_words)))
        return let(
            tail,
            lambda t: (t != "") & (t.rlike("|".join(HEDGE_PATTERNS)) | t.endswith("?")),
        )

    prefix = F.substring(sentence, F.lit(1), F.greatest(at - 1, F.lit(0)))
    return F.coalesce((at > 1) & let(words(prefix), judge), F.lit(False))


def ordered_contains(text: Column, markers: list[tuple[str, int]]) -> Column:
    """Value of the first marker contained in the lower-cased text."""
    low = F.lower(text)
    return reduce(
        lambda acc, m: acc.when(low.contains(m[0]), F.lit(m[1])),
        markers[1:],
        F.when(low.contains(markers[0][0]), F.lit(markers[0][1])),
    )
