"""Day offsets read from a matched phrase, its sentence and the post time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cyclewright.functions.columns import first_index_of, let, words
from cyclewright.functions.matching import ordered_contains
from cyclewright.settings import (
    CYCLE_DAY_FORM,
    DAY_MARKERS,
    DPO_FORMS,
    MONTHS,
    OVULATION_DAY,
    PATTERN_RULES,
)

STATED_DATE_WORDS = 3


def _captured_int(text: Column, regex: str) -> Column:
    """First capture group as int; null when nothing matches."""
    return F.nullif(F.regexp_extract(text, regex, 1), F.lit("")).try_cast("int")


def marker_offset(phrase: Column) -> Column:
    """Days since the event for wording such as "yesterday"."""
    return ordered_contains(phrase, DAY_MARKERS)


def explicit_day_offset(phrase: Column) -> Column:
    """"day N" counts from one, offsets from zero."""
    return _captured_int(F.lower(phrase), r"day (\d+)") - 1


def dpo_number(phrase: Column) -> Column:
    """N of "DPO N", else of "N DPO"."""
    return F.coalesce(*[_captured_int(F.lower(phrase), form) for form in DPO_FORMS])


def cycle_day_number(sentence: Column) -> Column:
    """N of "CD N"."""
    return _captured_int(F.lower(sentence), CYCLE_DAY_FORM)


def numbered_offset(
    phrase: Column, sentence: Column, ovulation_day: int = OVULATION_DAY
) -> Column:
    """Cycle day stated in the sentence, else days past ovulation in the phrase."""
    found = F.coalesce(
        cycle_day_number(sentence) - 1, F.lit(ovulation_day) + dpo_number(phrase) - 1
    )
    return F.when(phrase.isNotNull(), found)


def _dated(month: Column, day: Column, posted: Column) -> Column:
    """Month and day with the year of the post, or the year before for a later month."""
    year = F.when(posted.isNull(), F.lit(2000)).otherwise(
        F.year(posted) - F.when(month > F.month(posted), 1).otherwise(0)
    )
    text = F.format_string("%04d-%02d-%02d", year.cast("int"), month.cast("int"), day)
    return F.when((month > 0) & day.between(1, 31), F.try_to_date(text, "yyyy-MM-dd"))


def date_after_phrase(sentence: Column, phrase: Column, posted: Column) -> Column:
    """Date whose month word is among the three words after the phrase."""
    at = F.instr(F.lower(sentence), F.lower(phrase))
    after = F.substring(sentence, at + F.length(phrase), F.length(sentence))

    def read(tokens: Column) -> Column:
        tidy = F.transform(
            F.slice(tokens, 1, STATED_DATE_WORDS),
            lambda w: F.regexp_replace(F.lower(w), r"[.,!?;:]+$", ""),
        )

        def pick(t: Column) -> Column:
            def at_word(i: int) -> Column:
                month = first_index_of(MONTHS, F.get(t, F.lit(i)))
                day = _captured_int(F.get(t, F.lit(i + 1)), r"^(\d{1,2})(?!\d)")
                return F.when(month > 0, F.struct(month.alias("m"), day.alias("d")))

            return let(
                F.coalesce(*[at_word(i) for i in range(STATED_DATE_WORDS)]),
                lambda md: _dated(md["m"], md["d"], posted),
            )

        return let(tidy, pick)

    return F.when(at > 0, let(words(after), read))


def date_in_sentence(sentence: Column, posted: Column) -> Column:
    """First "<month> <day>" anywhere in the sentence."""
    form = r"\b(" + "|".join(MONTHS) + r")\s*(\d{1,2})(?:st|nd|rd|th)?\b"
    low = F.lower(sentence)
    month = first_index_of(MONTHS, F.regexp_extract(low, form, 1))
    day = F.nullif(F.regexp_extract(low, form, 2), F.lit("")).try_cast("int")
    return _dated(month, day, posted)


def stated_date_offset(sentence: Column, phrase: Column, posted: Column) -> Column:
    """Calendar days from the stated date to the post; null when it lies ahead."""
    return let(
        F.datediff(posted.cast("date"), date_after_phrase(sentence, phrase, posted)),
        lambda d: F.when(d >= 0, d),
    )


def offset_by_rule(
    name: Column,
    phrase: Column,
    sentence: Column,
    posted: Column,
    rules: dict[str, str] = PATTERN_RULES,
    ovulation_day: int = OVULATION_DAY,
) -> Column:
    """Offset from cycle day one, by the rule of the pattern that matched."""
    lmp = F.when(F.lower(phrase).contains("lmp was on"), F.lit("lmp was on")).otherwise(
        F.lit("lmp was")
    )
    by_rule = {
        "marker": marker_offset(phrase),
        "zero": F.lit(0),
        "stated_date": F.when(
            posted.isNotNull(), stated_date_offset(sentence, F.lit("my period on"), posted)
        ),
        "stated_date_lmp": F.when(
            posted.isNotNull(), stated_date_offset(sentence, lmp, posted)
        ),
        "explicit_day": explicit_day_offset(phrase),
        "numbered": numbered_offset(phrase, sentence, ovulation_day),
    }
    unknown = sorted(set(rules.values()) - set(by_rule))
    if unknown:
        raise ValueError(f"unknown day rules: {unknown}")
    out = F.lit(None).cast("int")
    for rule, value in by_rule.items():
        names = [n for n, r in rules.items() if r == rule]
        if names:
            out = F.when(name.isin(names), value).otherwise(out)
    return F.when(phrase.isNotNull(), out)
