import datetime as dt
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cyclewright.functions import daynumbers, matching, textkernel
from cyclewright.functions import textfeatures as tf
from cyclewright.operators import clean, textmetrics
from cyclewright.operators import matching as ops
from cyclewright.plans.jobs import anchor_users
from cyclewright.settings import ANCHOR_PATTERNS

UTC = dt.timezone.utc


def one(spark, text, *cols):
    df = spark.createDataFrame([(text,)], "text string")
    row = df.select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()
    return row[0] if len(cols) == 1 else tuple(row)


def python_sentence(text, pattern):
    """Row-by-row statement of the sentence rule."""
    m = re.search(pattern, text, re.IGNORECASE)
    if not m:
        return None
    marks = [i for i, ch in enumerate(text[: m.start()]) if ch in ".!?\n"]
    start = marks[-1] + 1 if marks else 0
    after = [i for i in range(m.start(), len(text)) if text[i] in ".!?\n"]
    end = after[0] + 1 if after else len(text)
    return text[start:end].strip()


SENTENCES = [
    "Hi there!!! I got my period today. Bye",
    "I got my period today",
    "wow\n\nI got my PERIOD today\nnext line",
    "no mark before got my period today",
    "first. second? got my period today!!! third",
    "emoji \U0001f600\U0001f600. then \U0001f600 got my period today \U0001f600! end",
    "nothing here",
    "",
]


@pytest.mark.parametrize("text", SENTENCES)
def test_sentence_around(spark, text):
    pattern = r"got my period (today|yesterday)"
    got = one(spark, text, matching.sentence_around(F.col("text"), pattern))
    assert got == python_sentence(text, pattern)


def test_first_pattern_in_list_order_wins(spark):
    text = "just got my period. Before that i got my period last night"
    df = spark.createDataFrame([(text,), ("nothing",), (None,)], "text string")
    rows = ops.match_patterns(df).collect()
    assert rows[0]["regex_type"] == "pattern_1"
    assert rows[0]["matched_phrase"] == "got my period last night"
    assert rows[0]["matched_sentence"] == "Before that i got my period last night"
    assert [r["regex_type"] for r in rows[1:]] == [None, None]


@pytest.mark.parametrize(
    ("sentence", "phrase", "expected"),
    [
        ("I think I just got it", "just got it", True),
        ("maybe one two just got it", "just got it", True),
        ("maybe one two three just got it", "just got it", False),
        ("really? just got it", "just got it", True),
        ("just got it", "just got it", False),
        ("I am NOT  sure just GOT it", "just got it", True),
        ("absent", "just got it", False),
        (None, "just got it", False),
        ("I should've just got it", "just got it", True),
    ],
)
def test_hedged(spark, sentence, phrase, expected):
    df = spark.createDataFrame([(sentence, phrase)], "s string, p string")
    assert df.select(matching.hedged(F.col("s"), F.col("p"))).first()[0] is expected


@pytest.mark.parametrize(
    ("phrase", "expected"),
    [
        ("got my period a couple of days ago", 1),
        ("Yesterday", 1),
        ("last night", 1),
        ("this morning", 0),
        ("TODAY", 0),
        ("tomorrow", None),
    ],
)
def test_marker_offset(spark, phrase, expected):
    assert one(spark, phrase, daynumbers.marker_offset(F.col("text"))) == expected


def test_explicit_day(spark):
    assert one(spark, "I'm on Day 5 of my period", daynumbers.explicit_day_offset(F.col("text"))) == 4
    assert one(spark, "no number", daynumbers.explicit_day_offset(F.col("text"))) is None


@pytest.mark.parametrize(
    ("sentence", "posted", "days"),
    [
        ("my period on March 5th was late", dt.datetime(2024, 3, 9, 1), 4),
        ("my period on December 25", dt.datetime(2024, 1, 4, 1), 10),
        ("my period on February 30", dt.datetime(2024, 3, 4), None),
        ("my period on March 123", dt.datetime(2024, 4, 4), None),
        ("my period on March 20", dt.datetime(2024, 3, 4), None),
        ("my period on one two March 3", dt.datetime(2024, 3, 4), None),
        ("my period on march, 3", dt.datetime(2024, 3, 4), 1),
        ("my period on March the 3", dt.datetime(2024, 3, 4), None),
    ],
)
def test_stated_date(spark, sentence, posted, days):
    df = spark.createDataFrame([(sentence, posted.replace(tzinfo=UTC))], "s string, t timestamp")
    got = df.select(daynumbers.stated_date_offset(F.col("s"), F.lit("my period on"), F.col("t")))
    assert got.first()[0] == days


def test_date_without_post_time_is_of_a_leap_year(spark):
    df = spark.createDataFrame([("born february 29th", None)], "s string, t timestamp")
    assert df.select(daynumbers.date_in_sentence(F.col("s"), F.col("t"))).first()[0] == dt.date(2000, 2, 29)


@pytest.mark.parametrize(
    ("phrase", "sentence", "days"),
    [("8 DPO", "8 DPO and CD 22", 21), ("DPO: 9", "DPO: 9 here", 22), ("dpo", "none", None)],
)
def test_cycle_day_beats_dpo(spark, phrase, sentence, days):
    df = spark.createDataFrame([(phrase, sentence)], "p string, s string")
    assert df.select(daynumbers.numbered_offset(F.col("p"), F.col("s"))).first()[0] == days


def test_anchor_users_takes_newest_sure_anchor_and_prefers_cycle_days(spark):
    def post(i, author, text, day):
        return (str(i), author, 1704067200.0 + day * 86400, "title", text)

    rows = [
        post(1, "a", "I got my period today.", 1),
        post(2, "a", "I got my period yesterday.", 5),
        post(3, "a", "maybe I got my period today.", 9),
        post(4, "a", "now 8 DPO", 20),
        post(5, "b", "now 8 DPO", 3),
        post(6, "c", "lmp was on January 2", 3),
        post(7, "[deleted]", "I got my period today.", 3),
        post(8, "d", "I got my period today.", 2),
        post(9, "d", "just got my period", 2),
    ]
    raw = spark.createDataFrame(
        rows, "id string, author string, created_utc double, title string, selftext string"
    )
    cycle_day, past_ovulation = anchor_users({"one": raw})
    got = {r["user"]: (r["offset_from_cd1"], r["pattern_category"], r["timestep"].day) for r in cycle_day.collect()}
    assert got == {"a": (1, "pattern_1", 6), "d": (0, "pattern_2", 3)}
    dpo = past_ovulation.collect()
    assert [(r["user"], r["offset_from_cd1"], r["dpo_days"]) for r in dpo] == [("b", 21, 8)]


def test_match_columns_do_not_repeat_the_regexes(spark):
    """Filters on match columns stay above the generated match."""
    df = spark.range(1).select(F.lit("x").alias("text"), F.current_timestamp().alias("ts_utc"))
    plan = (
        ops.anchor_candidates(df, "s")
        .where(~F.col("has_uncertainty") & F.col("offset_from_cd1").isNotNull())
        ._jdf.queryExecution()
        .optimizedPlan()
        .toString()
    )
    assert plan.count("just got my period") <= 4


def test_cleaning(spark):
    rows = [
        ("[deleted]", "t", "b"),
        (None, "t", "b"),
        ("a", None, None),
        ("a", " t ", "[removed]"),
        ("a", "\tt", "b\n "),
    ]
    df = spark.createDataFrame(rows, "author string, title string, selftext string")
    out = (
        clean.drop_deleted_authors(df)
        .transform(clean.blank_removed_bodies)
        .transform(clean.join_title_and_body)
    )
    assert [r["text"] for r in out.collect()] == ["t b", "", "t", "t b"]


def test_text_length_limit_is_inclusive(spark):
    df = spark.createDataFrame([("x" * 149,), ("x" * 150,), ("\U0001f600" * 150,)], "text string")
    assert clean.min_text_length(df).count() == 2


def test_epochs(spark):
    df = spark.createDataFrame([("1700000000",), ("bad",), ("NaN",), (None,)], "created_utc string")
    got = [r["ts_date"] for r in clean.add_timestamps(df, date_string=True).collect()]
    assert got == ["2023-11-14", None, None, None]
    with pytest.raises(KeyError):
        clean.add_timestamps(df, "absent")


def test_moderators(spark):
    df = spark.createDataFrame(
        [("Mod", None), ("model", None), (None, "moderator"), (None, None), ("x[m]y", None)],
        "author_flair_text string, distinguished string",
    )
    assert [r["is_moderator"] for r in clean.flag_moderators(df).collect()] == [
        True,
        False,
        True,
        False,
        True,
    ]
    assert clean.flag_moderators(df.select(F.lit(1).alias("x"))).first()["is_moderator"] is False


def python_mattr(text, window=50):
    tokens = [t for t in re.split(r"[^\w]+|_", text.lower()) if t]
    if not tokens:
        return None
    w = min(window, len(tokens))
    spans = [tokens[i : i + w] for i in range(len(tokens) - w + 1)]
    return sum(len(set(s)) / w for s in spans) / len(spans)


@pytest.mark.parametrize("n", [0, 1, 3, 49, 50, 51, 400])
def test_mattr_is_the_mean_over_windows(spark, n):
    text = " ".join(f"w{(i * i) % 17}" for i in range(n))
    got = one(spark, text, tf.moving_type_token_ratio(F.col("text")))
    want = python_mattr(text)
    assert got is None if want is None else got == pytest.approx(want)


def test_basic_measures(spark):
    text = "One two. Three\tfour five!  \n Two?? end"
    got = one(
        spark,
        text,
        tf.word_count(F.col("text")),
        tf.average_word_length(F.col("text")),
        tf.words_per_sentence(F.col("text")),
        tf.unique_word_fraction(F.col("text")),
        tf.sentence_count(F.col("text")),
    )
    tokens = text.split()
    parts = [p for p in re.split(r"[.!?]", text) if p.strip()]
    assert got[0] == len(tokens)
    assert got[1] == pytest.approx(sum(map(len, tokens)) / len(tokens))
    assert got[2] == pytest.approx(sum(len(p.split()) for p in parts) / len(parts))
    assert got[3] == pytest.approx(len({t.lower() for t in tokens}) / len(tokens))
    assert got[4] == len(parts)


@pytest.mark.parametrize("text", [None, "", "  \n"])
def test_blank_texts_score_zero(spark, text):
    got = one(
        spark,
        text,
        tf.word_count(F.col("text")),
        tf.average_word_length(F.col("text")),
        tf.words_per_sentence(F.col("text")),
        tf.unique_word_fraction(F.col("text")),
        tf.reading_grade(F.col("text")),
    )
    assert got == (0, 0.0, 0.0, 0.0, 0.0)


def test_neighbour_overlap(spark):
    assert one(spark, "a b. b c. c d!", tf.neighbour_overlap(F.col("text"))) == pytest.approx(1 / 3)
    assert one(spark, "only one sentence.", tf.neighbour_overlap(F.col("text"))) is None


def test_word_table_measures(spark, no_broadcast):
    docs = spark.createDataFrame(
        [(1, "good bad odd odd"), (2, ""), (3, None), (4, "good and good. ok and")], "id int, text string"
    )
    known = spark.createDataFrame([("good",), ("BAD",), ("and",), ("ok",)], "word string")
    shares = {r["id"]: r["unknown_word_share"] for r in textmetrics.unknown_word_share(docs, known, "id").collect()}
    assert shares == {1: 0.25, 2: 0.0, 3: 0.0, 4: 0.2}
    lexicon = spark.createDataFrame(
        [("good", 2.0, 0.5), ("bad", -1.0, 1.0)], "word string, valence double, subjectivity double"
    )
    scores = {r["id"]: r for r in textmetrics.lexicon_scores(docs, lexicon, "id").collect()}
    assert scores[1]["positive_share"] == 0.25 and scores[1]["negative_share"] == 0.25
    assert scores[1]["compound"] == pytest.approx(1 / 4)
    assert scores[1]["polarity"] == 0.5 and scores[1]["subjectivity"] == 0.75
    assert scores[2]["compound"] == 0.0 and scores[3]["polarity"] == 0.0
    links = spark.createDataFrame([("and",)], "word string")
    rates = {
        r["id"]: r["connectives_per_sentence"]
        for r in textmetrics.connectives_per_sentence(docs, links, "id").collect()
    }
    assert rates == {1: 0.0, 2: 0.0, 3: 0.0, 4: 1.0}
    bundle = textmetrics.all_features(docs, lexicon, known, links, "id")
    assert bundle.count() == 4


def test_required_literals_stand_in_every_match():
    want = {
        r"(started|got) my period (today|last night)": [" my period "],
        r"(?:DPO\s*:?(\d{1,2})|(\d{1,2})\s*DPO)": ["dpo"],
        r"cat|catalogue": ["cat"],
        r"cat|dog": ["cat", "dog"],
        r"a?b*": [],
        r"a|x*": [],
        r"\p{L}abc": [],
        r"[a-z&&[^b]]x": [],
        r"(?:ab){0,2}c": ["c"],
    }
    assert {r: matching.required_literals(r) for r in want} == want


@pytest.mark.parametrize(
    "text",
    ["JUST GOT MY PERIOD", "ju\u017ft got my per\u0131od. x", "\u0130'M ON CD 4", "I am on day 3 of my period", "nothing", "", None],
)
def test_literals_never_hide_a_match(spark, text):
    found = one(spark, text, matching.first_match(F.col("text"), ANCHOR_PATTERNS)["name"])
    plain = F.coalesce(*[F.when(F.col("text").rlike("(?iu)" + r), F.lit(n)) for n, r in ANCHOR_PATTERNS])
    assert found == one(spark, text, plain)


def test_kernel_equals_plain_python(spark):
    rng = random.Random(3)
    letters = list("abcdeyAEI\u00c9\u00df\u03a3\u03c3\u0130123_-'.!?,;  \t\n\x1c\x1f\x85\xa0\u3000\u00bd")
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(300))) for _ in range(300)]
    texts += ["", "...", "a", "!a", " . ", None, "word " * 30_000]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    names = [n for n in textkernel.MEASURES]
    got = {r["id"]: r["m"] for r in df.select("id", textkernel.text_measures(F.col("text"), *names).alias("m")).collect()}
    for i, text in enumerate(texts):
        low = (text or "").lower()
        w, parts = low.split(), [set(p.split()) for p in re.split("[.!?]", low) if p.strip()]
        overlaps = [len(x & y) / len(x | y) for x, y in zip(parts, parts[1:], strict=False)]
        assert got[i]["word_count"] == len(w) and got[i]["sentences"] == len(parts)
        assert dict(zip(got[i]["words"], got[i]["counts"], strict=True)) == {x: w.count(x) for x in set(w)}
        assert got[i]["unique_word_fraction"] == pytest.approx(len(set(w)) / len(w) if w else 0)
        if overlaps:
            assert got[i]["cohesion"] == pytest.approx(sum(overlaps) / len(overlaps))
        else:
            assert got[i]["cohesion"] is None
        if len(low) < 1000:
            want = python_mattr(low)
            assert got[i]["mattr"] is None if want is None else got[i]["mattr"] == pytest.approx(want)


def test_word_sums_hold_few_texts_at_a_time(spark):
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(setting)
    spark.conf.set(setting, "10000")
    try:
        docs = spark.range(2500).select("id", F.concat(F.lit("and w"), F.col("id"), F.lit(" and. B")).alias("text"))
        links = spark.createDataFrame([("and",)], "word string")
        sizes = textmetrics.connectives_per_sentence(docs, links, "id")
        assert int(spark.conf.get(setting)) <= 1000
        assert sizes.groupBy("connectives_per_sentence").count().collect() == [(0.5, 2500)]
    finally:
        spark.conf.set(setting, old)


def test_slices_read_no_further_than_they_hold():
    texts = pa.array(["ab", None, "cde", "f"])
    assert list(textkernel._slices(texts, 4)) == [["ab", "", "cde"], ["f"]]
    endless = (pa.scalar("x" * 10) for _ in iter(int, 1))
    assert next(textkernel._slices(endless, 20)) == ["x" * 10] * 2
