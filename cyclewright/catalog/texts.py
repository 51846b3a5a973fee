"""Queries: cleaning, catalogue matching and text features on documents.

The documents hold invented prose without dated statements, so a carrier
sentence, chosen by document number, is put before or after each whole text.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from cyclewright.catalog.base import query, r6, table
from cyclewright.functions import daynumbers, matching
from cyclewright.functions import textfeatures as tf
from cyclewright.functions.columns import words
from cyclewright.operators import anchors, clean, summaries, textmetrics
from cyclewright.operators import matching as match_ops
from cyclewright.settings import (
    ANCHOR_PATTERNS,
    CYCLE_DAY_PATTERNS,
    HEDGE_PATTERNS,
    MODERATOR_FLAIR,
    MONTHS,
)
from cyclewright.sources import readers

CARRIERS = [
    "I got my period today. ",
    "Honestly I think I got my period yesterday!",
    "ugh!!! just got my period\nand it hurts",
    "So my period on March 5th, 2024 was late.",
    "Started menstruating yesterday",
    "i'm on day 5 of my period now",
    "My period started a couple of days ago.",
    "8 DPO and waiting! CD 22 here",
    "DPO: 9, cd 23, testing soon",
    "lmp was on February 30",
    "Well,I'm on CD 12 today",
    "nothing to report here",
    "Maybe it is not so but really truly I got my period this morning",
    "just got my period. But earlier i got my period last night",
    "my period on December 25, so weird",
    "lmp was January 17!",
    "my period on may 123",
    "almost sure? just got my period",
    "so I believe my period on April the 4th",
    "not sure but got my period this evening... I guess",
    "started march 31st I suppose",
    "about day 7 \t or so, dpo 11",
]


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


N = len(CARRIERS)
CARRIER_LIST = "[" + ", ".join(_quoted(c) for c in CARRIERS) + "]"
STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
NONBLANK = r"list_filter(regexp_split_to_array({}, '\s+'), lambda w: w <> '')"

POSTED_SQL = f"""
docs as (
  select doc_id, source, lang, timestamp '2024-01-01' + to_days(cast(doc_id % 366 as integer)) as posted,
    case when (doc_id // {N}) % 2 = 0
         then list_extract({CARRIER_LIST}, doc_id % {N} + 1) || ' ' || text
         else text || ' ' || list_extract({CARRIER_LIST}, doc_id % {N} + 1) end as text
  from documents)"""


def _texts(spark, sf_dir):
    """The documents, dealt out to tasks by number: the test table is one block of one file."""
    columns = ["doc_id", "text", "lang", "source"]
    return table(spark, sf_dir, "documents").select(columns).repartition("doc_id")


def _spread(spark, sf_dir):
    return _texts(spark, sf_dir).select(F.col("doc_id").alias("id"), "text")


def _documents(spark, sf_dir):
    """Whole documents with a carrier sentence and a post time."""
    carrier = F.get(
        F.array(*[F.lit(c) for c in CARRIERS]), (F.col("doc_id") % N).cast("int")
    )
    before = F.floor(F.col("doc_id") / N) % 2 == 0
    text = F.when(before, F.concat_ws(" ", carrier, F.col("text"))).otherwise(
        F.concat_ws(" ", F.col("text"), carrier)
    )
    return _texts(spark, sf_dir).select(
        F.col("doc_id").alias("id"),
        F.col("source").alias("author"),
        "lang",
        F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") % 366 * 86400).alias("ts_utc"),
        text.alias("text"),
    )


_whens = "\n".join(f"when regexp_matches(text, {_quoted('(?i)' + p)}) then {_quoted(n)}" for n, p in ANCHOR_PATTERNS)
_phrases = "\n".join(
    f"when {_quoted(n)} then regexp_extract(text, {_quoted('(?i)' + p)})" for n, p in ANCHOR_PATTERNS
)
_prefixes = "\n".join(
    f"when {_quoted(n)} then regexp_extract(text, {_quoted('(?is)^(.*?)(?:' + p + ')')}, 1)"
    for n, p in ANCHOR_PATTERNS
)
SENTENCE = STRIP.format(
    "(string_split(translate(prefix, '!?\n', '...'), '.')[-1] || "
    "regexp_extract(substr(text, length(prefix) + 1), '^[^.!?\n]*[.!?\n]?'))"
)
MATCHED_SQL = (
    POSTED_SQL
    + f""",
named as (select *, case {_whens} end as regex_type from docs),
cut as (select *, case regex_type {_phrases} end as phrase, case regex_type {_prefixes} end as prefix
        from named),
matched as (select *, case when regex_type is not null then {SENTENCE} end as sentence from cut)"""
)

_hedge = "|".join(HEDGE_PATTERNS)
HEDGED_SQL = (
    MATCHED_SQL
    + f""",
before as (
  select *, {NONBLANK.format("substr(sentence, 1, greatest(instr(lower(sentence), lower(phrase)) - 1, 0))")} as w,
    instr(lower(sentence), lower(phrase)) as place
  from matched),
tails as (select *, lower(array_to_string(w[greatest(1, len(w) - 2):], ' ')) as tail from before),
hedged as (
  select *, coalesce(place > 1 and tail <> '' and (regexp_matches(tail, {_quoted(_hedge)}) or tail like '%?'), false)
    as has_uncertainty from tails)"""
)

MARKER_SQL = """case when lower(phrase) like '%a couple of days ago%' then 1
  when lower(phrase) like '%yesterday%' then 1 when lower(phrase) like '%last night%' then 1
  when lower(phrase) like '%this morning%' then 0 when lower(phrase) like '%this evening%' then 0
  when lower(phrase) like '%today%' then 0 end"""
_MONTH_LIST = "[" + ", ".join(_quoted(m) for m in MONTHS) + "]"


def _int(expr: str) -> str:
    return f"try_cast(nullif({expr}, '') as integer)"


def _dated_sql(month: str, day: str) -> str:
    return (
        f"case when {day} between 1 and 31 then try_cast(printf('%04d-%02d-%02d', "
        f"cast(year(posted) - case when {month} > month(posted) then 1 else 0 end as integer), "
        f"cast({month} as integer), cast({day} as integer)) as date) end"
    )


def _after_phrase_sql(phrase: str) -> str:
    """Subquery fragments: date stated in the three words after a phrase expression."""
    return f"""
  dw as (select *, instr(lower(sentence), lower({phrase})) as pat,
    list_transform(({NONBLANK.format(f"substr(sentence, instr(lower(sentence), lower({phrase})) + length({phrase}))")})[1:3],
      lambda w: regexp_replace(lower(w), '[.,!?;:]+$', '')) as t from hedged),
  dm as (select *, list_transform(t, lambda w: coalesce(list_position({_MONTH_LIST}, w), 0)) as ms from dw),
  di as (select *, case when ms[1] > 0 then 1 when ms[2] > 0 then 2 when ms[3] > 0 then 3 end as i from dm),
  dd as (select *, ms[i] as stated_month,
    {_int(r"regexp_extract(t[i + 1], '^([0-9]{1,2})(?:[^0-9]|$)', 1)")} as stated_day from di),
  stated as (select *, case when pat > 0 then {_dated_sql("stated_month", "stated_day")} end as stated_date from dd)"""


PHRASE_KEY = """(case when regex_type = 'pattern_3' then 'my period on'
  when lower(phrase) like '%lmp was on%' then 'lmp was on' else 'lmp was' end)"""
_DPO = _int(r"regexp_extract(lower(phrase), '\bdpo\s*:?\s*[-\s]*(\d{1,2})\b', 1)")
_DPO2 = _int(r"regexp_extract(lower(phrase), '\b(\d{1,2})\s*:?\s*[-\s]*dpo\b', 1)")
DPO_SQL = f"coalesce({_DPO}, {_DPO2})"
CD_SQL = _int(r"regexp_extract(lower(sentence), '\bcd\s*:?\s*(\d{1,2})\b', 1)")
_DIFF = "date_diff('day', stated_date, cast(posted as date))"
OFFSET_CASE = f"""cast(case
    when regex_type in ('pattern_1', 'pattern_4', 'pattern_6') then {MARKER_SQL}
    when regex_type = 'pattern_2' then 0
    when regex_type in ('pattern_3', 'pattern_8') then case when {_DIFF} >= 0 then {_DIFF} end
    when regex_type = 'pattern_5' then {_int("regexp_extract(lower(phrase), 'day ([0-9]+)', 1)")} - 1
    when regex_type in ('pattern_7', 'pattern_9') then coalesce({CD_SQL} - 1, 14 + {DPO_SQL} - 1)
  end as integer)"""
CANDIDATES_SQL = (
    HEDGED_SQL
    + ","
    + _after_phrase_sql(PHRASE_KEY)
    + f""",
candidates as (select *, {OFFSET_CASE} as offset_from_cd1,
  case when regex_type = 'pattern_7' then {DPO_SQL} end as dpo_days from stated)"""
)


@query("with" + MATCHED_SQL + r""" select doc_id as id, regex_type, phrase as matched_phrase,
  nullif(lower(regexp_replace(regexp_replace(phrase, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g')), '')
    as matched_phrase_norm from matched""")
def first_pattern(spark, sf_dir):
    out = match_ops.match_patterns(_documents(spark, sf_dir))
    return match_ops.add_normalised_phrase(out).select(
        "id", "regex_type", "matched_phrase", "matched_phrase_norm"
    )


@query("with" + MATCHED_SQL + " select doc_id as id, md5(sentence) as sentence_md5, length(sentence) as n_chars from matched")
def sentence_of_match(spark, sf_dir):
    out = match_ops.match_patterns(_documents(spark, sf_dir))
    return out.select(
        "id",
        F.md5("matched_sentence").alias("sentence_md5"),
        F.length("matched_sentence").cast("long").alias("n_chars"),
    )


@query("with" + POSTED_SQL + r""" select doc_id as id, nullif(regexp_extract(text, '(?i)\bday \d+'), '') as phrase from docs""")
def matched_phrase(spark, sf_dir):
    return _documents(spark, sf_dir).select(
        "id", matching.matched_phrase(F.col("text"), r"\bday \d+").alias("phrase")
    )


@query("with" + HEDGED_SQL + " select doc_id as id, regex_type, has_uncertainty from hedged")
def hedge_flag(spark, sf_dir):
    out = match_ops.add_hedge_flag(match_ops.match_patterns(_documents(spark, sf_dir)))
    return out.select("id", "regex_type", "has_uncertainty")


@query("with" + MATCHED_SQL + f" select doc_id as id, cast({MARKER_SQL} as integer) as days from matched")
def marker_offset(spark, sf_dir):
    out = match_ops.match_patterns(_documents(spark, sf_dir))
    return out.select("id", daynumbers.marker_offset(F.col("matched_phrase")).alias("days"))


@query("with" + MATCHED_SQL + f""" select doc_id as id,
  {_int("regexp_extract(lower(phrase), 'day ([0-9]+)', 1)")} - 1 as days from matched""")
def explicit_day(spark, sf_dir):
    out = match_ops.match_patterns(_documents(spark, sf_dir))
    return out.select("id", daynumbers.explicit_day_offset(F.col("matched_phrase")).alias("days"))


@query("with" + HEDGED_SQL + "," + _after_phrase_sql("'my period on'") + f"""
  select doc_id as id, strftime(stated_date, '%Y-%m-%d') as stated_date,
    cast(case when {_DIFF} >= 0 then {_DIFF} end as integer) as days from stated""")
def stated_date_offset(spark, sf_dir):
    out = match_ops.match_patterns(_documents(spark, sf_dir))
    sentence, phrase, posted = F.col("matched_sentence"), F.lit("my period on"), F.col("ts_utc")
    return out.select(
        "id",
        F.date_format(daynumbers.date_after_phrase(sentence, phrase, posted), "yyyy-MM-dd").alias(
            "stated_date"
        ),
        daynumbers.stated_date_offset(sentence, phrase, posted).alias("days"),
    )


_MONTH_FORM = r"\b(" + "|".join(MONTHS) + r")\s*(\d{1,2})(?:st|nd|rd|th)?\b"


@query("with" + POSTED_SQL + f""", m as (select *,
    list_position({_MONTH_LIST}, regexp_extract(lower(text), {_quoted(_MONTH_FORM)}, 1)) as mm,
    {_int(f"regexp_extract(lower(text), {_quoted(_MONTH_FORM)}, 2)")} as dd from docs)
  select doc_id as id, strftime({_dated_sql("mm", "dd")}, '%Y-%m-%d') as found from m""")
def date_in_sentence(spark, sf_dir):
    found = daynumbers.date_in_sentence(F.col("text"), F.col("ts_utc"))
    return _documents(spark, sf_dir).select(
        "id", F.date_format(found, "yyyy-MM-dd").alias("found")
    )


@query("with" + MATCHED_SQL + f""" select doc_id as id, {DPO_SQL} as dpo, {CD_SQL} as cd,
  case when phrase is not null then coalesce({CD_SQL} - 1, 14 + {DPO_SQL} - 1) end as days from matched""")
def day_number_priority(spark, sf_dir):
    out = match_ops.match_patterns(_documents(spark, sf_dir))
    phrase, sentence = F.col("matched_phrase"), F.col("matched_sentence")
    return out.select(
        "id",
        daynumbers.dpo_number(phrase).alias("dpo"),
        daynumbers.cycle_day_number(sentence).alias("cd"),
        daynumbers.numbered_offset(phrase, sentence).alias("days"),
    )


def _candidates(spark, sf_dir):
    return match_ops.anchor_candidates(_documents(spark, sf_dir), "documents")


@query("with" + CANDIDATES_SQL + """ select doc_id as id, regex_type, has_uncertainty, offset_from_cd1,
  dpo_days, 'documents' as source_cut from candidates""")
def anchor_candidates(spark, sf_dir):
    return _candidates(spark, sf_dir).select(
        "id", "regex_type", "has_uncertainty", "offset_from_cd1", "dpo_days", "source_cut"
    )


_CD_LIST = ", ".join(_quoted(p) for p in CYCLE_DAY_PATTERNS)


# Authors are source and language, since a source alone is in every group.
@query("with" + CANDIDATES_SQL + f""",
  usable as (select *, source || '/' || lang as author from candidates
             where not has_uncertainty and offset_from_cd1 is not null),
  newest as (select *, regex_type = 'pattern_7' as dpo,
      row_number() over (partition by author, regex_type = 'pattern_7' order by posted desc, doc_id desc) as rn
    from usable where regex_type in ({_CD_LIST}, 'pattern_7'))
  select author as "user", epoch_us(posted) as ts_us, offset_from_cd1, dpo_days,
    regex_type as pattern_category, case when dpo then 'dpo' else 'cd' end as grp
  from newest n where rn = 1 and not (dpo and exists (
    select 1 from newest o where o.author = n.author and o.rn = 1 and not o.dpo))""")
def users_table(spark, sf_dir):
    found = _candidates(spark, sf_dir).withColumn("author", F.concat_ws("/", "author", "lang"))
    cycle_day, past_ovulation = anchors.users_tables([found])
    both = cycle_day.withColumn("grp", F.lit("cd")).unionByName(
        past_ovulation.withColumn("grp", F.lit("dpo"))
    )
    return both.select(
        "user",
        F.unix_micros("timestep").alias("ts_us"),
        "offset_from_cd1",
        "dpo_days",
        "pattern_category",
        "grp",
    )


NORM = r"nullif(lower(regexp_replace(regexp_replace(phrase, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g')), '')"


@query("with" + HEDGED_SQL + f""" select {NORM} as matched_phrase_norm, count(*) as total,
    count(*) filter (has_uncertainty) as uncertain
  from hedged where phrase is not null group by 1""")
def phrase_summary(spark, sf_dir):
    return summaries.phrase_summary(_candidates(spark, sf_dir))


@query("with" + HEDGED_SQL + f""" select {NORM} as matched_phrase_norm, count(*) as total,
    count(*) filter (has_uncertainty) as uncertain
  from hedged where phrase is not null group by 1 order by 2 desc, 1 limit 5""")
def top_phrases(spark, sf_dir):
    return summaries.phrase_summary(_candidates(spark, sf_dir)).limit(5)


@query("with" + HEDGED_SQL + """ select count(*) as total, count(*) filter (has_uncertainty) as uncertain,
  round(avg(cast(has_uncertainty as integer)) * 100, 6) as pct from hedged where regex_type is not null""")
def hedge_rate(spark, sf_dir):
    found = _candidates(spark, sf_dir).where(F.col("regex_type").isNotNull())
    return summaries.hedge_rate(found).select("total", "uncertain", *r6("pct"))


@query("with" + MATCHED_SQL + """ select regex_type, count(*) as count, count(distinct source) as unique_users
  from matched where regex_type is not null group by 1""")
def pattern_counts(spark, sf_dir):
    return summaries.pattern_counts(match_ops.match_patterns(_documents(spark, sf_dir)))


# --- cleaning -----------------------------------------------------------------------------

RAW_SQL = f"""
raw as (
  select doc_id, case when doc_id % 11 = 0 then '[deleted]' when doc_id % 13 <> 0 then source end as author,
    case doc_id % 5 when 0 then null when 1 then '  ' || lang else lang end as title,
    case doc_id % 7 when 0 then '[removed]' when 1 then '[deleted]' when 2 then null
      else text || chr(10) || chr(9) end as selftext,
    case when doc_id % 48 = 0 then '1e18' when doc_id % 48 = 6 then 'Infinity' when doc_id % 6 = 0 then 'bad'
      when doc_id % 6 = 1 then cast(1700000000 + doc_id as varchar) || '.25'
      else cast(1700000000 + doc_id * 3600 as varchar) end as created_utc,
    case doc_id % 4 when 0 then 'Mod of ' || lang when 1 then 'modern' when 2 then 'x[m]y' end as flair,
    case when doc_id % 9 = 0 then 'moderator' end as distinguished
  from documents)"""


def _raw(spark, sf_dir):
    """Documents as raw posts, with each kind of defect by document number."""
    n = F.col("doc_id")
    defect = n % 7
    return _texts(spark, sf_dir).select(
        n.alias("id"),
        F.when(n % 11 == 0, F.lit("[deleted]")).when(n % 13 != 0, F.col("source")).alias("author"),
        F.when(n % 5 == 1, F.concat(F.lit("  "), "lang")).when(n % 5 != 0, F.col("lang")).alias("title"),
        F.when(defect == 0, F.lit("[removed]"))
        .when(defect == 1, F.lit("[deleted]"))
        .when(defect != 2, F.concat("text", F.lit("\n\t")))
        .alias("selftext"),
        F.when(n % 48 == 0, F.lit("1e18"))
        .when(n % 48 == 6, F.lit("Infinity"))
        .when(n % 6 == 0, F.lit("bad"))
        .when(n % 6 == 1, F.concat((n + 1700000000).cast("string"), F.lit(".25")))
        .otherwise((n * 3600 + 1700000000).cast("string"))
        .alias("created_utc"),
        F.when(n % 4 == 0, F.concat(F.lit("Mod of "), "lang"))
        .when(n % 4 == 1, F.lit("modern"))
        .when(n % 4 == 2, F.lit("x[m]y"))
        .alias("author_flair_text"),
        F.when(n % 9 == 0, F.lit("moderator")).alias("distinguished"),
    )


_JOINED = STRIP.format(
    "(coalesce(title, '') || ' ' || coalesce(case when selftext in ('[removed]', '[deleted]') then '' else selftext end, ''))"
)


@query("with" + RAW_SQL + f""", j as (select *, {_JOINED} as text from raw
    where author is distinct from '[deleted]')
  select doc_id as id, author, md5(text) as text_md5 from j where length(text) >= 150""")
def clean_text(spark, sf_dir):
    out = (
        _raw(spark, sf_dir)
        .transform(clean.drop_deleted_authors)
        .transform(clean.blank_removed_bodies)
        .transform(clean.join_title_and_body)
        .transform(clean.min_text_length, 150)
    )
    return out.select("id", "author", F.md5("text").alias("text_md5"))


@query("with" + RAW_SQL + """ select doc_id as id,
    try_cast(round(try_cast(created_utc as double) * 1000000) as bigint) as ts_us,
    strftime(make_timestamp(try_cast(round(try_cast(created_utc as double) * 1000000) as bigint)), '%Y-%m-%d') as ts_date
  from raw""")
def epoch_timestamps(spark, sf_dir):
    out = clean.add_timestamps(_raw(spark, sf_dir), date_string=True)
    return out.select("id", F.unix_micros("ts_utc").alias("ts_us"), "ts_date")


@query("with" + RAW_SQL + f""" select doc_id as id, coalesce(regexp_matches(flair, {_quoted('(?i)' + MODERATOR_FLAIR)}), false)
    or coalesce(distinguished = 'moderator', false) as is_moderator from raw""")
def moderator_flag(spark, sf_dir):
    return clean.flag_moderators(_raw(spark, sf_dir)).select("id", "is_moderator")


@query("with" + RAW_SQL + """ select doc_id as id, md5(selftext) as text_md5 from raw
  where author is distinct from '[deleted]' and selftext is not null
    and selftext not in ('', '[removed]', '[deleted]')""")
def clean_content(spark, sf_dir):
    rows = _raw(spark, sf_dir).withColumn("text", F.col("selftext"))
    return clean.clean_content(rows).select("id", F.md5("text").alias("text_md5"))


@query("with" + RAW_SQL + f""", wanted as (select source from documents where lang = 'en')
  select doc_id as id, author, 'post' as source,
    md5({STRIP.format("(coalesce(title, '') || ' ' || coalesce(selftext, ''))")}) as text_md5
  from raw where length(coalesce(title, '')) + length(coalesce(selftext, '')) >= 150
    and author in (select source from wanted)
  union all
  select doc_id, author, 'comment', md5({STRIP.format("selftext")})
  from raw where length(selftext) >= 150 and author in (select source from wanted)""")
def raw_content(spark, sf_dir):
    """Long enough posts and comments of the users of another table, in the unified columns."""
    docs = _texts(spark, sf_dir)
    users = docs.where(F.col("lang") == "en").select(F.col("source").alias("user"))
    raw = _raw(spark, sf_dir).withColumns(
        {"body": F.col("selftext"), "subreddit": F.lit(None).cast("string")}
    )
    kinds = [readers.load_content(raw, users.distinct(), kind) for kind in ("post", "comment")]
    out = kinds[0].unionByName(kinds[1])
    return out.select("id", "author", "source", F.md5("text").alias("text_md5"))


@query("""select doc_id::varchar as id, source as author, lang as subreddit,
    case when doc_id % 10 <> 7 then cast(doc_id as double) end as created_utc,
    md5(text) as body_md5 from documents where doc_id % 10 not in (3, 4, 5)""")
def json_lines(spark, sf_dir):
    """Documents as ``row_id:{json}`` lines: malformed, blank, without a colon, with a quoted
    number, with a number that is none, or with a tab after the colon."""
    n = F.col("doc_id")
    payload = F.to_json(
        F.struct(
            F.col("source").alias("author"),
            F.when(n % 10 == 7, F.lit("unknown")).otherwise(n.cast("string")).alias("created_utc"),
            F.col("lang").alias("subreddit"),
            n.cast("string").alias("id"),
            F.col("text").alias("body"),
        )
    )
    # Even documents have the number without quotes.
    plain = F.regexp_replace(payload, r'"created_utc":"(\d+)"', '"created_utc":$1')
    payload = F.when(n % 2 == 0, plain).otherwise(payload)
    line = (
        F.when(n % 10 == 3, F.concat(n, F.lit(': {"author": "cut')))
        .when(n % 10 == 4, F.lit(" "))
        .when(n % 10 == 5, F.lit("no separator"))
        .when(n % 10 == 6, F.concat(n, F.lit(":\t"), payload, F.lit("\t")))
        .otherwise(F.concat(n, F.lit(": "), payload))
    )
    lines = _texts(spark, sf_dir).select(line.alias("value"))
    return readers.parse_json_lines(lines).select(
        "id", "author", "subreddit", "created_utc", F.md5("body").alias("body_md5")
    )


# --- text features ---------------------------------------------------------------------------

WORDS_SQL = f"""
d as (select doc_id as id, text, {NONBLANK.format("text")} as w, {NONBLANK.format("lower(text)")} as lw,
  list_filter(list_transform(regexp_split_to_array(text, '[.!?]'),
    lambda s: {STRIP.format("s")}), lambda s: s <> '') as ss from documents)"""


BASIC_SQL = f"""
  basic as (select id, cast(len(w) as integer) as word_count,
    round(coalesce(list_sum(list_transform(w, lambda x: length(x))) / nullif(len(w), 0), 0), 6) as avg_word_length,
    round(coalesce(list_sum(list_transform(ss, lambda s: len({NONBLANK.format("s")}))) / nullif(len(ss), 0), 0), 6)
      as avg_words_per_sentence,
    round(coalesce(list_unique(lw) / nullif(len(lw), 0), 0), 6) as unique_word_fraction,
    round(case when len(lw) > 0 and len(ss) > 0 then 0.39 * (len(lw) / len(ss)) + 11.8 * (list_sum(list_transform(lw,
      lambda x: greatest(1, len(regexp_extract_all(x, '[aeiouy]+'))))) / len(lw)) - 15.59 else 0 end, 6) as reading_grade
  from d)"""
BASIC = ["avg_word_length", "avg_words_per_sentence", "unique_word_fraction", "reading_grade"]


@query("with" + WORDS_SQL + "," + BASIC_SQL + " select * from basic")
def basic_text(spark, sf_dir):
    docs = _spread(spark, sf_dir)
    return textmetrics.basic_features(docs).select("id", "word_count", *r6(*BASIC))


# Sliding windows as written down: every window's distinct tokens, counted and averaged.
MATTR_SQL = r"""
  mt as (select doc_id as id, unnest(w) as word, generate_subscripts(w, 1) as i, len(w) as n
    from (select doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') as w
          from documents)),
  mp as (select *, lag(i) over (partition by id, word order by i) as prev, least(n, 50) as span from mt),
  mc as (select id, n, span, greatest(0, least(i, n - span + 1) - greatest(i - span + 1, coalesce(prev, 0) + 1, 1) + 1) as k
        from mp),
  ratios as (select d.doc_id as id, round(x.mattr, 6) as mattr from documents d left join (
    select id, sum(k) / ((any_value(n) - any_value(span) + 1) * any_value(span)) as mattr from mc group by 1) x
    on x.id = d.doc_id)"""


@query("with" + MATTR_SQL + " select * from ratios")
def mattr(spark, sf_dir):
    return _spread(spark, sf_dir).select(
        "id",
        F.round(tf.moving_type_token_ratio(F.col("text")), 6).alias("mattr"),
    )


BENCH_WORDS_SQL = f"""
vocabulary as (select distinct unnest({NONBLANK.format("lower(text)")}) as word from benchmark)"""


def _vocabulary(spark, sf_dir):
    return (
        table(spark, sf_dir, "benchmark")
        .select(F.explode(words(F.lower("text"))).alias("word"))
        .distinct()
    )


UNKNOWN_SQL = """
  unknown as (select id, round(coalesce(count(*) filter (word is not null and word not in (select word from vocabulary))
      / nullif(any_value(n), 0), 0), 6) as unknown_word_share
    from (select id, len(lw) as n, unnest(case when len(lw) > 0 then list_distinct(lw) else [null] end) as word from d)
    group by 1)"""


@query("with" + WORDS_SQL + "," + BENCH_WORDS_SQL + "," + UNKNOWN_SQL + " select * from unknown")
def unknown_word_share(spark, sf_dir):
    docs = _spread(spark, sf_dir)
    return textmetrics.unknown_word_share(docs, _vocabulary(spark, sf_dir), "id").select(
        "id", *r6("unknown_word_share")
    )


# Valence and subjectivity of a word are made from its length and first letter, in halves and
# eighths: their sums are exact in any order.
LEXICON_SQL = """
lexicon as (select word, (length(word) % 7 - 3) / 2.0::double as valence,
  (ascii(word) % 8) / 8.0::double as subjectivity from vocabulary)"""


def _lexicon(spark, sf_dir):
    return _vocabulary(spark, sf_dir).select(
        "word",
        ((F.length("word") % 7 - 3) / 2.0).alias("valence"),
        ((F.ascii("word") % 8) / 8.0).alias("subjectivity"),
    )


SCORES_SQL = """
  scores0 as (select id, any_value(n) as n, count(valence) as hits, count(*) filter (valence > 0) as pos,
      count(*) filter (valence < 0) as neg, coalesce(sum(valence), 0) as s, coalesce(sum(subjectivity), 0) as subj
    from (select id, len(lw) as n, unnest(case when len(lw) > 0 then lw else [null] end) as word from d)
      left join lexicon using (word) group by 1),
  scores as (select id, round(coalesce(pos / nullif(n, 0), 0), 6) as positive_share,
      round(coalesce(neg / nullif(n, 0), 0), 6) as negative_share, round(s / sqrt(s * s + 15), 6) as compound,
      round(coalesce(s / nullif(hits, 0), 0), 6) as polarity,
      round(coalesce(subj / nullif(hits, 0), 0), 6) as subjectivity,
      abs(round(coalesce(s / nullif(hits, 0), 0), 6)) as polarity_strength from scores0)"""


@query("with" + WORDS_SQL + "," + BENCH_WORDS_SQL + "," + LEXICON_SQL + "," + SCORES_SQL + " select * from scores")
def lexicon_scores(spark, sf_dir):
    docs = _spread(spark, sf_dir)
    out = textmetrics.lexicon_scores(docs, _lexicon(spark, sf_dir), "id")
    return out.select("id", *r6(*[c for c in out.columns if c != "id"]))


CONNECTIVES = ["and", "but", "or", "because", "that", "which", "et", "und", "y", "que"]
LINKS_SQL = f"""
  links as (select id, round(coalesce(list_sum(list_transform(lw, lambda x: case when list_contains(
      [{", ".join(_quoted(c) for c in CONNECTIVES)}], x) then 1 else 0 end)) / nullif(len(ss), 0), 0), 6)
      as connectives_per_sentence from d)"""


def _connectives(spark):
    return spark.createDataFrame([(c,) for c in CONNECTIVES], "word string")


@query("with" + WORDS_SQL + "," + LINKS_SQL + " select * from links")
def connectives_per_sentence(spark, sf_dir):
    docs = _spread(spark, sf_dir)
    return textmetrics.connectives_per_sentence(docs, _connectives(spark), "id").select(
        "id", *r6("connectives_per_sentence")
    )


OVERLAP_SQL = f"""
  bags as (select id, list_transform(ss, lambda s: list_distinct({NONBLANK.format("lower(s)")})) as b from d),
  pairs as (select id, b[i] as x, b[i + 1] as y from (
    select id, b, unnest(range(1, len(b))) as i from bags)),
  overlap as (select id, avg(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y)))) as o
              from pairs group by 1),
  cohesion as (select d.id, round(o, 6) as cohesion from d left join overlap using (id))"""


@query("with" + WORDS_SQL + "," + OVERLAP_SQL + " select * from cohesion")
def sentence_overlap(spark, sf_dir):
    return _spread(spark, sf_dir).select(
        "id",
        F.round(tf.neighbour_overlap(F.col("text")), 6).alias("cohesion"),
    )


@query(
    "with"
    + ",".join(
        [WORDS_SQL, BASIC_SQL, MATTR_SQL, BENCH_WORDS_SQL, LEXICON_SQL, UNKNOWN_SQL, SCORES_SQL, LINKS_SQL, OVERLAP_SQL]
    )
    + """ select * from basic join ratios using (id) join unknown using (id) join scores using (id)
      join links using (id) join cohesion using (id)"""
)
def text_bundle(spark, sf_dir):
    """Every text feature at once."""
    docs = _spread(spark, sf_dir)
    out = textmetrics.all_features(
        docs, _lexicon(spark, sf_dir), _vocabulary(spark, sf_dir), _connectives(spark), "id"
    )
    return out.select("id", "word_count", *r6(*[c for c in out.columns if c not in ("id", "word_count")]))
