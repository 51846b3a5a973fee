"""Text measures that need a word table, and the bundles of all text features.

A text's words are counted before anything else, so a word is one row per text and
not one per place, and all word tables are one: a single join and a single sum per
text give every measure.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cyclewright.functions.textkernel import text_measures, with_measures
from cyclewright.plans.joins import lookup_join


def word_table(
    dictionary: DataFrame | None = None,
    lexicon: DataFrame | None = None,
    connectives: DataFrame | None = None,
) -> DataFrame:
    """One row per word: known, valence, subjectivity, connective; null where a table lacks it.

    Words of the dictionary are lower-cased. ``lexicon`` has one row per word.
    """
    nothing = {"known": "boolean", "valence": "double", "subjectivity": "double", "connective": "boolean"}
    given = []
    if dictionary is not None:
        given.append((dictionary, F.lower("word"), {"known": F.lit(True)}))
    if lexicon is not None:
        scores = {c: F.col(c).cast("double") for c in ("valence", "subjectivity")}
        given.append((lexicon, F.col("word"), scores))
    if connectives is not None:
        given.append((connectives, F.col("word"), {"connective": F.lit(True)}))
    parts = [
        df.select(
            word.alias("word"),
            *[own.get(c, F.lit(None)).cast(kind).alias(c) for c, kind in nothing.items()],
        )
        for df, word, own in given
    ]
    stacked = reduce(lambda x, y: x.unionByName(y), parts)
    return stacked.groupBy("word").agg(*[F.max(c).alias(c) for c in nothing])


def _word_sums(
    df: DataFrame, table: DataFrame, key: str, text: str, local: tuple[str, ...] = ()
) -> DataFrame:
    """Sums over the words of each text, beside the measures named in ``local``.

    A text's distinct words and their numbers come with its measures from one reading.
    Every text sends one row without a word, which carries its measures, so they need
    no join back and texts without words stay. ``key`` is of one text.
    """
    texts = df.select(F.col(key).alias("__key"), F.col(text).alias("__text"))
    read = with_measures(texts, "__text", *local, "words", "counts").withColumnRenamed("__key", key)
    word = F.struct(F.lit(None).cast("string").alias("words"), F.lit(0).alias("counts"))
    pairs = F.concat(F.array(word), F.arrays_zip("words", "counts"))
    rows = read.select(key, *local, F.posexplode(pairs).alias("__place", "__pair")).select(
        key,
        F.col("__pair")["words"].alias("word"),
        F.col("__pair")["counts"].alias("n"),
        *[F.when(F.col("__place") == 0, F.col(n)).alias(n) for n in local],
    )
    joined = lookup_join(rows, table, ["word"], "left")
    n, v, s = F.col("n"), F.col("valence"), F.col("subjectivity")

    def total(c: Column, value: Column = n) -> Column:
        return F.coalesce(F.sum(F.when(c, value)), F.lit(0))

    return joined.groupBy(key).agg(
        F.sum("n").alias("n_words"),
        F.count_if(F.col("word").isNotNull() & F.col("known").isNull()).alias("unknown"),
        total(v.isNotNull()).alias("hits"),
        total(v > 0).alias("pos"),
        total(v < 0).alias("neg"),
        total(v.isNotNull(), v * n).alias("s"),
        total(s.isNotNull(), s * n).alias("subj"),
        total(F.col("connective")).alias("linking"),
        *[F.max(x).alias(x) for x in local],
    )


def _share(a: str, b: str) -> Column:
    return F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))


def _lexicon_columns() -> list[Column]:
    """compound = s / sqrt(s^2 + 15) with s the sum of valences (Hutto and Gilbert 2014)."""
    s = F.col("s").cast("double")
    return [
        _share("pos", "n_words").alias("positive_share"),
        _share("neg", "n_words").alias("negative_share"),
        (s / F.sqrt(s * s + 15)).alias("compound"),
        _share("s", "hits").alias("polarity"),
        _share("subj", "hits").alias("subjectivity"),
        F.abs(_share("s", "hits")).alias("polarity_strength"),
    ]


def unknown_word_share(
    df: DataFrame, dictionary: DataFrame, key: str, text: str = "text"
) -> DataFrame:
    """Distinct words not in the dictionary over all words of the text, 0 for empty texts."""
    sums = _word_sums(df, word_table(dictionary=dictionary), key, text)
    return sums.select(key, _share("unknown", "n_words").alias("unknown_word_share"))


def lexicon_scores(
    df: DataFrame, lexicon: DataFrame, key: str, text: str = "text"
) -> DataFrame:
    """Positive and negative share, compound, polarity and subjectivity from a word table.

    ``lexicon`` has word, valence and subjectivity, one row per word. Polarity and
    subjectivity are means over the words found; texts without any score 0.
    """
    sums = _word_sums(df, word_table(lexicon=lexicon), key, text)
    return sums.select(key, *_lexicon_columns())


def connectives_per_sentence(
    df: DataFrame, connectives: DataFrame, key: str, text: str = "text"
) -> DataFrame:
    """Connective words over sentences, 0 without a sentence."""
    sums = _word_sums(df, word_table(connectives=connectives), key, text, ("sentences",))
    return sums.select(key, _share("linking", "sentences").alias("connectives_per_sentence"))


#: Measures of the basic bundle.
BASIC = (
    "word_count",
    "avg_word_length",
    "avg_words_per_sentence",
    "unique_word_fraction",
    "reading_grade",
)


def basic_features(df: DataFrame, text: str = "text") -> DataFrame:
    """Counts, lengths, diversity and reading grade from one reading of the text."""
    read = df.withColumn("__m", text_measures(F.col(text), *BASIC))
    kept = [c for c in df.columns if c not in BASIC]
    return read.select(*kept, *[F.col("__m")[n].alias(n) for n in BASIC])


def advanced_features(
    df: DataFrame, dictionary: DataFrame, key: str, text: str = "text"
) -> DataFrame:
    """Key, moving type-token ratio and share of unknown words."""
    sums = _word_sums(df, word_table(dictionary=dictionary), key, text, ("mattr",))
    return sums.select(key, "mattr", _share("unknown", "n_words").alias("unknown_word_share"))


def all_features(
    df: DataFrame,
    lexicon: DataFrame,
    dictionary: DataFrame,
    connectives: DataFrame,
    key: str,
    text: str = "text",
) -> DataFrame:
    """Key and every text feature, one row per text, from one reading of the texts."""
    local = (*BASIC, "cohesion", "mattr", "sentences")
    sums = _word_sums(df, word_table(dictionary, lexicon, connectives), key, text, local)
    return sums.select(
        key,
        *BASIC,
        "cohesion",
        "mattr",
        _share("unknown", "n_words").alias("unknown_word_share"),
        *_lexicon_columns(),
        _share("linking", "sentences").alias("connectives_per_sentence"),
    )
