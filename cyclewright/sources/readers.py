"""Post, comment and user tables from CSV, Parquet and ``row_id:{json}`` text."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cyclewright.functions.columns import strip
from cyclewright.operators.clean import keep_categories
from cyclewright.plans.joins import lookup_join
from cyclewright.settings import MIN_TEXT_CHARS
from cyclewright.sources.csvsplit import read_split_csv

RAW_SCHEMA = T.StructType(
    [
        T.StructField("author", T.StringType()),
        T.StructField("created_utc", T.DoubleType()),
        T.StructField("subreddit", T.StringType()),
        T.StructField("id", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("selftext", T.StringType()),
        T.StructField("body", T.StringType()),
    ]
)
NESTED = (T.StructType, T.ArrayType, T.MapType)
BOM = "﻿"


def read_csv(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType | None = None,
    encoding: str = "UTF-8",
    split: bool = True,
) -> DataFrame:
    """CSV with a header, quoted newlines and doubled quotes; a leading BOM is dropped.

    A large file is read by many tasks (``csvsplit``). ``split=False`` reads a file in
    one task, which allows quotes inside fields that are not quoted.
    """
    if split and not encoding.upper().startswith(("UTF-16", "UTF-32")):
        df = read_split_csv(spark, path, schema, encoding)
    else:
        reader = spark.read.options(
            header=True, multiLine=True, escape='"', encoding=encoding, enforceSchema=schema is None
        )
        df = reader.schema(schema).csv(path) if schema else reader.csv(path, inferSchema=True)
    return df.toDF(*[c.lstrip(BOM) for c in df.columns])


def read_json_lines(
    spark: SparkSession, path: str | list[str], schema: T.StructType = RAW_SCHEMA
) -> DataFrame:
    """Objects of ``row_id:{json}`` lines; blank, malformed and colon-less lines are skipped."""
    return parse_json_lines(spark.read.text(path), schema)


def parse_json_lines(
    lines: DataFrame, schema: T.StructType = RAW_SCHEMA, value: str = "value"
) -> DataFrame:
    """Cuts each line at its first colon and reads the object behind it.

    Scalar fields are read as text and cast after, so a quoted number is a number and
    a value of another kind is null; only a line that is no object is skipped. A probe
    column tells such a line from an object that merely lacks fields.
    """
    text = F.col(value)
    payload = strip(F.substring(text, F.instr(text, ":") + 1, F.length(text)))
    probe = "__bad"
    scalar = {f.name for f in schema.fields if not isinstance(f.dataType, NESTED)}
    kinds = [T.StructField(f.name, T.StringType()) if f.name in scalar else f for f in schema.fields]
    wide = T.StructType([*kinds, T.StructField(probe, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": probe}

    def field(f: T.StructField) -> Column:
        got = F.col(f"r.{f.name}")
        return (got.try_cast(f.dataType) if f.name in scalar else got).alias(f.name)

    return (
        lines.where(F.instr(text, ":") > 0)
        .select(payload.alias("p"))
        .where(F.col("p").startswith("{"))
        .select(F.from_json("p", wide, options).alias("r"))
        .where(F.col("r").isNotNull() & F.col(f"r.{probe}").isNull())
        .select(*map(field, schema.fields))
    )


def read_any(
    spark: SparkSession, path: str, schema: T.StructType | None = None, encoding: str = "UTF-8"
) -> DataFrame:
    """Reader by suffix: .csv, .parquet, or .tsv/.txt holding ``row_id:{json}``."""
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if suffix == "csv":
        return read_csv(spark, path, schema, encoding)
    if suffix == "parquet":
        return spark.read.parquet(path)
    if suffix in {"tsv", "txt"}:
        return read_json_lines(spark, path, schema or RAW_SCHEMA)
    raise ValueError(f"unsupported file type: {path}")


def read_existing(
    spark: SparkSession, paths: Iterable[str], schema: T.StructType | None = None
) -> list[DataFrame]:
    """Readers of the paths that exist and are supported, in order; error when none is left."""
    found = []
    for path in paths:
        try:
            found.append(read_any(spark, path, schema))
        except ValueError:
            continue
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    if not found:
        raise FileNotFoundError("none of the given files exists in a supported format")
    return found


def first_row_per_id(stacked: DataFrame, key: str, order: list[str]) -> DataFrame:
    """First row of each key in ``order``; null keys count as one key.

    Rows that are equal in ``order`` fall to the smallest of their other columns. A
    minimum over a struct is combined on the map side, so the null key, which may
    hold many rows, sends one row per map task.
    """
    rest = [c for c in stacked.columns if c != key]
    comparable = [c for c in rest if not isinstance(stacked.schema[c].dataType, T.MapType)]
    first = F.min_by(F.struct(*rest), F.struct(*order, *comparable)).alias("r")
    return stacked.groupBy(key).agg(first).select(key, "r.*").select(*stacked.columns)


def load_posts(
    sources: list[DataFrame],
    users: DataFrame | None = None,
    key: str = "id",
    row_order: str = "created_utc",
    author: str = "author",
) -> DataFrame:
    """Posts of the target users from all sources, one row per id; earlier sources win."""
    ranked = [df.withColumn("__source_rank", F.lit(i)) for i, df in enumerate(sources)]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), ranked)
    if users is not None:
        # An inner join with distinct users stays above the union; a semi join would be made once a source.
        wanted = users.select(F.col("user").cast("string").alias(author)).distinct()
        stacked = lookup_join(
            stacked.withColumn(author, F.col(author).cast("string")), wanted, [author]
        )
    return first_row_per_id(stacked, key, ["__source_rank", row_order]).drop("__source_rank")


def load_content(
    raw: DataFrame, users: DataFrame, kind: str, min_chars: int = MIN_TEXT_CHARS
) -> DataFrame:
    """Unified columns of the users' posts or comments that are long enough.

    The length of a post is that of title and body without the joining space,
    taken before trimming.
    """
    title, selftext, body = (
        F.coalesce(F.col(c), F.lit("")) for c in ("title", "selftext", "body")
    )
    if kind == "comment":
        size, text = F.length(body), strip(body)
    elif kind == "post":
        size = F.length(title) + F.length(selftext)
        text = strip(F.concat_ws(" ", title, selftext))
    else:
        raise ValueError(f"unknown content kind: {kind}")
    long_enough = raw.where(size >= min_chars)
    wanted = users.select(F.col("user").cast("string").alias("author"))
    kept = lookup_join(long_enough, wanted, ["author"], "left_semi")
    return kept.select(
        "author", "created_utc", text.alias("text"), "subreddit", "id", F.lit(kind).alias("source")
    )


def posts_of_users(
    spark: SparkSession, path: str, users: DataFrame, user_col: str = "author"
) -> DataFrame:
    """Posts in a file by the users of a table."""
    wanted = users.select(F.col("user").alias(user_col))
    posts = read_any(spark, path)
    return lookup_join(posts, wanted, [user_col], "left_semi")


def scan_categories(
    sources: list[DataFrame],
    categories: Iterable[str],
    category: str,
    users: DataFrame | None = None,
    author: str = "author",
) -> DataFrame:
    """Posts of the categories over all sources, optionally only of the users given."""
    kept = [keep_categories(df, categories, category) for df in sources]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), kept)
    if users is None:
        return stacked
    wanted = users.select(F.col("user").alias(author))
    return lookup_join(stacked, wanted, [author], "left_semi")


def load_users(
    snapshot: DataFrame, pattern: str | None = None, pattern_col: str = "pattern_category"
) -> DataFrame:
    """Users table, optionally of one pattern."""
    return snapshot if pattern is None else snapshot.where(F.col(pattern_col) == pattern)
