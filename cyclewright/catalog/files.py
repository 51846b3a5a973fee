"""Queries: readers and writers of files, on rows of the given tables.

Each writes whole tables to the shared folder and reads them back through a reader.
"""

from __future__ import annotations

import posixpath
import uuid

from pyspark.sql import functions as F

from cyclewright.catalog.base import OFFSETS_SQL, event_posts, event_users, query, table
from cyclewright.operators import anchors
from cyclewright.sources import readers, snapshots


def _path(spark, suffix: str) -> str:
    return posixpath.join(snapshots.shared_folder(spark), f"{uuid.uuid4().hex}{suffix}")


def _csv(spark, sf_dir, encoding: str):
    """Documents as CSV with doubled quotes and newlines inside fields."""
    path = _path(spark, ".csv")
    table(spark, sf_dir, "documents").write.options(
        header=True,
        escape='"',
        encoding=encoding,
        ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
    ).csv(path)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    empty = spark.createDataFrame([], schema)
    return readers.read_csv(spark, path, empty.schema, encoding)


DOCUMENTS_SQL = "select doc_id, md5(text) as text_md5, lang, source, n_chars from documents"


def _documents(df):
    return df.select("doc_id", F.md5("text").alias("text_md5"), "lang", "source", "n_chars")


@query(DOCUMENTS_SQL)
def csv_scan(spark, sf_dir):
    return _documents(_csv(spark, sf_dir, "UTF-8"))


@query(DOCUMENTS_SQL)
def csv_scan_latin1(spark, sf_dir):
    return _documents(_csv(spark, sf_dir, "ISO-8859-1"))


@query(DOCUMENTS_SQL)
def csv_export(spark, sf_dir):
    """The CSV sink, whose quotes are escaped by a backslash."""
    path, docs = _path(spark, ""), table(spark, sf_dir, "documents")
    snapshots.export_csv(docs, path)
    back = spark.read.schema(docs.schema).csv(path, header=True, multiLine=True, escape="\\")
    return _documents(back)


@query("""select event_id as id, event_type as subreddit, user_id as author from events
          where user_id in (select user_id from events where event_type = 'signup')""")
def posts_for_users(spark, sf_dir):
    """Rows of a file by the users of a table."""
    path, events = _path(spark, ".parquet"), table(spark, sf_dir, "events")
    events.select(
        F.col("event_id").alias("id"), F.col("event_type").alias("subreddit"), F.col("user_id").alias("author")
    ).write.parquet(path)
    users = events.where(F.col("event_type") == "signup").select(F.col("user_id").alias("user"))
    return readers.posts_of_users(spark, path, users.distinct()).select("id", "subreddit", "author")


@query("""select c_custkey as id, round(c_acctbal, 2) as balance from customer where c_custkey % 2 = 1""")
def snapshot_round_trip(spark, sf_dir):
    """Two runs of a dataset are stored; the newest is read."""
    root, rows = _path(spark, ""), table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance")
    )
    snapshots.save_snapshot(rows.where("id % 2 = 1"), root, "balances", "20240102_000000")
    snapshots.save_snapshot(rows, root, "balances", "20240101_000000")
    return snapshots.load_newest(spark, root, "balances").select("id", F.round("balance", 2).alias("balance"))


@query("with" + OFFSETS_SQL + """
  select event_id as id, user_id as author, offset_from_cd1 from placed
  where abs(floor((epoch_us(ts) - epoch_us(anchor_ts)) / 86400000000.0)) <= 30""")
def bucketed_offsets(spark, sf_dir):
    """Posts stored in buckets by user: offsets and the window of a month are joined without shuffling them."""
    root, posts = _path(spark, ""), event_posts(spark, sf_dir)
    snapshots.save_bucketed(posts, root, "posts", "20240101_000000", "author", 8)
    stored = snapshots.load_bucketed(spark, root, "posts", "author")
    users = event_users(posts)
    placed = anchors.add_offsets(stored, users, by_layout=True)
    return anchors.within_months(placed, users, months=1, by_layout=True).select("id", "author", "offset_from_cd1")
