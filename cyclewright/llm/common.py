"""Small helpers shared by the operators of this folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as all contracts here take it, as a character class of Java's and RE2's regular expressions.
SPACE = r"[\x20\x09-\x0D]"
NOT_SPACE = r"[^\x20\x09-\x0D]"
#: Maps bytes of UTF-8: A-Z to a-z.
ASCII_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Rows and bytes of one Arrow batch: whole texts travel in them, so they are fewer than Spark's defaults.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20
#: Bits of a key to select by, and of its digits that one round of the selection counts.
KEY_BITS, DIGIT_BITS = 56, 14


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """This application's folder in spark.checkpoint.dir, which all executors share.

    Where that setting is empty, as in tests, a local temporary folder is set.
    """
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = context.getConf().get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or os.path.join(tempfile.gettempdir(), "checkpoints"))
    return context._jsc.sc().getCheckpointDir().get()


def settled(df: DataFrame) -> DataFrame:
    """The rows, computed once and kept in the shared folder, which outlives executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, *by: str) -> DataFrame:
    """The rows, written as Parquet in the shared folder (in folders by some columns) and read again."""
    path = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def arrow_map(
    df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str
) -> DataFrame:
    """mapInArrow in batches of at most BATCH_ROWS rows, or BATCH_BYTES bytes and a row."""
    conf = df.sparkSession.conf
    for name, most in (("Records", BATCH_ROWS), ("Bytes", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.max{name}PerBatch"
        if not 0 < int(conf.get(name).rstrip("bB")) <= most:
            conf.set(name, str(most))
    return df.mapInArrow(function, schema)


def byte_texts(column: pa.Array) -> Iterator[bytes]:
    """UTF-8 bytes of each text, empty for null."""
    for value in column.cast(pa.large_binary()):
        yield value.as_py() or b""


def lowered(text: Column) -> Column:
    """A-Z to a-z, all other characters as they are."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def count_words(text: Column) -> Column:
    """Maximal runs without white space in the whole text; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(f"{NOT_SPACE}+")), F.lit(0)).cast("long")


def kth_largest(keys: DataFrame, k: int) -> int | None:
    """The k-th largest of the column key: a digit a round, counted in at most 2^DIGIT_BITS rows."""
    if k < 1:
        return None
    offset, prefix, shift = 1 << (KEY_BITS - 1), 0, KEY_BITS
    keys = keys.select((F.col("key") + F.lit(offset)).alias("key"))
    while shift > 0:
        step = min(DIGIT_BITS, shift)
        rows = (
            keys.where(F.shiftright("key", shift) == prefix)
            .groupBy(F.shiftright("key", shift - step).alias("digit"))
            .count()
            .toPandas()
            .sort_values("digit", ascending=False)
        )
        upto = rows["count"].cumsum().to_numpy()
        if not len(upto) or upto[-1] < k:
            return None  # fewer rows than k
        at = int(np.searchsorted(upto, k))
        k -= int(upto[at - 1]) if at else 0
        prefix, shift = int(rows["digit"].iloc[at]), shift - step
    return prefix - offset


def seeded_sample(df: DataFrame, order: Column, k: int) -> DataFrame:
    """At most k rows, those with the largest of a 64-bit hash; rows that tie with the k-th are left out if too many.

    No task or driver gathers more than the digit counts of the selection and the rows that it returns.
    """
    keyed = df.withColumn("seeded_key", F.shiftright(order, 64 - KEY_BITS + 2))
    least = kth_largest(keyed.select(F.col("seeded_key").alias("key")), k)
    if least is not None:
        above = keyed.where(F.col("seeded_key") >= least)
        keyed = above if above.count() <= k else keyed.where(F.col("seeded_key") > least)
    return keyed.drop("seeded_key")
