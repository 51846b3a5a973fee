"""CSV records of large files, found in many tasks although quoted fields hold newlines.

A line's start is inside quotes when an odd number of quotes stands before it in its
file. The quotes of each block (split) of a file are counted first; a running sum over a
file's blocks, a row each, says in which state a block begins. Then every task joins the
lines of its own blocks to records. Only what reaches over the border of two blocks, at
most two pieces a block, is put together by a shuffle.
"""

from __future__ import annotations

import csv
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Whole records, and pieces of records that began in an earlier block or go on in the next.
WHOLE, CONTINUED, BEGUN = 0, 1, 2
RECORDS = "file string, block long, place long, kind int, record string"
#: Types that inference tries in turn.
INFERRED = ("int", "bigint", "double", "date", "timestamp", "boolean")


def _lines(spark: SparkSession, path: str | list[str], encoding: str) -> DataFrame:
    """Lines in file order within each block, with the parity of their quotes."""
    rows = spark.read.option("lineSep", "\n").text(path)
    value = F.col("value")
    if encoding.upper() not in ("UTF-8", "UTF8"):
        value = F.decode(value.cast("binary"), encoding)  # the text source keeps bytes as they are
    quotes = F.octet_length("line") - F.octet_length(F.replace("line", F.lit('"'), F.lit("")))
    return rows.select(
        value.alias("line"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
    ).select("file", "block", "line", (quotes % 2).cast("int").alias("odd"))


def _open_blocks(lines: DataFrame) -> dict[str, set[int]]:
    """Blocks that begin inside quotes; there is a row a block, as in the driver's own list of splits."""
    sums = lines.groupBy("file", "block").agg((F.sum("odd") % 2).alias("odd")).where("odd = 1").collect()
    flips = defaultdict(list)
    for r in sums:
        flips[r["file"]].append(r["block"])
    return {file: sorted(blocks) for file, blocks in flips.items()}


class _Block:
    """Lines of one block as they come by."""

    def __init__(self, file: str, block: int, flips: list[int]):
        self.file, self.block, self.place = file, block, 0
        self.open = sum(b < block for b in flips) % 2
        self.held: list[str] = []
        self.kind = CONTINUED if self.open else BEGUN

    def rows(self, records: pa.Array, kinds: list[int]) -> pa.RecordBatch:
        n = len(records)
        columns = [
            pa.array([self.file] * n, pa.string()),
            pa.array([self.block] * n, pa.int64()),
            pa.array(range(self.place, self.place + n), pa.int64()),
            pa.array(kinds, pa.int32()),
            records.cast(pa.string()),
        ]
        self.place += n
        return pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in RECORDS.split(", ")])

    def take(self, lines: pa.Array, odd: np.ndarray) -> Iterator[pa.RecordBatch]:
        inside = (self.open + np.cumsum(odd) - odd) % 2
        self.open = int((self.open + odd.sum()) % 2)
        starts = np.flatnonzero(inside == 0)
        if not len(starts):
            self.held += lines.to_pylist()
            return
        first = int(starts[0])
        self.held += lines[:first].to_pylist()
        if self.held:
            kind = WHOLE if self.kind == BEGUN else CONTINUED
            yield self.rows(pa.array(["\n".join(self.held)], pa.string()), [kind])
        self.kind = BEGUN
        # The last record may go on in the next batch.
        last = int(starts[-1])
        self.held = lines[last:].to_pylist()
        if last > first:
            lists = pa.ListArray.from_arrays(pa.array(starts - first, pa.int32()), lines[first:last])
            yield self.rows(pc.binary_join(lists, "\n"), [WHOLE] * len(lists))

    def end(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            kind = CONTINUED if self.kind == CONTINUED else BEGUN if self.open else WHOLE
            yield self.rows(pa.array(["\n".join(self.held)], pa.string()), [kind])


def _joined(flips: dict[str, list[int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: _Block | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            files, blocks = batch.column("file").to_pylist(), batch.column("block").to_numpy()
            odd, lines = batch.column("odd").to_numpy(), batch.column("line")
            changed = np.flatnonzero(np.diff(blocks) != 0) + 1
            changed = sorted({0, *changed.tolist(), *(i for i in range(1, len(files)) if files[i] != files[i - 1])})
            for a, b in zip(changed, [*changed[1:], len(files)], strict=True):
                if own is None or (own.file, own.block) != (files[a], int(blocks[a])):
                    if own is not None:
                        yield from own.end()
                    own = _Block(files[a], int(blocks[a]), flips.get(files[a], []))
                yield from own.take(lines[a:b], odd[a:b])
        if own is not None:
            yield from own.end()

    return run


def csv_records(spark: SparkSession, path: str | list[str], encoding: str = "UTF-8") -> DataFrame:
    """file, block, place, record: every record as text, blank ones left out; a file's first is block 0, place 0."""
    lines = _lines(spark, path, encoding)
    pieces = lines.mapInArrow(_joined(_open_blocks(lines)), RECORDS)
    # A record that reaches over blocks is what began in one of them and all that goes on behind it.
    inside = W.partitionBy("file").orderBy("block", "kind")
    parts = pieces.where(F.col("kind") != WHOLE).withColumn("n", F.count_if(F.col("kind") == BEGUN).over(inside))
    text = F.transform(
        F.array_sort(F.collect_list(F.struct("block", "kind", "record"))), lambda p: p["record"]
    )
    split = parts.groupBy("file", "n").agg(
        F.min_by("block", F.struct("block", "kind")).alias("block"),
        F.min_by("place", F.struct("block", "kind")).alias("place"),
        F.array_join(text, "\n").alias("record"),
    )
    names = ["file", "block", "place", "record"]
    whole = pieces.where(F.col("kind") == WHOLE).select(names).unionByName(split.select(names))
    return whole.withColumn("record", F.regexp_replace("record", r"\r\z", "")).where("record <> ''")


def _inferred(rows: DataFrame, names: list[str]) -> T.StructType:
    """The first type of INFERRED that all values of a column have, else string; one pass over all rows."""
    fails = [
        F.count_if(F.col(f"c{i}").isNotNull() & F.col(f"c{i}").try_cast(kind).isNull()).alias(f"{i}_{kind}")
        for i in range(len(names))
        for kind in INFERRED
    ]
    known = [F.count(f"c{i}").alias(f"n_{i}") for i in range(len(names))]
    seen = rows.agg(*fails, *known).first()
    kinds = [
        next((k for k in INFERRED if seen[f"n_{i}"] and not seen[f"{i}_{k}"]), "string") for i in range(len(names))
    ]
    return T.StructType([T.StructField(n, T._parse_datatype_string(k)) for n, k in zip(names, kinds, strict=True)])


def read_split_csv(
    spark: SparkSession, path: str | list[str], schema: T.StructType | None = None, encoding: str = "UTF-8"
) -> DataFrame:
    """CSV with a header in each file, quoted newlines and doubled quotes, read by many tasks a file.

    A quote inside a field without quotes is not CSV of this kind. ``schema`` names the
    columns by position; without it names come from a header and types from all values.
    """
    records = csv_records(spark, path, encoding)
    is_header = (F.col("block") == 0) & (F.col("place") == 0)
    options = {"escape": '"', "multiLine": "true", "mode": "PERMISSIVE"}
    body = records.where(~is_header)

    def parsed(fields: T.StructType) -> DataFrame:
        # Fields by position, so that a header may have any names.
        plain = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(fields.fields)])
        return body.select(F.from_csv("record", plain.simpleString(), options).alias("r")).select("r.*")

    if schema is None:
        header = records.where(is_header).select("record").first()
        names = next(csv.reader([header["record"]], strict=False)) if header else []
        if not names:
            return spark.createDataFrame([], T.StructType([]))
        schema = _inferred(parsed(T.StructType([T.StructField(n, T.StringType()) for n in names])), names)
    return parsed(schema).toDF(*schema.names)
