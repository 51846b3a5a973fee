"""Exact deduplication by composable polynomial fingerprints.

A text is normalised (each run of white space becomes one space) and read as the digits of a number in
base B modulo a prime. Chunks are hashed on their own; the hash of a whole is the sum of its chunks'
hashes, each shifted by B to the number of bytes that follow it. So chunks of a huge document are
hashed in different tasks and combined by a sum. Rows with equal fingerprints and lengths are compared
chunk by chunk with the row that stays, and a fingerprint with unequal texts is split by SHA-256.

Defined results: a null text counts as empty, and empty texts equal each other; of equal texts the
smallest doc_id stays, a null doc_id last, and of repeated rows of one doc_id one stays; an empty table
gives no rows. Only doc_id and text are read, so other columns can't clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cyclewright.llm.common import arrow_map, byte_texts, settled

#: Bytes of a chunk; a document of more than one chunk is dealt out to tasks by chunk.
CHUNK = 32_768
#: (prime, base) of each fingerprint number; products stay below 2^64.
MODULI = ((2_147_483_647, 1_103_515_245), (2_147_483_629, 362_437_069))
#: Bits of the filter that keeps texts without an equal from the second shuffle: 1 MB, at any size of input.
FILTER_BITS = 1 << 23
#: Rows of one fingerprint that are compared with the same copy of the text that stays.
COPIES_A_TASK = 1_000

SPACES = bytes(32 if 9 <= b <= 13 else b for b in range(256))
KEY = ["h1", "h2", "n_bytes"]


def normalised(text: bytes) -> bytes:
    """Each run of white space as one space."""
    text = text.translate(SPACES)
    while b"  " in text:
        text = text.replace(b"  ", b" ")
    return text


def powers(prime: int, base: int, n: int) -> np.ndarray:
    """base^(n-1), ..., base, 1 modulo prime, by doubling."""
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate([out * np.uint64(pow(base, len(out), prime)) % np.uint64(prime), out])
    return out[-n:]


class Hasher:
    """Polynomial hashes of byte strings of at most one chunk."""

    def __init__(self, moduli: tuple[tuple[int, int], ...]):
        self.moduli = moduli
        self.powers = [powers(p, b, CHUNK) for p, b in moduli]

    def shifted(self, chunk: bytes, after: int) -> list[int]:
        """What a chunk followed by `after` bytes adds to the fingerprint of the whole."""
        digits = np.frombuffer(chunk, np.uint8).astype(np.uint64) + np.uint64(1)
        n = len(digits)
        return [
            int(np.dot(digits, w[CHUNK - n :])) % p * pow(b, after, p) % p if n else 0
            for (p, b), w in zip(self.moduli, self.powers, strict=True)
        ]

    def whole(self, text: bytes) -> list[int]:
        """Fingerprint of a text, combined from its chunks."""
        total = [0] * len(self.moduli)
        for at in range(0, len(text), CHUNK):
            chunk = text[at : at + CHUNK]
            total = [x + y for x, y in zip(total, self.shifted(chunk, len(text) - at - len(chunk)), strict=True)]
        return [x % p for x, (p, _) in zip(total, self.moduli, strict=True)]


DEALT = "row long, doc_id long, n_bytes long, text_sha256 string, seq int, h1 long, h2 long, after long, chunk binary"


def _dealt(moduli):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(moduli)
        for batch in batches:
            rows = []
            ids = batch.column("doc_id").to_pylist()
            for row, doc, text in zip(batch.column("row").to_pylist(), ids, byte_texts(batch.column("text")), strict=True):
                text = normalised(text)
                sha = hashlib.sha256(text).hexdigest()
                if len(text) <= CHUNK:
                    rows.append((row, doc, len(text), sha, 0, *hasher.shifted(text, 0), 0, None))
                    continue
                for seq, at in enumerate(range(0, len(text), CHUNK)):
                    chunk = text[at : at + CHUNK]
                    rows.append((row, doc, len(text), sha, seq, None, None, len(text) - at - len(chunk), chunk))
            yield _batch(rows, DEALT)

    return run


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields]
    )


def _hashed(moduli):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(moduli)
        for batch in batches:
            h1, h2 = batch.column("h1").to_pylist(), batch.column("h2").to_pylist()
            after = batch.column("after").to_pylist()
            for i, chunk in enumerate(batch.column("chunk")):
                if chunk.is_valid:
                    h1[i], h2[i] = hasher.shifted(chunk.as_py(), after[i])
            names = ["row", "doc_id", "n_bytes", "text_sha256"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), pa.array(h1, pa.int64()), pa.array(h2, pa.int64())],
                names=[*names, "h1", "h2"],
            )

    return run


def fingerprints(docs: DataFrame, moduli=MODULI) -> DataFrame:
    """row, doc_id, n_bytes, text_sha256, h1, h2 of each row, with chunks of long texts hashed apart."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    dealt = arrow_map(rows, _dealt(moduli), DEALT).repartition("row", "seq")
    parts = arrow_map(dealt, _hashed(moduli), "row long, doc_id long, n_bytes long, text_sha256 string, h1 long, h2 long")
    wide = "decimal(38,0)"
    return parts.groupBy("row", "doc_id", "n_bytes", "text_sha256").agg(
        *[(F.sum(F.col(h).cast(wide)) % F.lit(p)).cast("long").alias(h) for h, (p, _) in zip(("h1", "h2"), moduli, strict=True)]
    )


def _groups(prints: DataFrame, key: list[str]) -> DataFrame:
    """One row a group: keep_id, keep_row (of repeated rows the first), group_size. Hash aggregates only."""
    by_id = prints.groupBy(*key, "doc_id").agg(F.min("row").alias("row"), F.count("*").alias("n"))
    by_id = by_id.withColumn("null_row", F.when(F.col("doc_id").isNull(), F.col("row")))
    groups = by_id.groupBy(*key).agg(
        F.min("doc_id").alias("keep_id"), F.sum("n").alias("group_size"), F.min("null_row").alias("null_row")
    )
    first = by_id.select(*[F.col(k).alias(f"k_{k}") for k in key], F.col("doc_id").alias("keep_id"), F.col("row").alias("keep_row"))
    same = [F.col(k) == F.col(f"k_{k}") for k in key]
    return (
        groups.join(first.withColumnRenamed("keep_id", "k_id"), [*same, F.col("keep_id") == F.col("k_id")], "left")
        .withColumn("keep_row", F.coalesce("keep_row", "null_row"))
        .select(*key, "keep_id", "keep_row", "group_size")
    )


def _positions(h1: np.ndarray, h2: np.ndarray) -> list[np.ndarray]:
    """Three bits of the filter for each fingerprint."""
    a, b = h1.astype(np.uint64), h2.astype(np.uint64)
    return [((a * np.uint64(2 * i + 1) + b * np.uint64(i)) % np.uint64(FILTER_BITS)).astype(np.int64) for i in range(3)]


def _filter_of(groups: DataFrame) -> np.ndarray:
    """Bit map of the fingerprints that occur more than once; its size is fixed by FILTER_BITS."""

    def run(batches):
        bits = np.zeros(FILTER_BITS, bool)
        for batch in batches:
            for at in _positions(batch.column("h1").to_numpy(), batch.column("h2").to_numpy()):
                bits[at] = True
        words = np.packbits(bits).view(np.int64)
        at = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(words[at])], names=["at", "word"])

    words = arrow_map(groups.select("h1", "h2"), run, "at long, word long")
    rows = words.groupBy("at").agg(F.bit_or("word").alias("word")).toPandas()
    packed = np.zeros(FILTER_BITS // 64, np.int64)
    packed[rows["at"].to_numpy(np.int64)] = rows["word"].to_numpy(np.int64)
    return packed.view(np.uint8)


CHUNKS = "doc_id long, n_bytes long, h1 long, h2 long, seq int, chunk binary"


def _candidate_chunks(moduli, packed):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(moduli)
        bits = np.unpackbits(packed.value).astype(bool)
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), byte_texts(batch.column("text")), strict=True):
                text = normalised(text)
                h1, h2 = hasher.whole(text)
                if all(bits[at[0]] for at in _positions(np.array([h1]), np.array([h2]))):
                    for seq, at in enumerate(range(0, max(len(text), 1), CHUNK)):
                        rows.append((doc, len(text), h1, h2, seq, text[at : at + CHUNK]))
            yield _batch(rows, CHUNKS)

    return run


def unequal_fingerprints(docs: DataFrame, groups: DataFrame, moduli=MODULI) -> DataFrame:
    """h1, h2, n_bytes of the fingerprints that texts share which are not equal, byte for byte.

    Every row of a group of several is compared with the text of its keep_id, chunk by chunk. Copies of that
    text are dealt to as many tasks as the size of the group asks for.
    """
    several = settled(
        groups.where("group_size > 1").select(
            *[F.col(k).alias(f"g_{k}") for k in KEY],
            "keep_id",
            F.ceil(F.col("group_size") / COPIES_A_TASK).cast("int").alias("copies"),
        )
    )
    packed = docs.sparkSession.sparkContext.broadcast(_filter_of(several.select(F.col("g_h1").alias("h1"), F.col("g_h2").alias("h2"))))
    chunks = arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), _candidate_chunks(moduli, packed), CHUNKS)
    chunks = chunks.join(several, [F.col(k) == F.col(f"g_{k}") for k in KEY]).select(*KEY, "doc_id", "keep_id", "copies", "seq", "chunk")
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    kept = chunks.where(stays).drop("doc_id").distinct()
    kept = kept.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    kept = kept.select(*[F.col(c).alias(f"k_{c}") for c in (*KEY, "seq", "copy", "chunk")])
    compared = chunks.withColumn("copy", F.pmod(F.xxhash64("doc_id"), F.col("copies")).cast("int"))
    return (
        compared.join(kept, [F.col(c) == F.col(f"k_{c}") for c in (*KEY, "seq", "copy")])
        .where(F.col("chunk") != F.col("k_chunk"))
        .select(*KEY)
        .distinct()
    )


def exact_groups(docs: DataFrame, moduli=MODULI) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row."""
    prints = settled(fingerprints(docs, moduli))
    groups = settled(_groups(prints, KEY))
    unequal = settled(unequal_fingerprints(docs, groups, moduli))
    key = KEY
    if not unequal.isEmpty():
        key = [*KEY, "split"]
        bad = unequal.select(*[F.col(k).alias(f"u_{k}") for k in KEY])
        prints = prints.join(bad, [F.col(k) == F.col(f"u_{k}") for k in KEY], "left").withColumn(
            "split", F.when(F.col("u_h1").isNotNull(), F.col("text_sha256")).otherwise(F.lit(""))
        )
        groups = settled(_groups(prints, key))
    groups = groups.select(*[F.col(k).alias(f"g_{k}") for k in key], "keep_id", "keep_row", "group_size")
    return prints.join(groups, [F.col(k) == F.col(f"g_{k}") for k in key]).select(
        "doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256"
    )


def deduplicated(docs: DataFrame, moduli=MODULI) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    groups = settled(exact_groups(docs, moduli))
    stays = groups.where("kept").select(F.col("doc_id").alias("stay_id"), F.col("text_sha256").alias("stay_sha"))
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x09-\x0D\x20]+", " ")
    # The rows travel as one column, so that their names can't clash.
    own = docs.select(
        F.struct(*docs.columns).alias("own"), F.col("doc_id").cast("long").alias("own_id"), F.sha2(text.cast("binary"), 256).alias("own_sha")
    )
    rows = own.join(stays, F.col("own_id").eqNullSafe(F.col("stay_id")) & (F.col("own_sha") == F.col("stay_sha")))
    if not groups.groupBy("doc_id", "text_sha256").count().where("count > 1").isEmpty():
        # Repeated rows of one doc_id and text: one of them stays.
        first = Window.partitionBy("stay_id", "stay_sha").orderBy(F.to_json("own"))
        rows = rows.withColumn("place", F.row_number().over(first)).where("place = 1")
    return rows.select("own.*")
