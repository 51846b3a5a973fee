"""Quality classifier by importance resampling with hashed n-gram models and Gumbel top-k.

Two generative models count hashed words and word pairs: the target model over labelled good documents, the
raw model over all documents. The importance weight of a document is the ratio of its probabilities under the
two, in logarithms a sum over its n-grams. Adding a Gumbel variable to the logarithm of the weight and taking
the k largest sums samples k documents without replacement in proportion to their weights.

Smoothing adds the same pseudo-count to the target's count and to the count that the raw model leads one to
expect in a text of the target's size. Where the target isn't clearly short of that, its model backs off to the raw
one: rare n-grams then say nothing, and long documents earn nothing by length. What a target document usually
gains per n-gram is taken off. k is the number of documents whose weight passes the
level that parts good from other labelled documents best.

The target model and the level are fitted on a bounded sample of labelled rows (SAMPLE); counts of the raw
model and the weights cover every document and whole texts.

Defined results: null and empty texts have no n-grams and log weight 0; several labels of one doc_id count as
bad if one is; rows that tie with the k-th stay; texts are read whole; repeated rows share their fate; a null doc_id draws like any
other; without labels of both kinds every row stays; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cyclewright.llm.common import KEY_BITS, arrow_map, kth_largest, seeded_sample, settled

#: Hash buckets: the lower half for words, the upper for word pairs. They bound what a task sends and what is
#: broadcast (8 MB); fewer make junk words collide with clean ones.
BUCKETS = 1 << 20
#: Labelled rows that the target model and the level are fitted on, at most; half of them each.
SAMPLE = 20_000
PSEUDO_COUNT = 0.5
SEED = 11
#: Standard deviations by which the target must fall short of the raw model for a bucket to count.
SHORT_BY = 3.5
#: A good document lost weighs as many times as a bad one kept, when the level is chosen.
COST_OF_LOSS = 5
#: Words a task remembers the hashes of before it starts anew.
MEMORY = 500_000
#: Fixed point of the keys.
POINT = 1 << 20


class Grams:
    """Bucket numbers of the n-grams of a text."""

    def __init__(self, buckets: int = BUCKETS):
        self.half, self.known = buckets // 2, {}

    def of(self, text: str | None) -> np.ndarray:
        words = text.split() if text else []
        known = self.known
        if len(known) > MEMORY:
            known.clear()
        try:
            codes = [known[w] for w in words]
        except KeyError:
            for w in words:
                if w not in known:
                    known[w] = zlib.crc32(w.encode("utf-8", "surrogatepass"))
            codes = [known[w] for w in words]
        codes = np.array(codes, np.uint64)
        pairs = (codes[:-1] * np.uint64(0x9E3779B97F4A7C15) + codes[1:] * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(33)
        half = np.uint64(self.half)
        return np.concatenate([codes % half, pairs % half + half]).astype(np.int64)


@dataclass
class Model:
    """log ratio of each bucket, what a target document gains per n-gram, and the least log weight that passes."""

    ratios: np.ndarray
    level: float


def labelled_sample(labels: DataFrame, sample: int = SAMPLE) -> dict[int, tuple[bool, bool]]:
    """doc_id to (good, fits the target model; else the level), of at most `sample` labelled rows by seeded order."""
    rows = (
        labels.where("doc_id is not null and quality is not null")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg((F.min("quality") == 1).alias("good"), (F.coalesce(F.max("toxic"), F.lit(0)) == 1).alias("toxic"))
    )
    rows = (
        seeded_sample(rows, F.xxhash64("doc_id", F.lit(SEED)), sample)
        .select("doc_id", (F.col("good") & ~F.col("toxic")).alias("good"), (F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(2)) == 0).alias("fits"))
        .toPandas()
    )
    return {int(i): (bool(g), bool(f)) for i, g, f in zip(rows["doc_id"], rows["good"], rows["fits"], strict=True)}


def gram_counts(docs: DataFrame, target_ids: set[int], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Counts of each bucket over all documents, and over those of target_ids. Tasks send sums, a row a bucket."""
    shared = docs.sparkSession.sparkContext.broadcast(target_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, ids = Grams(buckets), shared.value
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            held = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                own = grams.of(text)
                held.append(own)
                if doc in ids:
                    target += np.bincount(own, minlength=buckets)
            raw += np.bincount(np.concatenate([*held, np.zeros(0, np.int64)]), minlength=buckets)
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(target[at])], names=["bucket", "raw", "target"])

    counted = arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "bucket long, raw long, target long")
    # At most one row a bucket, fetched in columns.
    rows = counted.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()
    raw, target = np.zeros(buckets), np.zeros(buckets)
    at = rows["bucket"].to_numpy()
    raw[at], target[at] = rows["raw"].to_numpy(), rows["target"].to_numpy()
    return raw, target


def log_ratios(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """log of p(target) / p(raw) of each bucket, smoothed at the target's size; 0 where the target backs off."""
    expected = raw * (target.sum() / max(raw.sum(), 1.0))
    short = (expected - target) / np.sqrt(expected + 1) >= SHORT_BY
    return np.where(short, np.log((target + PSEUDO_COUNT) / (expected + PSEUDO_COUNT)), 0.0)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def weighed(docs: DataFrame, ratios: np.ndarray, weight: str = "log_weight", size: str = "n_grams") -> DataFrame:
    """docs with the sum of the ratios of each text's n-grams and their number."""
    shared = docs.sparkSession.sparkContext.broadcast(ratios)
    columns = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema)
    schema = f"{columns}, `{weight}` double, `{size}` long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, values = Grams(len(shared.value)), shared.value
        for batch in batches:
            weights, sizes = [], []
            for text in batch.column("text").to_pylist():
                own = grams.of(text)
                weights.append(float(values[own].sum()))
                sizes.append(len(own))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(weights, pa.float64()), pa.array(sizes, pa.int64())],
                names=[*batch.schema.names, weight, size],
            )

    return arrow_map(docs, run, schema)


def best_level(good: np.ndarray, bad: np.ndarray) -> float:
    """The level at which good ones below it and bad ones above it cost least."""
    if not len(good) or not len(bad):
        return -np.inf
    values = np.unique(np.concatenate([good, bad]))
    levels = (values[1:] + values[:-1]) / 2 if len(values) > 1 else values
    lost = np.searchsorted(np.sort(good), levels) / len(good)
    passed = 1 - np.searchsorted(np.sort(bad), levels) / len(bad)
    return float(levels[np.argmin(COST_OF_LOSS * lost + passed)])


def key_of(weight: Column, doc_id: Column, seed: int = SEED) -> Column:
    """log weight plus a seeded Gumbel variable of the document, in fixed point."""
    uniform = (F.pmod(F.xxhash64(doc_id, F.lit(seed)), F.lit(1 << 40)) + F.lit(0.5)) / F.lit(float(1 << 40))
    value = weight - F.log(-F.log(uniform))
    bound = F.lit(float(1 << (KEY_BITS - 22)))
    return F.floor(F.greatest(F.least(value, bound), -bound) * POINT).cast("long")


def net_weight(weight: str, size: str, gain: float) -> Column:
    return F.col(weight) - F.lit(gain) * F.col(size)


def fitted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, buckets: int = BUCKETS) -> tuple[np.ndarray, float, DataFrame, float]:
    """Ratios, the usual gain per n-gram, doc_id with log_weight and n_grams of every row, and the level."""
    marked = labelled_sample(labels, sample)
    raw, target = gram_counts(docs, {i for i, (good, fits) in marked.items() if good and fits}, buckets)
    ratios = log_ratios(raw, target)
    thin = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    first = settled(weighed(thin, ratios).drop("text"))
    spark = docs.sparkSession
    ids = spark.createDataFrame([(i, good) for i, (good, fits) in marked.items() if not fits] or [(None, None)], "id long, good boolean")
    # At most `sample` rows, the bound of both the broadcast and the collected join.
    held = first.join(F.broadcast(ids), F.col("doc_id") == F.col("id")).dropDuplicates(["id"]).select("good", "log_weight", "n_grams").toPandas()
    is_good = held["good"].to_numpy(bool) if len(held) else np.zeros(0, bool)
    weight, size = held["log_weight"].to_numpy(float), held["n_grams"].to_numpy(float)
    some = is_good & (size > 0)
    gain = float(np.median(weight[some] / size[some])) if some.any() else 0.0
    weight = weight - gain * size
    level = best_level(weight[is_good], weight[~is_good])
    return ratios, gain, first.withColumn("log_weight", net_weight("log_weight", "n_grams", gain)), level


def resampled(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, n_grams, log_weight, key (fixed point), kept of every row."""
    _, _, scored, level = fitted(docs, labels, **options)
    keyed = scored.withColumn("key", key_of(F.col("log_weight"), F.col("doc_id")))
    least = kth_largest(keyed, keyed.where(F.col("log_weight") >= F.lit(level)).count())
    return keyed.select("doc_id", "n_grams", "log_weight", "key", F.lit(True).alias("kept") if least is None else (F.col("key") >= least).alias("kept"))


def kept_rows(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of docs that the sample keeps, with all their columns; texts are weighed again, not shuffled."""
    ratios, gain, scored, level = fitted(docs, labels, **options)
    keyed = scored.select(key_of(F.col("log_weight"), F.col("doc_id")).alias("key"), "log_weight")
    least = kth_largest(keyed, keyed.where(F.col("log_weight") >= F.lit(level)).count())
    if least is None:
        return docs
    weight, size = free_name(docs, "log_weight"), free_name(docs, "n_grams")
    rows = weighed(docs, ratios, weight, size)
    return rows.where(key_of(net_weight(weight, size, gain), F.col("doc_id").cast("long")) >= least).select(*docs.columns)
