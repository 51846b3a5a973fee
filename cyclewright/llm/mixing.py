"""Mixing sources to target weights by capped water-filling. DataFrame functions only.

Targets share the words of all documents by weight, but no source gives more than `epochs` times its
own words. Sources above that are clamped and their excess goes to the others by weight, again and
again until none is above. A source whose target is q times its size gives floor(q) whole repetitions
of every document, and the rest from a seeded order of its documents: whole ones up to the rest, and
of the one that crosses it only its first words.

Defined results: a null text has no words; a null source is a source of its own, ordered last; a
source without words has target 0; texts are read whole; repeated rows are taken as often as they stand there; an empty
table gives no rows. Other columns of the input are not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cyclewright.llm.common import count_words, settled

#: Weights of the sources in code point order, repeating.
WEIGHTS = (1, 2, 3)
#: Most repetitions of a source.
EPOCHS = 3
SEED = 20
#: Hexadecimal digits of a document's seeded order that name its bucket: 4,096 partial sums a source
#: find the bucket in which the rest ends, and only that bucket is ordered row by row.
BUCKET_DIGITS = 3


def source_sizes(sized: DataFrame) -> DataFrame:
    """source, source_size: words of each source."""
    return sized.groupBy("source").agg(F.sum("size").alias("source_size"))


def ranked_weights(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Adds the integer weight of each source by its place in code point order, null last.

    The order is made by range partitions and their counts, so that no task sees all sources.
    """
    dealt = sources.select("*", F.col("source").isNull().alias("last"))
    parts = max(1, int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = settled(
        dealt.repartitionByRange(parts, "last", "source").withColumn("part", F.spark_partition_id())
    )
    # One row a partition: this window is as small as the number of partitions.
    before = (
        dealt.groupBy("part")
        .agg(F.count("*").alias("n"))
        .select(
            "part",
            F.coalesce(
                F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
            ).alias("before"),
        )
    )
    inside = F.row_number().over(Window.partitionBy("part").orderBy("last", "source"))
    place = F.col("before") + inside - 1
    return (
        dealt.join(before, "part")
        .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")))
        .select("source", "source_size", "weight")
    )


def water_fill(sources: DataFrame, epochs: int = EPOCHS) -> DataFrame:
    """Adds target: the share of all words by weight, at most `epochs` times source_size.

    Needs source, source_size, weight. Each round clamps every source above its limit and shares what is
    left among the others; a clamped source stays clamped, as shares only grow.
    """
    sources = settled(sources.withColumn("most", F.col("source_size") * epochs).withColumn("clamped", F.lit(False)))
    wide = "decimal(38,0)"
    left = weight = None
    while True:
        free = ~F.col("clamped")
        row = sources.agg(
            F.sum("source_size").alias("total"),
            F.sum(F.when(~free, F.col("most")).otherwise(0)).alias("given"),
            F.sum(F.when(free, F.col("weight")).otherwise(0)).alias("weight"),
        ).first()
        left, weight = (row["total"] or 0) - (row["given"] or 0), row["weight"] or 0
        above = free & (F.lit(left).cast(wide) * F.col("weight") > F.col("most").cast(wide) * F.lit(weight))
        if not weight or sources.where(above).isEmpty():
            break
        sources = settled(sources.withColumn("clamped", F.col("clamped") | above))
    share = F.lit(left).cast("double") * F.col("weight").cast("double") / F.lit(max(weight, 1)).cast("double")
    return sources.withColumn("target", F.when(F.col("clamped"), F.col("most").cast("double")).otherwise(share)).select(
        "source", "source_size", "target"
    )


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken (words the mix takes of the row, repetitions counted)."""
    sized = docs.select("doc_id", "source", count_words(F.col("text")).alias("size"))
    sized = settled(sized)
    targets = water_fill(ranked_weights(source_sizes(sized), weights), epochs)
    size, rest = F.col("source_size"), F.col("rest")
    whole = F.when(size > 0, F.floor(F.col("target") / size)).otherwise(0).cast("long")
    targets = settled(
        targets.withColumn("whole", whole).withColumn("rest", F.round(F.col("target") - F.col("whole") * size).cast("long"))
    )
    rows = sized.withColumn(
        "place", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string"), F.col("size").cast("string")))
    ).withColumn("bucket", F.substring("place", 1, BUCKET_DIGITS))
    # Sums of the buckets of a source, in order: bounded by the number of digits.
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    upto = Window.partitionBy("source").orderBy("bucket")
    buckets = (
        sums.withColumn("start", F.sum("words").over(upto) - F.col("words"))
        .join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
        .select(
            F.col("source").alias("s"), F.col("bucket").alias("b"), "start", "words", "source_size", "target", "whole", "rest"
        )
    )
    rows = rows.join(
        settled(buckets), F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b"))
    ).drop("s", "b")
    # Buckets wholly below the rest are taken, those above are not.
    plain = rows.where((F.col("start") + F.col("words") <= rest) | (F.col("start") >= rest)).withColumn(
        "part", F.when(F.col("start") >= rest, 0).otherwise(F.col("size"))
    )
    inside = Window.partitionBy("source", "bucket").orderBy("place", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    crossing = (
        rows.where((F.col("start") + F.col("words") > rest) & (F.col("start") < rest))
        .withColumn("before", F.col("start") + F.sum("size").over(inside) - F.col("size"))
        .withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("before"))))
        .drop("before")
    )
    return plain.unionByName(crossing).select(
        "doc_id", "size", "source_size", "target", (F.col("whole") * F.col("size") + F.col("part")).cast("long").alias("taken")
    )


def repeated(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix, with size, source_size, target and taken beside their columns.

    Documents of which nothing is taken are left out. Rows of one doc_id are told apart by their size;
    equal ones take the same.
    """
    mix = mixed(docs, **options)
    key = ["doc_id", "size"]
    names = ["source_size", "target", "taken"]
    mix = mix.groupBy(*key, "source_size", "target").agg(F.max("taken").alias("taken")).where("taken > 0")
    mix = mix.select(F.col("doc_id").alias("mix_id"), F.col("size").alias("mix_size"), *[F.col(n).alias(f"mix_{n}") for n in names])
    kept = [c for c in docs.columns if c not in ("size", *names)]
    return (
        docs.select(*kept, count_words(F.col("text")).alias("size"))
        .join(mix, F.col("doc_id").eqNullSafe(F.col("mix_id")) & (F.col("size") == F.col("mix_size")))
        .select(*kept, "size", *[F.col(f"mix_{n}").alias(n) for n in names])
    )
