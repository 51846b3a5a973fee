"""SimHash near-duplicates: whole-text fingerprints, linked through vantage-point trees.

A pair within r bits of 64 agrees on at least one of r + 1 segments of the bits. A forest of r + 1 trees,
one a segment, therefore meets every linked pair: tree t first parts the fingerprints by their bits in
segment t. A crowded cell is parted again by segments of its other bits, on one of which a linked pair
agrees as well, so that cells of random fingerprints hold one in 2^22 or fewer; what is still crowded is
parted by the Hamming distance to vantage points: a shell of r + 1 distances makes a shard, and by the triangle bound a pair within r lies in one shell or in two that
touch, so each fingerprint also visits the shard below its own. In a shard a local vantage-point tree
splits at the median distance, sends the boundary to both sides and compares what the bounds leave.
Shards emit a spanning forest of their links, never all pairs; the forests' components are the groups.

(A tree over all 64 bits alone would be exact too, but at r = 4 a median split of random fingerprints keeps
about 85 % of the pairs a level, so that work grows nearly with the square of the input.)

Defined results: null and empty texts have fingerprint zero and are linked like any other; a text of fewer
words than a shingle is one shingle; repeated rows are returned as often as they stand; a null doc_id
links like any other and is the component's id only where the component has no other; texts are read whole, whatever their length; an empty table gives
no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cyclewright.llm.common import ASCII_LOWER, arrow_map, byte_texts, settled, stored
from cyclewright.llm.components import components
from cyclewright.plans.joins import lookup_join

#: Words of a shingle, seed of its hash and most differing bits of a link.
SHINGLE, HASH_SEED, RADIUS = 4, 42, 4
#: Fingerprints of one cell that are not parted further.
CELL_LIMIT = 20_000
#: Vantage points that part a crowded cell; each fingerprint then goes to two shards a point.
VANTAGE = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
#: Points that a local tree compares without a further split.
LEAF = 512


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def text_fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of a whole text; zero without words."""
    words = text.translate(ASCII_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, HASH_SEED)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    digest = xxhash.xxh64_intdigest
    hashes = np.array(
        [digest(joined[a:b], HASH_SEED) for a, b in zip(starts[: 1 - shingle].tolist(), ends[shingle - 1 :].tolist(), strict=True)],
        np.uint64,
    )
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):
        part = hashes[at : at + 65_536].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, text_sha256, bits (the fingerprint as a signed long) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = [_signed(text_fingerprint(t, shingle)) for t in byte_texts(batch.column("text"))]
            columns = [batch.column("doc_id"), batch.column("text_sha256"), pa.array(bits, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_sha256", "bits"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_sha256().alias("text_sha256"), "text")
    return arrow_map(rows, run, "doc_id long, text_sha256 string, bits long")


def text_sha256() -> Column:
    """SHA-256 of a row's text, which tells unequal texts of one doc_id apart."""
    return F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)


def segments(radius: int) -> list[int]:
    """Disjoint masks that cover 64 bits, one more than the radius."""
    edges = [64 * i // (radius + 1) for i in range(radius + 2)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]


def inner_segments(radius: int) -> list[list[int]]:
    """For each of `segments` the masks, one more than the radius, that part the bits outside it."""
    out = []
    for mask in segments(radius):
        rest = [1 << i for i in range(64) if not mask >> i & 1]
        edges = [len(rest) * i // (radius + 1) for i in range(radius + 2)]
        out.append([sum(rest[a:b]) for a, b in zip(edges, edges[1:], strict=False)])
    return out


def _crowded(cells: DataFrame, keys: list[str], limit: int) -> DataFrame:
    return cells.groupBy(*keys).count().where(F.col("count") > limit).select(*[F.col(k).alias(f"c_{k}") for k in keys])


def _marked(cells: DataFrame, crowded: DataFrame, keys: list[str]) -> DataFrame:
    same = reduce(lambda x, y: x & y, [F.col(k) == F.col(f"c_{k}") for k in keys])
    marked = cells.join(crowded, same, "left").withColumn("crowded", F.col(f"c_{keys[0]}").isNotNull())
    return marked.drop(*crowded.columns)


def shards(points: DataFrame, radius: int = RADIUS, cell_limit: int = CELL_LIMIT) -> DataFrame:
    """shard, bits: every fingerprint in each shard where a linked one can be."""
    cells = points.select(
        "bits",
        F.posexplode(F.array(*[F.col("bits").bitwiseAND(F.lit(_signed(m))) for m in segments(radius)])).alias("tree", "cell"),
    )
    crowded = stored(_crowded(cells, ["tree", "cell"], cell_limit))
    if crowded.isEmpty():
        return cells.select(F.xxhash64("tree", "cell").alias("shard"), "bits")
    # Fingerprints of a cell agree on its segment, linked ones also on one of the segments of the other bits.
    cells = _marked(cells, crowded, ["tree", "cell"])
    masks = F.get(F.array(*[F.array(*[F.lit(_signed(m)) for m in row]) for row in inner_segments(radius)]), F.col("tree"))
    parts = F.transform(masks, lambda m, i: F.struct(i.alias("part"), F.col("bits").bitwiseAND(m).alias("inner")))
    whole = F.array(F.struct(F.lit(-1).alias("part"), F.lit(0).cast("long").alias("inner")))
    cells = cells.select("bits", "tree", "cell", "crowded", F.inline(F.when(F.col("crowded"), parts).otherwise(whole)))
    keys = ["tree", "cell", "part", "inner"]
    cells = _marked(cells.drop("crowded"), stored(_crowded(cells.where("crowded"), keys, cell_limit)), keys)
    shells = []
    for v in VANTAGE:
        shell = F.floor(F.bit_count(F.col("bits").bitwiseXOR(F.lit(_signed(v)))) / (radius + 1)).cast("int")
        shells.append(F.when(F.col("crowded"), F.array(shell, shell - 1)).otherwise(F.array(F.lit(0))))
    for i, both in enumerate(shells):
        cells = cells.withColumn(f"shell{i}", F.explode(both))
    return cells.select(F.xxhash64(*keys, *[f"shell{i}" for i in range(len(VANTAGE))]).alias("shard"), "bits")


def _forest(points: np.ndarray, radius: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links of a few points as a spanning forest: each found point looks among those not found yet."""
    left, out = points, []
    while len(left):
        wave, left = [left[0]], left[1:]
        while wave and len(left):
            at = wave.pop()
            near = np.bitwise_count(left ^ at) <= radius
            if near.any():
                found, left = left[near], left[~near]
                out.append((np.full(len(found), at), found))
                wave.extend(found)
    return out


def tree_links(points: np.ndarray, radius: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links among distinct points that connect all that are linked, by a vantage-point tree."""
    out, todo = [], [points]
    while todo:
        own = todo.pop()
        if len(own) < 2:
            continue
        if len(own) <= LEAF:
            near = np.bitwise_count(own[:, None] ^ own[None, :]) <= radius
            if int(near.sum()) > len(own):
                out.extend(_forest(own, radius))
            continue
        distance = np.bitwise_count(own ^ own[0]).astype(np.int64)
        middle = int(np.median(distance))
        inner, outer = own[distance <= middle + radius], own[distance > middle]
        if len(inner) == len(own) or len(outer) == len(own):
            out.extend(_forest(own, radius))  # all are about as far away: no bound parts them
        else:
            todo += [inner, outer]
    return out


def _shard_links(radius: int):
    def links(points: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        found = tree_links(np.unique(points).view(np.uint64), radius)
        return (np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])) if found else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by shard; a shard may reach over several batches."""
        shard, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, points = batch.column("shard").to_numpy(), batch.column("bits").to_numpy()
            edges = np.flatnonzero(np.diff(keys)) + 1
            out = []
            for key, run_points in zip(keys[np.r_[0, edges]], np.split(points, edges), strict=True):
                if key != shard:
                    if held and sum(map(len, held)) > 1 and (got := links(np.concatenate(held))):
                        out.append(got)
                    shard, held = key, []
                held.append(run_points)
            if out:
                yield _links(np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out]))
        if held and (got := links(np.concatenate(held))):
            yield _links(*got)

    def _links(a, b):
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    return run


def near_links(points: DataFrame, radius: int = RADIUS, cell_limit: int = CELL_LIMIT) -> DataFrame:
    """a, b: links between distinct fingerprints that connect all that are linked."""
    dealt = shards(points, radius, cell_limit).repartition("shard").sortWithinPartitions("shard")
    return arrow_map(dealt, _shard_links(radius), "a long, b long")


def _grouped(docs: DataFrame, radius: int, cell_limit: int) -> DataFrame:
    """doc_id, text_sha256, bits of every row with its group: root (a fingerprint) and component_id."""
    prints = stored(fingerprints(docs))
    points = settled(prints.groupBy("bits").agg(F.min("doc_id").alias("least_id")))
    roots = components(near_links(points.select("bits"), radius, cell_limit))
    points = points.join(roots, F.col("bits") == F.col("node"), "left").select(
        F.col("bits").alias("of"), "least_id", F.coalesce("root", "bits").alias("root")
    )
    least = points.groupBy("root").agg(F.min("least_id").alias("component_id"))
    # A component of many fingerprints is one root: this join can be split where that is hot.
    points = settled(lookup_join(points, least, ["root"]).select("of", "root", "component_id"))
    return prints.join(points, F.col("bits") == F.col("of")).drop("of")


def near_groups(docs: DataFrame, radius: int = RADIUS, cell_limit: int = CELL_LIMIT) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id (smallest doc_id reachable) of every row."""
    return _grouped(docs, radius, cell_limit).select(
        "doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id"
    )


def one_of_each(docs: DataFrame, radius: int = RADIUS, cell_limit: int = CELL_LIMIT) -> DataFrame:
    """One row of docs of each group, with all their columns.

    It is the row with the smallest doc_id, a null one last; of several texts of that doc_id the one with the
    smallest SHA-256, and of repeated rows of one doc_id and text the first in the order of their other columns.
    """
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_sha256")
    stays = _grouped(docs, radius, cell_limit).groupBy("root").agg(F.min(order).alias("stay"))
    stays = stored(stays.select(F.col("stay.doc_id").alias("stay_id"), F.col("stay.text_sha256").alias("stay_sha")))
    # The rows travel as one column, so that their names can't clash.
    own = docs.select(F.struct(*docs.columns).alias("own"), F.col("doc_id").cast("long").alias("own_id"), text_sha256().alias("own_sha"))
    rows = own.join(stays, F.col("own_id").eqNullSafe(F.col("stay_id")) & (F.col("own_sha") == F.col("stay_sha")))
    if stays.count() < rows.count():
        first = Window.partitionBy("stay_id", "stay_sha").orderBy(F.to_json("own"))
        rows = rows.withColumn("place", F.row_number().over(first)).where("place = 1")
    return rows.select("own.*")
