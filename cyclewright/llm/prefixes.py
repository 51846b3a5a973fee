"""Trie of conversation prefixes by vertical bitmaps.

Conversations are dealt to shards by ranges of conv_id. In a shard every (position, turn) has a bitset of the
conversations that hold that turn there. The trie is walked depth first: the members of a child are the members of
its parent intersected with the posting of one of their next turns, so that one intersection makes one child; its
popcount is the number of members, its lowest bit the smallest conv_id, and the members that have no further turn
are its end list. A node is known in all shards by a rolling 128-bit digest of its turns, so that shards are merged
by aggregates with a row a shard and node, whatever the number of members. Sums over subtrees are made in the shards,
too: every node belongs to one shard that has it, which alone counts it; whichever ancestors it has, that shard
has them. End lists stay packed, in the order of their ranges; the hash of a long one reads them as a stream.

A conversation is one record for the task that walks its shard; a shard holds SHARD_TURNS turns and the rest of its
last conversation, as 16-byte digests. Texts themselves never leave the first scan.

Defined results: rows without a conv_id belong to no conversation; a null turn comes first; turns of one number,
repeated rows among them, all stand and are ordered by their digest; null roles and texts are empty; a conversation
without turns is a member of the root; conv_id % 5 is negative where conv_id is, as in SQL; an empty table gives no
rows. Turns of equal 128-bit digests count as equal. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cyclewright.llm.common import arrow_map, stored
from cyclewright.plans.joins import lookup_join

#: Conversations with a common beginning, and one more than the turns that they take of it.
FAMILY, MOST_SHARED = 5, 9
#: Turns after which a shard is closed with its conversation, and turns of one range of conversations.
SHARD_TURNS, RANGE_TURNS = 20_000, 200_000
ROOT = bytes(16)

NODES = (
    "shard long, node int, parent int, key binary, parent_key binary, depth long, n long, least long, n_bytes long, ends binary"
)
SUMS = "key binary, n_leaves long, saved_tokens long"


def _digest() -> Column:
    """16 bytes of a turn: its role, with its length, and its text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    return F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")))


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 1), digest and n_bytes of every turn."""
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").alias("turn"),
        _digest().alias("digest"),
        F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("long").alias("n_bytes"),
    )
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "digest")
    return rows.select("conv_id", F.row_number().over(order).cast("long").alias("place"), "digest", "n_bytes")


def rebuilt(conversations: DataFrame) -> DataFrame:
    """conv_id, place, digest, n_bytes of every turn of the rebuilt conversations; one row without place for a turnless one."""
    own = stored(turns(conversations))
    base = F.col("conv_id") - F.col("conv_id") % FAMILY
    shared = F.crc32(F.col("conv_id").cast("string").cast("binary")) % MOST_SHARED
    ids = own.groupBy("conv_id").agg(F.max("place").alias("n_turns")).withColumns({"base": base, "shared": shared})
    heads = own.where((F.col("conv_id") % FAMILY == 0) & (F.col("place") < MOST_SHARED)).select(
        F.col("conv_id").alias("head_id"), "place", "digest", "n_bytes"
    )
    sizes = heads.groupBy(F.col("head_id").alias("size_id")).agg(F.max("place").alias("n_heads"))
    ids = ids.join(sizes, F.col("base") == F.col("size_id"), "left").select(
        "conv_id", "base", "shared", "n_turns", F.least("shared", F.coalesce("n_heads", F.lit(0))).alias("n_taken")
    )
    ids = stored(ids)
    taken = ids.join(heads, (F.col("base") == F.col("head_id")) & (F.col("place") <= F.col("n_taken"))).select(
        "conv_id", "place", "digest", "n_bytes"
    )
    rest = lookup_join(own, ids.select("conv_id", "shared", "n_taken"), ["conv_id"]).where(F.col("place") > F.col("shared"))
    rest = rest.select("conv_id", (F.col("place") - F.col("shared") + F.col("n_taken")).alias("place"), "digest", "n_bytes")
    turnless = ids.where((F.col("n_taken") == 0) & (F.col("n_turns") <= F.col("shared"))).select(
        "conv_id", F.lit(None).cast("long").alias("place"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("n_bytes")
    )
    return taken.unionByName(rest).unionByName(turnless)


class Shard:
    """Vertical bitmaps of a few conversations, each a list of (digest, n_bytes); numbers in the order of their ids."""

    def __init__(self, ids: list[int], lists: list[list[tuple[bytes, int]]]):
        self.ids, self.lists = ids, lists
        self.postings: list[dict[bytes, int]] = []
        self.ending: list[int] = [0] * (max(map(len, lists), default=0) + 1)
        for bit, turns_ in enumerate(lists):
            self.ending[len(turns_)] |= 1 << bit
            for place, (digest, _) in enumerate(turns_):
                if place == len(self.postings):
                    self.postings.append({})
                row = self.postings[place]
                row[digest] = row.get(digest, 0) | 1 << bit

    def _ids_of(self, bits: int) -> np.ndarray:
        found = []
        while bits:
            low = bits & -bits
            found.append(self.ids[low.bit_length() - 1])
            bits ^= low
        return np.array(found, np.int64)

    def nodes(self) -> Iterator[tuple]:
        """(node, parent, key, parent key, depth, members, least id, bytes of the last turn, packed end list), depth first."""
        number = 0
        todo = [((1 << len(self.ids)) - 1, -1, ROOT, None, 0, 0)]
        while todo:
            members, parent, key, above, depth, n_bytes = todo.pop()
            ends = members & self.ending[depth]
            least = self.ids[(members & -members).bit_length() - 1]
            yield number, parent, key, above, depth, members.bit_count(), least, n_bytes, self._ids_of(ends).tobytes() if ends else None
            left = members ^ ends
            while left:
                digest, size = self.lists[(left & -left).bit_length() - 1][depth]
                child = members & self.postings[depth][digest]
                left &= ~child
                todo.append((child, number, hashlib.md5(key + digest).digest(), key, depth + 1, size))
            number += 1


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields]
    )


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by conv_id and place; a shard is named by its smallest conv_id."""
    ids, lists, n_turns = [], [], 0

    def emitted():
        rows = []
        for node in Shard(ids, lists).nodes():
            rows.append((ids[0], *node))
            if len(rows) == 10_000:
                yield _batch(rows, NODES)
                rows = []
        yield _batch(rows, NODES)

    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("conv_id", "digest", "n_bytes"))
        for conv, digest, n_bytes in zip(*columns, strict=True):
            if not ids or conv != ids[-1]:
                if n_turns >= SHARD_TURNS:
                    yield from emitted()
                    ids, lists, n_turns = [], [], 0
                ids.append(conv)
                lists.append([])
                n_turns += 1
            if digest is not None:
                lists[-1].append((digest, n_bytes))
                n_turns += 1
    if ids:
        yield from emitted()


def shard_nodes(turns_: DataFrame) -> DataFrame:
    """The trie of every shard, a row a node."""
    n_ranges = max(1, turns_.count() // RANGE_TURNS)
    dealt = turns_.repartitionByRange(n_ranges, "conv_id").sortWithinPartitions("conv_id", "place")
    return arrow_map(dealt, _walked, NODES)


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by shard and falling node, so that children come before their parents."""
    shard, leaves, saved = None, {}, {}
    for batch in batches:
        rows = []
        columns = (batch.column(c).to_pylist() for c in ("shard", "node", "parent", "key", "own_leaf", "own_saved"))
        for own, node, parent, key, leaf, save in zip(*columns, strict=True):
            if own != shard:
                shard, leaves, saved = own, {}, {}
            leaf, save = leaf + leaves.pop(node, 0), save + saved.pop(node, 0)
            leaves[parent] = leaves.get(parent, 0) + leaf
            saved[parent] = saved.get(parent, 0) + save
            rows.append((key, leaf, save))
        yield _batch(rows, SUMS)


def _ends_hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by key and range of conv_id; a list is hashed as it comes by."""
    key, sha, rows = None, None, []
    for batch in batches:
        for own, ends in zip(batch.column("key").to_pylist(), batch.column("ends"), strict=True):
            ids = np.frombuffer(ends.as_buffer(), np.int64)
            if own != key:
                if key is not None:
                    rows.append((key, sha.hexdigest()))
                key, sha = own, hashlib.sha256()
            else:
                sha.update(b",")
            sha.update(",".join(map(str, ids.tolist())).encode())
        yield _batch(rows, "key binary, ends_sha256 string")
        rows = []
    if key is not None:
        yield _batch([(key, sha.hexdigest())], "key binary, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node."""
    shards = stored(shard_nodes(stored(rebuilt(conversations))))
    nodes = shards.groupBy("key").agg(
        F.max("parent_key").alias("parent_key"),
        F.max("depth").alias("depth"),
        F.sum("n").alias("n_convs"),
        F.min("least").alias("conv_id"),
        F.max("n_bytes").alias("n_bytes"),
        F.min("shard").alias("owner"),
    )
    children = nodes.groupBy("parent_key").agg(F.count("*").alias("n_children"))
    children = children.select(F.col("parent_key").alias("c_key"), "n_children")
    nodes = stored(
        nodes.join(children, F.col("key") == F.col("c_key"), "left").drop("c_key").fillna(0, ["n_children"])
    )
    weights = nodes.select(
        F.col("key").alias("w_key"),
        "owner",
        (F.col("n_children") == 0).cast("long").alias("leaf"),
        ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved"),
    )
    owned = F.col("shard") == F.col("owner")
    weighed = shards.select("shard", "node", "parent", "key").join(weights, (F.col("key") == F.col("w_key")) & owned, "left")
    weighed = weighed.select(
        "shard", "node", "parent", "key", F.coalesce("leaf", F.lit(0)).alias("own_leaf"), F.coalesce("saved", F.lit(0)).alias("own_saved")
    )
    sums = arrow_map(weighed.repartition("shard").sortWithinPartitions("shard", F.col("node").desc()), _subtrees, SUMS)
    sums = sums.groupBy(F.col("key").alias("s_key")).agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    ends = shards.where("ends is not null").select("key", "shard", "ends")
    ends = arrow_map(ends.repartition("key").sortWithinPartitions("key", "shard"), _ends_hashed, "key binary, ends_sha256 string")
    ends = ends.withColumnRenamed("key", "e_key")
    parents = nodes.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    whole = nodes.join(sums, F.col("key") == F.col("s_key")).join(ends, F.col("key") == F.col("e_key"), "left")
    return lookup_join(whole, parents, ["parent_key"], "left").select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
