"""Benchmark decontamination by CGK embedding, bit-sampling LSH and exact edit verification.

The CGK embedding walks a word sequence: at step t it writes the current word and moves on or stays, as a
random bit of (t, word) says. Sequences within a small edit distance keep walking in step, so their
embeddings are within a small Hamming distance. A repetition samples some steps of a walk; the sampled words
are a key. Windows of the documents start at every word, and the windows of an item at every word of it, so an
intact stretch anywhere in a leaked passage can meet the item's key and names the start of the item-sized
window. Candidate windows pass a bag-of-words bound that loses nothing and then an exact word edit distance
(bit-parallel, free start and end). Items too short for walks of several words are cut into one part more than the
edits that they may have: one part of a leak is intact, and an index of the parts finds all of them.

A passage leaks if at most a fifth of the item's words must be edited, so none of fewer than five. Words are `\\w+` of
the lower-case text.

Defined results: null and empty texts have no words and no matches, as items or as documents; items of one word leak
wherever that word stands; of several windows of one item in a row the nearest and then first is
reported; repeated rows report as often as they stand, repeated items under each of their ids; texts are read whole, whatever their length; empty tables give
no rows. Only doc_id, item_id and the texts are read.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cyclewright.llm.common import arrow_map

#: Least similarity: 1 - edits / words of the item.
SIMILARITY = 0.8
#: Items of at most this many words are found by their parts, which have three words or more where edits are allowed
#: to items of ten.
PARTED_WORDS = 14
#: Steps of each repetition's walk. Items too short for all of them draw walks of SHORT_WALK steps, MORE_WALKS at most.
WALKS, SHORT_WALK, MORE_WALKS = (8, 9, 10, 12, 14), 7, 64
#: Sampled steps of a repetition, and the different words that they must stand on.
SAMPLED, LEAST_DIFFERENT = 5, 4
SEED = 7
#: Words of the items that one broadcast holds; more items take further passes.
BLOCK_WORDS = 2_000_000

#: End marks between texts, so that no walk reaches the next text.
PAD = max(*WALKS, SHORT_WALK) + 1
#: Of keys of phrases.
PHRASE_FACTOR = np.int64(0x5851F42D4C957F2D)
WORD = re.compile(r"\w+")
MATCHES = "doc_id long, item_id long, start_word long, item_words long, edits long, similarity double"


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def allowed_edits(n_words: int, similarity: float = SIMILARITY) -> int:
    return int(n_words * (1 - similarity) + 1e-9)


class Items:
    """A block of items, coded and keyed for every repetition."""

    def __init__(self, rows: list[tuple[int, str | None]], similarity: float = SIMILARITY):
        self.ids, words = [], []
        for item, text in rows:
            own = words_of(text)
            if own:
                self.ids.append(item)
                words.append(own)
        self.code = {w: i + 1 for i, w in enumerate(sorted({w for own in words for w in own}))}
        self.words = [np.array([self.code[w] for w in own], np.int32) for own in words]
        self.edits = [allowed_edits(len(own), similarity) for own in words]
        self.end = len(self.code) + 1  # stands after the last word of a text
        rng = np.random.default_rng(SEED)
        self.walks, self.keys = [], []
        lengths = [len(w) for w in self.words]
        joined = self.joined(self.words)
        begin = np.r_[0, np.cumsum(np.array(lengths, np.int64) + PAD)][: len(lengths)]
        owner = np.repeat(np.arange(len(lengths)), lengths)
        offset = np.concatenate([np.zeros(0, np.int64), *map(np.arange, lengths)])
        at = begin[owner] + offset
        long = np.array(lengths, np.int64)[owner] > PARTED_WORDS
        owner, offset, at = owner[long], offset[long], at[long]
        self.parts = self.parted(joined, begin)
        for steps in WALKS + (SHORT_WALK,) * MORE_WALKS:
            if len(self.walks) >= len(WALKS):
                # Only items without a key so far take part in further walks.
                bare = ~np.isin(owner, np.concatenate([k[1] for k in self.keys]))
                owner, offset, at = owner[bare], offset[bare], at[bare]
                if not len(owner):
                    break
            moves = rng.integers(0, 2, (steps, self.end + 1), dtype=np.int8)
            picked = frozenset(np.sort(rng.choice(steps, SAMPLED, replace=False)).tolist())
            self.walks.append((moves, picked, rng.integers(1, 1 << 62, SAMPLED, dtype=np.int64) | 1))
            found, keys = self.embedded(joined, at, len(self.walks) - 1)
            order = np.argsort(keys, kind="stable")
            seen = np.zeros(1 << 22, bool)
            seen[keys & ((1 << 22) - 1)] = True
            self.keys.append((keys[order], owner[found][order], offset[found][order], seen))
        self.patterns = []
        for own in self.words:
            bits: dict[int, int] = defaultdict(int)
            for i, w in enumerate(own.tolist()):
                bits[w] |= 1 << i
            self.patterns.append(dict(bits))

    @classmethod
    def of(cls, arrays: dict) -> Items:
        """The block that has these attributes."""
        block = cls.__new__(cls)
        vars(block).update(arrays)
        return block

    def parted(self, joined: np.ndarray, begin: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Parts of the short items by their length: keys in order, and the item and place of each."""
        found: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for item, own in enumerate(self.words):
            if len(own) <= PARTED_WORDS:
                n_parts = min(self.edits[item] + 1, len(own))
                edges = [len(own) * i // n_parts for i in range(n_parts + 1)]
                for a, b in zip(edges, edges[1:], strict=False):
                    found[b - a].append((item, a))
        out = {}
        for width, parts in found.items():
            owner, offset = np.array(parts, np.int64).T
            _, keys = self.phrases(joined, begin[owner] + offset, width)
            order = np.argsort(keys, kind="stable")
            out[width] = keys[order], owner[order], offset[order]
        return out

    def phrases(self, joined: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the starts at which `width` words of items stand in a row, and keys of those words."""
        live, keys = np.arange(len(starts)), np.zeros(len(starts), np.int64)
        for k in range(width):
            now = joined[starts[live] + k]
            kept = (now > 0) & (now < self.end)
            live, keys = live[kept], keys[kept] * PHRASE_FACTOR + now[kept]
        return live, keys

    def joined(self, texts: list[np.ndarray]) -> np.ndarray:
        """All texts in a row, each followed by end marks."""
        gap = np.full(PAD, self.end, np.int32)
        return np.concatenate([x for own in texts for x in (own, gap)]) if texts else gap

    def embedded(self, joined: np.ndarray, starts: np.ndarray, r: int) -> tuple[np.ndarray, np.ndarray]:
        """Places in `starts` whose sampled words are words of items and different enough, and their keys."""
        moves, picked, factors = self.walks[r]
        live, at, keys, n = np.arange(len(starts)), starts.copy(), np.zeros(len(starts), np.int64), 0
        last, different = np.full(len(starts), -1), np.zeros(len(starts), np.int8)
        for t in range(len(moves)):
            now = joined[at]
            if t in picked:
                kept = np.flatnonzero((now > 0) & (now < self.end))
                live, at, keys, now, last, different = live[kept], at[kept], keys[kept], now[kept], last[kept], different[kept]
                keys += now * factors[n]
                keys ^= keys >> 29
                different += at > last
                last, n = at.copy(), n + 1
                if n == SAMPLED or not len(at):
                    break
            at += moves[t][now]
        good = different >= LEAST_DIFFERENT
        return live[good], keys[good]

    def candidates(self, joined: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item, start of the item-sized window in `joined`), without repeats."""
        items, windows = [], []

        def meet(keys, owner, offset, live, got):
            low = np.searchsorted(keys, got, "left")
            n = np.searchsorted(keys, got, "right") - low
            which = np.repeat(low - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(int(n.sum()))
            items.append(owner[which])
            windows.append(starts[np.repeat(live, n)] - offset[which])

        for width, (keys, owner, offset) in self.parts.items():
            live, got = self.phrases(joined, starts, width)
            if len(got):
                meet(keys, owner, offset, live, got)
        for r, (keys, owner, offset, seen) in enumerate(self.keys):
            live, got = self.embedded(joined, starts, r)
            likely = np.flatnonzero(seen[got & ((1 << 22) - 1)])
            if len(likely):
                meet(keys, owner, offset, live[likely], got[likely])
        if not items:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        longest = max(map(len, self.words))
        span = len(joined) + longest
        pairs = np.unique(np.concatenate(items) * span + np.concatenate(windows) + longest)
        return pairs // span, pairs % span - longest

    def distance(self, item: int, text: list[int]) -> tuple[int, int]:
        """Least word edits between the item and a stretch of the text, and the end of the first such stretch."""
        pattern, m = self.patterns[item], len(self.words[item])
        full, top = (1 << m) - 1, 1 << (m - 1)
        plus, minus, score = full, 0, m
        best, end = m, 0
        for j, word in enumerate(text):
            eq = pattern.get(word, 0)
            xv = eq | minus
            xh = (((eq & plus) + plus) ^ plus) | eq
            up, down = minus | ~(xh | plus) & full, plus & xh
            if up & top:
                score += 1
            elif down & top:
                score -= 1
            up, down = (up << 1) & full, (down << 1) & full
            plus, minus = down | ~(xv | up) & full, up & xv
            if score < best:
                best, end = score, j + 1
        return best, end

    def matches(self, texts: list[list[str]]) -> list[tuple[int, int, int, int, int]]:
        """(text, item, start word, words of the item, edits) of the nearest window of each pair that leaks."""
        get = self.code.get
        coded = [np.fromiter(map(get, own, repeat(0)), np.int32, len(own)) for own in texts]
        joined = self.joined(coded)
        sizes = np.array([len(c) for c in coded], np.int64)
        begin = np.concatenate([[0], np.cumsum(sizes + PAD)[:-1]]).astype(np.int64) if len(sizes) else sizes
        starts = np.flatnonzero(joined != self.end)
        items, windows = self.candidates(joined, starts)
        out: dict[tuple[int, int], tuple[int, int]] = {}
        for item in np.unique(items):
            m, e = len(self.words[item]), self.edits[item]
            own = windows[items == item]
            # A window that starts before its text belongs to the text in which its inner words stand.
            text = np.searchsorted(begin, own + m // 2, "right") - 1
            text = np.where(own < begin[np.maximum(text, 0)] - m, -1, text)
            low = np.maximum(own - e, begin[np.maximum(text, 0)])
            high = np.minimum(own + m + e, begin[np.maximum(text, 0)] + sizes[np.maximum(text, 0)])
            inside = (text >= 0) & (high - low >= m - e)
            text, low, high = text[inside], low[inside], high[inside]
            member = np.zeros(self.end + 1, bool)
            member[self.words[item]] = True
            own_text = np.concatenate([np.zeros(0, np.int64), *[np.arange(a, b) for a, b in zip(low.tolist(), high.tolist(), strict=True)]])
            sums = np.r_[0, np.cumsum(member[joined[own_text]])]
            stops = np.cumsum(high - low)
            rich = sums[stops] - sums[stops - (high - low)] >= m - e
            for t, a, b in zip(text[rich].tolist(), low[rich].tolist(), high[rich].tolist(), strict=True):
                edits, end = self.distance(item, joined[a:b].tolist())
                if edits <= e:
                    near = (edits, max(0, a - begin[t] + end - m))
                    out[t, int(item)] = min(out.get((t, int(item)), near), near)
        return [(t, i, int(start), len(self.words[i]), int(edits)) for (t, i), (edits, start) in sorted(out.items())]


def item_blocks(items: DataFrame, block_words: int = BLOCK_WORDS) -> Iterator[list[tuple[int, str | None]]]:
    """The items in blocks of about `block_words` words, so that what is broadcast has a bound."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = 1 + total // (4 * block_words)
    for block in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        yield [(r["item_id"], r["text"]) for r in part.collect()]


def leaks(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, item_id, start_word, item_words, edits, similarity of every leaked item of every row."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = None
    for rows in item_blocks(items, block_words):
        part = arrow_map(texts, _leak_rows(_index(docs, rows, similarity)), MATCHES)
        found = part if found is None else found.unionByName(part)
    return found


def _index(docs: DataFrame, rows: list[tuple[int, str | None]], similarity: float):
    """A block of items, indexed once and sent to all tasks as plain arrays."""
    return docs.sparkSession.sparkContext.broadcast(vars(Items(rows, similarity)))


def _leak_rows(index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Items.of(index.value)
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            got = block.matches([words_of(t) for t in batch.column("text").to_pylist()])
            out = [(ids[t], block.ids[i], start, m, edits, 1 - edits / m) for t, i, start, m, edits in got]
            yield pa.RecordBatch.from_pylist(
                [dict(zip([f.split()[0] for f in MATCHES.split(", ")], r, strict=True)) for r in out],
                pa.schema([(f.split()[0], pa.int64() if f.endswith("long") else pa.float64()) for f in MATCHES.split(", ")]),
            )

    return run


def without_leaks(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of docs in which no item leaks, with all their columns and without a shuffle."""
    for rows in item_blocks(items, block_words):
        docs = arrow_map(docs, _clean_rows(_index(docs, rows, similarity)), docs.schema)
    return docs


def _clean_rows(index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Items.of(index.value)
        for batch in batches:
            clean = np.ones(batch.num_rows, bool)
            clean[[m[0] for m in block.matches([words_of(t) for t in batch.column("text").to_pylist()])]] = False
            yield batch.filter(pa.array(clean))

    return run
