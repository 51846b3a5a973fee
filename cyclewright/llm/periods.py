"""Periodic runs of words, as the maximal pairs of an LCP-interval tree.

A run of period q from word s to e is the pair of its suffixes at s and s + q: they agree on e - s - q words, not on
the next one, and the words before them differ. So runs are maximal pairs whose match is at least twice their distance,
and nothing is extended or scanned. The tree is built over suffixes that share LEAST_MATCH words with another suffix of
their document, as no other can be in such a pair: a rolling hash finds a superset of them in a batch of documents,
and the documents that have any are sorted by doubling, all together in numpy. The tree is walked bottom-up: an
interval holds its positions in text order, and a list of left words tells their class. Where the smaller of two
children joins the larger one, each of its positions meets its neighbours in text order: of all pairs at the interval's
depth a run's is made of neighbours, since an occurrence between them would give the run a smaller period. Neighbours
of one left-word class are no maximal pair. Of the pairs of one stretch (multiples of the period) the least stays.

A document is one record; a batch of short ones takes some 100 bytes a word, and a document with repeats another 8
bytes a word for each doubling of its longest repeat.

Defined results: a null text has no words; a null doc_id is never rewritten; a document without a run has four nulls;
repeated rows are returned as often as they stand; an empty table gives no rows. Texts are read whole, whatever their
length. Other columns are not read.
"""

from __future__ import annotations

import bisect
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cyclewright.llm.common import arrow_map, byte_texts

#: A run has at least this length, and at least this many times its period.
LEAST_LENGTH, LEAST_TIMES = 24, 3
#: So a pair agrees on at least this many words.
LEAST_MATCH = LEAST_LENGTH - LEAST_LENGTH // LEAST_TIMES
#: Words of documents that are searched together; one document may have more.
BATCH_WORDS = 500_000

RUNS = (
    "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
    "runs_sha256 string, collapsed_sha256 string"
)


def rewritten(doc_id: int | None, n: int) -> np.ndarray | None:
    """Numbers of the original words of a document of n words that is made periodic; None for all others."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    a, g = (h // 10) % n, h // 10
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % p
    return at


def suspects(codes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Numbers of documents in which LEAST_MATCH words in a row stand twice, and perhaps of a few others.

    codes and doc: code and document number of each word.
    """
    with np.errstate(over="ignore"):
        base, width = np.uint64(0x9E3779B97F4A7C15), 1
        window = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        window ^= window >> np.uint64(32)
        while width < LEAST_MATCH:
            if len(window) <= width:
                return np.empty(0, np.int64)
            window = window[:-width] * base + window[width:]
            base, width = base * base, 2 * width
        own = doc[: len(window)]
        window = (window ^ (own.astype(np.uint64) * np.uint64(0xA0761D6478BD642F)))[own == doc[width - 1 :]]
        own = own[own == doc[width - 1 :]]
    order = np.argsort(window)
    again = window[order[1:]] == window[order[:-1]]
    return np.unique(own[order[1:]][again])


def classes(codes: np.ndarray, doc: np.ndarray) -> list[np.ndarray]:
    """Level t: for each place the rank of its 2^t words among those of all places; the last level has no ties.

    Words of two documents never rank the same, so that no match reaches into the next document.
    """
    n = len(codes)
    _, first = np.unique(doc * (int(codes.max(initial=0)) + 1) + codes, return_inverse=True)
    levels = [first.astype(np.int32)]
    while int(levels[-1].max(initial=-1)) + 1 < n:
        width = 1 << (len(levels) - 1)
        # What lies behind the end differs for each place.
        behind = np.concatenate([levels[-1][width:].astype(np.int64), n + np.arange(min(width, n))])
        _, rank = np.unique(levels[-1].astype(np.int64) * (n + width) + behind, return_inverse=True)
        levels.append(rank.astype(np.int32))
    return levels


def _matches(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of words on which the suffixes at a and b agree."""
    n, total = len(levels[0]), np.zeros(len(a), np.int64)
    for t in range(len(levels) - 1, -1, -1):
        x, y = a + total, b + total
        inside = (x < n) & (y < n)
        same = levels[t][np.where(inside, x, 0)] == levels[t][np.where(inside, y, 0)]
        total[same & inside] += 1 << t
    return total


def _joined(large: list[int], small: list[int], left: list[int], depth: int, found: dict[tuple[int, int], int]) -> list[int]:
    """Both lists as one, in text order, with the runs among new neighbours added to found."""
    most = depth // (LEAST_TIMES - 1)

    def meet(i: int, j: int) -> None:
        if j - i <= most and j - i + depth >= LEAST_LENGTH and left[i] != left[j]:
            stretch = (i, j + depth)
            found[stretch] = min(j - i, found.get(stretch, j - i))

    new = set(small)  # two places of one child share more than the depth: no pair of this interval
    if len(small) * 8 > len(large):
        both = sorted(large + small)
        for i, j in zip(both, both[1:], strict=False):
            if (i in new) != (j in new):
                meet(i, j)
        return both
    for place in small:
        at = bisect.bisect(large, place)
        if at and large[at - 1] not in new:
            meet(large[at - 1], place)
        if at < len(large) and large[at] not in new:
            meet(place, large[at])
        large.insert(at, place)
    return large


def tree_runs(suffixes: np.ndarray, depths: np.ndarray, left: list[int]) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start and period.

    suffixes: places of a document in suffix order; depths: words that each shares with the next; left: code of the
    word before each place.
    """
    found: dict[tuple[int, int], int] = {}
    stack: list[tuple[int, list[int]]] = []  # open intervals: depth and positions in text order

    def close(upto: int) -> None:
        """Joins the open intervals that are deeper than that."""
        while len(stack) > 1 and stack[-2][0] > upto:
            _, top = stack.pop()
            depth, below = stack.pop()
            large, small = (below, top) if len(below) >= len(top) else (top, below)
            stack.append((depth, _joined(large, small, left, depth, found)))

    # An entry's depth is that which it shares with the entry above it.
    for place, depth in zip(suffixes.tolist(), depths.tolist(), strict=True):
        stack.append((0, [place]))
        close(depth)
        if depth < LEAST_MATCH:
            stack.clear()
        else:
            stack[-1] = (depth, stack[-1][1])
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda run: (run[0], run[2]))


def document_runs(codes: np.ndarray, doc: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
    """Runs of each document that has any, as (start, length, period) by start and period; starts count from its first word.

    codes and doc: code and document number of each word, documents one after another.
    """
    keep = np.isin(doc, suspects(codes, doc))
    codes, doc = codes[keep], doc[keep]
    if not len(codes):
        return {}
    levels = classes(codes, doc)
    order = np.empty(len(codes), np.int64)
    order[levels[-1]] = np.arange(len(codes))
    depths = np.append(_matches(levels, order[:-1], order[1:]), 0)
    del levels
    deep = depths >= LEAST_MATCH
    used = deep | np.append(False, deep[:-1])  # suffixes that share enough with a neighbour
    order, depths = order[used], depths[used]
    firsts = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    edges = np.searchsorted(doc[order], doc[firsts], "left").tolist() + [len(order)]
    ends = [*firsts[1:].tolist(), len(doc)]
    out = {}
    for k, (first, end) in enumerate(zip(firsts.tolist(), ends, strict=True)):
        part = slice(edges[k], edges[k + 1])
        if part.start < part.stop:
            left = [-1, *codes[first : end - 1].tolist()]
            if runs := tree_runs(order[part] - first, depths[part], left):
                out[int(doc[first])] = runs
    return out


def _row(doc_id, words: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    best = (None,) * 4
    if runs:
        s, n, q = runs[0]
        for start, length, period in runs[1:]:
            if length * q > n * period:
                s, n, q = start, length, period
        best = (s, n, q, 1000 * n // q)
        edges = np.zeros(len(words) + 1, np.int64)
        for start, length, period in runs:
            edges[start + period] += 1
            edges[start + length] -= 1
        words = [words[i] for i in np.flatnonzero(np.cumsum(edges[:-1]) == 0).tolist()]
    digests = (hashlib.sha256(x).hexdigest() for x in (lines.encode(), b" ".join(words)))
    return doc_id, len(runs), *best, *digests


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    fields = [f.split() for f in RUNS.split(", ")]
    kinds = [pa.int64() if k == "long" else pa.string() for _, k in fields]

    def emitted(ids, texts):
        sizes = [len(words) for words in texts]
        flat = pa.array([w for words in texts for w in words], pa.binary()).dictionary_encode()
        codes = flat.indices.to_numpy().astype(np.int64)
        runs = document_runs(codes, np.repeat(np.arange(len(sizes)), sizes))
        rows = [_row(i, words, runs.get(k, [])) for k, (i, words) in enumerate(zip(ids, texts, strict=True))]
        columns = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[n for n, _ in fields])

    for batch in batches:
        ids, texts, n_words = [], [], 0
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), byte_texts(batch.column("text")), strict=True):
            words = text.split()
            if (at := rewritten(doc_id, len(words))) is not None:
                words = [words[i] for i in at.tolist()]
            ids.append(doc_id)
            texts.append(words)
            n_words += len(words)
            if n_words >= BATCH_WORDS:
                yield emitted(ids, texts)
                ids, texts, n_words = [], [], 0
        if ids:
            yield emitted(ids, texts)


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256 of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return arrow_map(rows, _searched, RUNS)
