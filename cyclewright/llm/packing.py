"""Best-fit packing of tokenised documents into sequences, planned over a histogram of lengths.

Every text is tokenised whole, closed by an end id and cut into pieces where it is longer than a sequence. The plan
is best-fit decreasing, but over counts: all pieces of one length are placed together, into the fullest open
sequences that take them, and sequences that look alike are one interval of numbers. Its size depends on the
sequence length alone (at most that many lengths, three new intervals a length), never on the number of documents,
so that it is made on the driver and broadcast. The documents then take the planned slots by joining on their rank
within their length: ranks are counted in the task that tokenises, and a running sum over the tasks' counts makes
them global, so that no length, however frequent, is gathered anywhere.

Words (runs without white space) are tokenised once a task: the tokenizer must fold ASCII letters to lower case, keep
them together and apart from end marks, drop white space and have no rule that reaches over white space, so that the
ids of a text are the ids of its words in a row.

Defined results: a null text counts as empty, and an empty text is the end id alone; repeated rows are packed as
often as they stand; a null doc_id is a document like any other; ties in length are ranked by task and row; an empty
table gives no rows. A text of any length is read whole, a piece at a time in the result. Other columns are not read.
"""

from __future__ import annotations

import bisect
import itertools
import zlib
from collections import defaultdict
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cyclewright.llm.common import arrow_map, settled, stored

#: Ids of a sequence, and the id that ends a document.
SEQUENCE, END_ID = 4096, 1
#: Marks that the tokenizer parts from letters before them, and keeps together.
END_MARKS = ".,;:!?"
#: Ids of remembered words after which a task forgets them all, and words that are cut together.
KEPT_IDS, WORDS_TOGETHER = 4_000_000, 1_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, place long"


class WordIds:
    """Ids of texts, from remembered ids of their words and of the pieces that the tokenizer makes of words."""

    def __init__(self, tokenizer: Tokenizer):
        self.tokenizer = tokenizer
        self.special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        self._forget()

    def _forget(self) -> None:
        self.row_of: dict[str, int] = {"": 0}
        self.ids_of: dict[str, list[int]] = {}
        self.ids, self.first = np.empty(0, np.uint32), np.zeros(2, np.int64)

    def _whole(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch(words, add_special_tokens=False)]

    def _encoded(self, words: list[str]) -> list[list[int]]:
        """Ids of some words, by the tokenizer's own steps: normalised and cut together, merged once a piece."""
        normalizer, cutter = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        text = " ".join(words)
        if any(token in text for token in self.special):
            return self._whole(words)
        text = normalizer.normalize_str(text) if normalizer else text
        parts = text.split(" ")
        if len(parts) != len(words) or cutter is None:
            return self._whole(words)
        ends = np.cumsum([len(p) + 1 for p in parts])
        pieces = cutter.pre_tokenize_str(text)
        owners = np.searchsorted(ends, np.fromiter((at[0] for _, at in pieces), np.int64, len(pieces)), "right").tolist()
        out: list[list[int]] = [[] for _ in words]
        for (piece, _), owner in zip(pieces, owners, strict=True):
            out[owner] += self._merged(piece)
        return out

    def _merged(self, piece: str) -> list[int]:
        if (ids := self.ids_of.get(piece)) is None:
            ids = self.ids_of[piece] = [t.id for t in self.tokenizer.model.tokenize(piece)]
        return ids

    def _found(self, words: list[str]) -> list[list[int]]:
        """Ids of some words; ASCII letters, and end marks behind them, are a piece each."""
        out: list[list[int] | None] = []
        for word in words:
            stem = word.rstrip(END_MARKS)
            if stem.isascii() and stem.isalpha():
                out.append(self._merged(stem) + self._merged(word[len(stem) :]) if len(stem) < len(word) else self._merged(stem))
            else:
                out.append(None)
        others = []
        for i, ids in enumerate(out):
            if ids is None and words[i].split() == [words[i]]:
                others.append(i)
            elif ids is None:  # white space beyond ASCII: joined words could not be told apart
                out[i] = self._whole([words[i]])[0]
        for at in range(0, len(others), WORDS_TOGETHER):
            some = others[at : at + WORDS_TOGETHER]
            for i, ids in zip(some, self._encoded([words[i] for i in some]), strict=True):
                out[i] = ids
        return out

    def _rows(self, words: list[str]) -> np.ndarray:
        # ASCII words are compared in lower case, as the tokenizer reads them, unless they may hold a special token.
        words = [w.lower() if w.isascii() and "<|" not in w else w for w in words]
        if new := [w for w in dict.fromkeys(words) if w not in self.row_of]:
            found = self._found(new)
            self.row_of.update(zip(new, range(len(self.row_of), len(self.row_of) + len(new)), strict=True))
            lengths = np.fromiter(map(len, found), np.int64, len(found))
            flat = np.fromiter(itertools.chain.from_iterable(found), np.uint32, int(lengths.sum()))
            self.ids = np.concatenate([self.ids, flat])
            self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(lengths)])
        return np.fromiter(map(self.row_of.__getitem__, words), np.int64, len(words))

    def of(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each text."""
        if len(self.ids) > KEPT_IDS:
            self._forget()
        words = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
        coded = words.flatten().dictionary_encode()
        rows = self._rows(coded.dictionary.to_numpy(zero_copy_only=False).tolist())[coded.indices.to_numpy()]
        lengths = self.first[rows + 1] - self.first[rows]
        upto = np.concatenate([[0], np.cumsum(lengths)])
        ids = self.ids[np.repeat(self.first[rows] - upto[:-1], lengths) + np.arange(upto[-1])]
        edges = words.offsets.to_numpy()
        edges = upto[edges - edges[0]].tolist()
        for a, b in zip(edges, edges[1:], strict=False):
            yield ids[a:b]


def _pieces(model, sequence: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordIds(Tokenizer.from_str(model.value))
        part, seen = TaskContext.get().partitionId(), defaultdict(int)
        end = np.array([end_id], np.uint32)
        for batch in batches:
            rows = []
            texts = batch.column("text").fill_null("")
            for doc, ids in zip(batch.column("doc_id").to_pylist(), encoder.of(texts), strict=True):
                ids = np.concatenate([ids, end]).astype("<u4")
                for piece, start in enumerate(range(0, len(ids), sequence)):
                    own = ids[start : start + sequence]
                    rows.append((doc, piece, start, len(own), zlib.crc32(own.tobytes()), part, seen[len(own)]))
                    seen[len(own)] += 1
            columns = list(zip(*rows, strict=True)) or [()] * 7
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[f.split()[0] for f in PIECES.split(", ")]
            )

    return run


def pieces(docs: DataFrame, tokenizer: str, sequence: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece, with the task that made it and its place there.

    tokenizer: file of a tokenizer that drops white space; the driver reads it and sends it to the tasks.
    """
    model = docs.sparkSession.sparkContext.broadcast(Path(tokenizer).read_text(encoding="utf-8"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return arrow_map(rows, _pieces(model, sequence, end_id), PIECES)


def planned(counts: dict[int, int], sequence: int = SEQUENCE) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts: rows (length, rank, sequence_id, each, offset).

    From that rank on, pieces of that length fill sequences from that number on, `each` of them a sequence, the
    first at that offset; a row holds up to the next row of its length.
    """
    plan, n_sequences = [], 0
    room: dict[int, list[tuple[int, int]]] = {}  # free ids -> intervals (first number, count) of open sequences
    sizes: list[int] = []  # the keys of room, in order

    def opened(free: int, first: int, count: int) -> None:
        if free and count:
            if free not in room:
                room[free] = []
                bisect.insort(sizes, free)
            room[free].append((first, count))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect.bisect_left(sizes, length)
            if at < len(sizes):
                free = sizes[at]
                first, count = room[free].pop()
                if not room[free]:
                    del room[free], sizes[at]
            else:
                free, first = sequence, n_sequences
                count = -(-left // (sequence // length))
                n_sequences += count
            each = free // length
            full = min(count, left // each)
            if full:
                plan.append((length, rank, first, each, sequence - free))
                opened(free - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if left and full < count:  # the last pieces do not fill a sequence as far as the others
                plan.append((length, rank, first + full, left, sequence - free))
                opened(free - left * length, first + full, 1)
                rank, left, full = rank + left, 0, full + 1
            opened(free, first + full, count - full)
    return plan


def _placed(plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, rank, first, each, offset = plan.value
        starts = {int(v): (a, b) for v, a, b in zip(*_spans(length), strict=True)}
        for batch in batches:
            own, at = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            row = np.empty(len(own), np.int64)
            for v in np.unique(own).tolist():
                here, (a, b) = own == v, starts[v]
                row[here] = a + np.searchsorted(rank[a:b], at[here], "right") - 1
            nth = at - rank[row]
            columns = {name: batch.column(name) for name in ("doc_id", "piece", "start", "length", "ids_crc32")}
            columns["sequence_id"] = pa.array(first[row] + nth // each[row])
            columns["offset"] = pa.array(offset[row] + nth % each[row] * own)
            yield pa.RecordBatch.from_pydict(columns)

    return run


def _spans(length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each value of a column in order, and where its rows start and end."""
    values, first = np.unique(length, return_index=True)
    return values, first, np.append(first[1:], len(length))


def packed(docs: DataFrame, tokenizer: str, sequence: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    made = stored(pieces(docs, tokenizer, sequence, end_id))
    counts = settled(made.groupBy("length", "part").agg(F.count("*").alias("n")))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = sorted(planned(histogram, sequence))
    plan = [np.array([row[i] for row in plan], np.int64) for i in range(5)]
    # A row a task: the tasks' counts of one length in a row.
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")
    before = counts.select(F.col("length").alias("of_length"), F.col("part").alias("of_part"), before.alias("before"))
    ranked = made.join(before, (F.col("length") == F.col("of_length")) & (F.col("part") == F.col("of_part"))).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("place")).alias("rank")
    )
    return arrow_map(
        ranked,
        _placed(docs.sparkSession.sparkContext.broadcast(plan)),
        "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long",
    )
