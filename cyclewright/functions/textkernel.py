"""Text measures in Arrow batches: a batch's tokens become integer codes once, everything else is array work.

Three readings of a text give tokens: white-space tokens, the same within sentences, and runs of letters and
digits. Each reading is split by C code, coded by one dictionary a slice of the batch, and sorted at most once; time
is n log n in the words and memory some 200 bytes a word of a slice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cyclewright.session import small_batches
from cyclewright.settings import MATTR_WINDOW

#: Measures and their types. All are of the whole text; a null text counts as empty.
MEASURES = {
    "word_count": "int",
    "avg_word_length": "double",
    "unique_word_fraction": "double",
    "sentences": "int",
    "avg_words_per_sentence": "double",
    "reading_grade": "double",
    "cohesion": "double",
    "mattr": "double",
    "words": "array<string>",
    "counts": "array<int>",
}
#: Characters of the texts that are measured together; one text may have more.
SLICE_CHARS = 1_000_000

ONE_MARK = str.maketrans("!?", "..")
VOWELS = "[aeiouy]+"
NOT_ALPHANUMERIC = r"[^\p{L}\p{N}]+"


class Tokens:
    """Tokens of several owners (texts or sentences) as codes of one dictionary; empty tokens are left out."""

    def __init__(self, lists: pa.ListArray):
        coded = lists.flatten().dictionary_encode()
        self.dictionary = coded.dictionary
        codes = coded.indices.to_numpy().astype(np.int64)
        owner = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
        empty = pc.index(self.dictionary, pa.scalar("", self.dictionary.type)).as_py()
        kept = codes != empty
        self.codes, self.owner = codes[kept], owner[kept]
        self.sizes = np.bincount(self.owner, minlength=len(lists))
        self.width = max(len(self.dictionary), 1)
        self._keys = self.owner * self.width + self.codes

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """(owner, code) pairs as sorted numbers owner * width + code, and how often each stands."""
        return np.unique(self._keys, return_counts=True)

    def previous(self) -> np.ndarray:
        """Place within the owner at which each token stood last, -1 at its first."""
        starts = np.cumsum(self.sizes) - self.sizes
        place = np.arange(len(self.codes)) - np.repeat(starts, self.sizes)
        order = np.argsort(self._keys, kind="stable")
        before = np.full(len(order), -1, np.int64)
        same = self._keys[order[1:]] == self._keys[order[:-1]]
        before[order[1:][same]] = place[order[:-1][same]]
        return before

    def totals(self, weights: np.ndarray) -> np.ndarray:
        """Sum of a weight of each token by owner; weights are whole numbers, so that the sums are exact."""
        return np.bincount(self.owner, weights, len(self.sizes))


def _ratio(a: np.ndarray, b: np.ndarray, otherwise: float) -> np.ndarray:
    return np.divide(a, b, out=np.full(len(b), otherwise, np.float64), where=b > 0)


def _moving_ratio(tokens: Tokens, window: int) -> np.ndarray:
    """Mean share of distinct tokens over all windows, NaN without tokens.

    A token at place i adds one distinct word to every window that covers i and not the token's previous place.
    """
    n = tokens.sizes
    span = np.minimum(n, window)
    last_start = n - span
    starts = np.repeat(np.cumsum(n) - n, n)
    i = np.arange(len(tokens.codes)) - starts
    first = np.maximum(np.maximum(i - np.repeat(span, n) + 1, tokens.previous() + 1), 0)
    last = np.minimum(i, np.repeat(last_start, n))
    return _ratio(tokens.totals(np.maximum(last - first + 1, 0)), (last_start + 1) * span, np.nan)


def _overlap(sentences: Tokens, text: np.ndarray, n_sentences: np.ndarray) -> np.ndarray:
    """Mean Jaccard overlap of neighbouring sentences of each text, NaN with fewer than two.

    sentences, text: tokens of the parts between marks, blank ones too, and the text of each part.
    """
    keys, _ = sentences.distinct()
    places = np.flatnonzero(sentences.sizes)  # the parts that are not blank
    number = np.cumsum(sentences.sizes > 0) - 1
    text, width = text[places], sentences.width
    keys = number[keys // width] * width + keys % width
    sizes = np.bincount(keys // width, minlength=len(places))
    # A word of the next sentence has the same code one width on.
    at = np.minimum(np.searchsorted(keys, keys + width), max(len(keys) - 1, 0))
    common = np.bincount(keys[keys[at] == keys + width] // width, minlength=len(places))[:-1]
    inside = text[1:] == text[:-1]
    share = common[inside] / (sizes[:-1] + sizes[1:] - common)[inside]
    total = np.bincount(text[:-1][inside], share, len(n_sentences))
    return _ratio(total, n_sentences - 1, np.nan)


def measured(texts: list[str], names: tuple[str, ...], window: int = MATTR_WINDOW) -> dict[str, pa.Array]:
    """The named measures of each text."""
    need = set(names).intersection
    out: dict[str, pa.Array | np.ndarray] = {}
    lowered = [t.lower() for t in texts]
    low = pa.array(lowered, pa.large_string())
    if need({"word_count", "avg_word_length", "unique_word_fraction", "reading_grade", "words", "counts"}):
        tokens = Tokens(pc.utf8_split_whitespace(low))
        out["word_count"] = tokens.sizes
    if "avg_word_length" in names:
        letters = tokens.totals(pc.utf8_length(tokens.dictionary).to_numpy()[tokens.codes])
        for i, (text, small) in enumerate(zip(texts, lowered, strict=True)):
            if len(text) != len(small):  # a few letters are longer in lower case
                letters[i] = len("".join(text.split()))
        out["avg_word_length"] = _ratio(letters, tokens.sizes, 0.0)
    if need({"unique_word_fraction", "words", "counts"}):
        keys, counts = tokens.distinct()
        distinct = np.bincount(keys // tokens.width, minlength=len(texts))
        out["unique_word_fraction"] = _ratio(distinct, tokens.sizes, 0.0)
    if need({"words", "counts"}):
        edges = pa.array(np.concatenate([[0], np.cumsum(distinct)]), pa.int32())
        words = tokens.dictionary.take(pa.array(keys % tokens.width)).cast(pa.string())
        out["words"] = pa.ListArray.from_arrays(edges, words)
        out["counts"] = pa.ListArray.from_arrays(edges, pa.array(counts, pa.int32()))
    if need({"sentences", "avg_words_per_sentence", "reading_grade", "cohesion"}):
        parts = pc.split_pattern(pa.array([t.translate(ONE_MARK) for t in lowered], pa.large_string()), ".")
        sentences = Tokens(pc.utf8_split_whitespace(parts.flatten()))
        text = np.repeat(np.arange(len(texts)), parts.value_lengths().to_numpy())
        n_sentences = np.bincount(text[sentences.sizes > 0], minlength=len(texts))
        out["sentences"] = n_sentences
        inside = np.bincount(text, sentences.sizes, len(texts))
        out["avg_words_per_sentence"] = _ratio(inside, n_sentences, 0.0)
    if "reading_grade" in names:
        # Published Flesch-Kincaid formula with vowel groups as syllables, at least one a word.
        groups = np.maximum(pc.count_substring_regex(tokens.dictionary, VOWELS).to_numpy(), 1)
        syllables = tokens.totals(groups[tokens.codes])
        grade = _ratio(tokens.sizes, n_sentences, np.nan) * 0.39 + _ratio(syllables, tokens.sizes, np.nan) * 11.8 - 15.59
        out["reading_grade"] = np.nan_to_num(grade, nan=0.0)
    if "cohesion" in names:
        out["cohesion"] = _overlap(sentences, text, n_sentences)
    if "mattr" in names:
        out["mattr"] = _moving_ratio(Tokens(pc.split_pattern_regex(low, NOT_ALPHANUMERIC)), window)
    arrow = {"int": pa.int32(), "double": pa.float64()}
    return {
        n: pa.array(out[n], arrow[MEASURES[n]], from_pandas=True) if isinstance(out[n], np.ndarray) else out[n] for n in names
    }


def _slices(texts: pa.Array, most: int) -> Iterator[list[str]]:
    own, n_chars = [], 0
    for value in texts:
        text = value.as_py() or ""
        own.append(text)
        n_chars += len(text)
        if n_chars >= most:
            yield own
            own, n_chars = [], 0
    if own:
        yield own


def text_measures(text: Column, *names: str, window: int = MATTR_WINDOW) -> Column:
    """A struct of the named measures of a text; reading several from one struct reads the text once."""
    if absent := [n for n in names if n not in MEASURES]:
        raise KeyError(f"no such measures: {absent}")
    kinds = ", ".join(f"{n}: {MEASURES[n]}" for n in names)

    @F.arrow_udf(f"struct<{kinds}>")
    def measures(batch: pa.Array) -> pa.Array:
        parts = [measured(s, names, window) for s in _slices(batch, SLICE_CHARS)]
        parts = parts or [measured([], names, window)]
        columns = [pa.concat_arrays([p[n] for p in parts]) for n in names]
        return pa.StructArray.from_arrays(columns, names=list(names))

    return measures(text)


def with_measures(df: DataFrame, text: str, *names: str, window: int = MATTR_WINDOW) -> DataFrame:
    """The rows with the named measures as columns instead of the text.

    A slice of the texts leaves as a batch of its own, so that a task holds one slice's words and not those of all
    texts of a batch; batches are small, so that it doesn't hold many texts either.
    """
    small_batches(df.sparkSession)
    kept = [c for c in df.columns if c != text and c not in names]
    measures = T.StructType.fromDDL(", ".join(f"{n} {MEASURES[n]}" for n in names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, at = batch.select(kept), 0
            for part in _slices(batch.column("__text"), SLICE_CHARS):
                found = measured(part, names, window)
                columns = [*own.slice(at, len(part)).columns, *[found[n] for n in names]]
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, *names])
                at += len(part)

    rows = df.select(*kept, F.col(text).alias("__text"))
    return rows.mapInArrow(run, T.StructType([*df.select(kept).schema.fields, *measures.fields]))
