"""Secret scans: candidates by shape, false positives removed by a random forest.

Candidates are long tokens with a digit and values assigned to a name, each whole, however long. Their features are length, kinds of
characters, how often the kind changes, the mean log probability of their character transitions under the
corpus, the share of characters that dictionary words cover, words in the document's path and neighbouring words.
A random forest (Spark ML) trained on labelled findings gives each candidate its probability.

Findings are labelled by the caller, or else by rules that are sure of their case: provider formats and random
values under a credential's name against card numbers, plain numbers, placeholders and words. At most SAMPLE
findings of each label are used; transitions and the dictionary are counted over all documents.

Defined results: a null text has no candidates; a null path counts as empty; a value that stands several times is
reported at every place; where labelled findings hold one label only, that label's rate is the probability of all;
repeated rows report as often as they stand; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cyclewright.llm.common import arrow_map, kth_largest, seeded_sample, settled

#: Labelled findings of each label, words of the dictionary, and words a task counts before it sends its sums.
SAMPLE, DICTIONARY, TASK_WORDS = 10_000, 20_000, 300_000
TREES, DEPTH, SEED = 30, 6, 3
#: Probability from which a candidate is reported as a secret.
LEVEL = 0.5
#: Characters around a candidate that neighbouring words are looked for in.
NEIGHBOURHOOD = 48

CANDIDATE = re.compile(
    r"(?<![A-Za-z0-9_.-])(?P<name>[A-Za-z][A-Za-z0-9_.-]++)[\"']?[ \t]{0,3}(?:=|:=|:)[ \t]{0,3}(?P<quote>[\"']?)(?P<value>[^\s\"'<>,;(){}\[\]]{8,}+)"
    r"|(?<![A-Za-z0-9+/_-])(?P<token>[A-Za-z0-9+/_-]{16,}+={0,2})(?![A-Za-z0-9+/_=-])"
)
DIGIT = re.compile(r"\d")
# Names of credentials, words that speak against one, places of examples, and provider formats.
CREDENTIAL = re.compile(r"pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|apikey|auth|credential|bearer|private|access[_-]?key", re.I)
HARMLESS = re.compile(r"\b(?:sha\d*|md5|commit|hash|checksum|digest|uuid|guid|version|card|phone|isbn|order|invoice|tracking)\b", re.I)
EXAMPLE = re.compile(r"test|example|sample|mock|fixture|doc|demo", re.I)
PROVIDER = re.compile(
    r"(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35}|sk_live_[A-Za-z0-9]{16,}"
    r"|glpat-[A-Za-z0-9_-]{20}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"
)
PLACEHOLDER = re.compile(r"x{4,}|your|changeme|placeholder|dummy|\*{3,}|\.{3,}|example|<.*>", re.I)
UUID = re.compile(r"[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}", re.I)

FEATURES = (
    "length digits uppers lowers others hex entropy changes transition coverage longest_word assigned quoted named provider "
    "credential_near harmless_near placeholder number path_depth path_example"
).split()
#: Kinds of characters: a letter of 26 with case taken off, a digit, other.
KINDS = 28


def codes(text: bytes) -> np.ndarray:
    """Code of each byte for character transitions."""
    table = np.full(256, 27, np.int64)
    for i in range(26):
        table[65 + i] = table[97 + i] = i
    table[48:58] = 26
    return table[np.frombuffer(text, np.uint8)]


def corpus_counts(docs: DataFrame) -> tuple[np.ndarray, set[str]]:
    """Log probabilities of character transitions, and the most frequent words of three letters or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, words = np.zeros(KINDS * KINDS, np.int64), Counter()

        def sums(words):
            return pa.RecordBatch.from_arrays([pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for text in batch.column("text").to_pylist():
                if text:
                    at = codes(text.encode("utf-8", "surrogatepass"))
                    pairs += np.bincount(at[:-1] * KINDS + at[1:], minlength=KINDS * KINDS)
                    words.update(text.lower().split())
                    if len(words) > TASK_WORDS:
                        yield sums(words)
                        words.clear()
        yield sums(words)
        at = np.flatnonzero(pairs)
        yield pa.RecordBatch.from_arrays([pa.array([f"\n{i}" for i in at], pa.string()), pa.array(pairs[at])], names=["word", "n"])

    counted = arrow_map(docs.select("text"), run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counted = settled(counted.where(F.col("word").startswith("\n") | (F.col("word").rlike("^[a-z]{3,}$") & (F.col("n") > 1))))
    pairs = np.ones((KINDS, KINDS))  # as many rows as pairs of kinds
    for r in counted.where(F.col("word").startswith("\n")).collect():
        pairs.flat[int(r["word"][1:])] += r["n"]
    words = counted.where(~F.col("word").startswith("\n"))
    least = kth_largest(words.select(F.col("n").alias("key")), DICTIONARY)
    if least is not None:
        words = words.where(F.col("n") > least)  # words that tie with the last place stay out
    return np.log(pairs / pairs.sum(axis=1, keepdims=True)), set(words.select("word").toArrow()["word"].to_pylist())


def coverage(value: str, words: set[str]) -> tuple[float, int]:
    """Share of the characters that dictionary words cover, longest first from the left, and the longest word."""
    low, at, covered, longest = value.lower(), 0, 0, 0
    while at < len(low):
        for n in range(min(16, len(low) - at), 2, -1):
            if low[at : at + n] in words:
                covered, longest, at = covered + n, max(longest, n), at + n
                break
        else:
            at += 1
    return covered / len(low), longest


def luhn(digits: str) -> bool:
    total = sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits)))
    return total % 10 == 0


def candidates(text: str) -> Iterator[tuple[int, str, str, bool]]:
    """(start, value, name it is assigned to or '', quoted) of each candidate of a whole text."""
    for m in CANDIDATE.finditer(text):
        if (value := m["value"]) is not None:
            value = value.rstrip(".!?")
            if len(value) >= 8 and not value.startswith("//"):
                yield m.start("value"), value, m["name"], bool(m["quote"])
        elif DIGIT.search(m["token"]):
            yield m.start("token"), m["token"], "", False


def described(text: str, start: int, value: str, name: str, quoted: bool, path: str, logs: np.ndarray, words: set[str]) -> dict[str, float]:
    """Features of a candidate."""
    n = len(value)
    near = text[max(0, start - NEIGHBOURHOOD) : start] + " " + text[start + n : start + n + NEIGHBOURHOOD]
    kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "o" for c in value]
    counts = Counter(value)
    at = codes(value.encode("utf-8", "surrogatepass"))
    covered, longest = coverage(value, words)
    share = Counter(kinds)
    values = (
        n, share["d"] / n, share["u"] / n, share["l"] / n, share["o"] / n,
        all(c in "0123456789abcdefABCDEF" for c in value),
        -sum(c / n * math.log2(c / n) for c in counts.values()),
        sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / n,
        float(logs[at[:-1], at[1:]].mean()) if len(at) > 1 else 0.0,
        covered, longest, bool(name), quoted, bool(name and CREDENTIAL.search(name)), bool(PROVIDER.fullmatch(value)),
        bool(CREDENTIAL.search(near)), bool(HARMLESS.search(near)), bool(PLACEHOLDER.search(value)), value.isdigit(),
        path.count("/"), bool(EXAMPLE.search(path)),
    )
    return dict(zip(FEATURES, map(float, values), strict=True))


def sure_label(value: str, f: dict[str, float]) -> int | None:
    """1 or 0 where a rule is sure of the case."""
    if f["placeholder"] or f["number"] or UUID.fullmatch(value) or f["coverage"] >= 0.8 or (value.isdigit() and luhn(value)):
        return 0
    if f["provider"] or f["named"] and f["digits"] > 0 and f["coverage"] < 0.5 and f["entropy"] >= 2.5:
        return 1
    return 0 if f["harmless_near"] else None


def findings(docs: DataFrame, path: str = "source") -> DataFrame:
    """doc_id, start, value, the features, and label (of the sure rules, else null) of each candidate."""
    logs, words = corpus_counts(docs)
    shared = docs.sparkSession.sparkContext.broadcast((logs, words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs, words = shared.value
        for batch in batches:
            rows = []
            texts, paths = batch.column("text").to_pylist(), batch.column("path").to_pylist()
            for doc, text, at in zip(batch.column("doc_id").to_pylist(), texts, paths, strict=True):
                for start, value, name, quoted in candidates(text or ""):
                    f = described(text, start, value, name, quoted, at or "", logs, words)
                    rows.append({"doc_id": doc, "start": start, "value": value, "label": sure_label(value, f)} | f)
            yield pa.RecordBatch.from_pylist(rows, kinds)

    kinds = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("value", pa.string()), ("label", pa.int32()), *[(f, pa.float64()) for f in FEATURES]])
    columns = "doc_id long, start long, value string, label int, " + ", ".join(f"{f} double" for f in FEATURES)
    where = F.col(path).cast("string") if path in docs.columns else F.lit("")
    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", where.alias("path")), run, columns)


def training_rows(labelled: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """At most `sample` findings of each label, distinct, in seeded order in one partition, so that reruns agree.

    Only they go to one task: the distinct rows are found and sampled in the tasks before.
    """
    rows = labelled.where("label is not null").select("label", *FEATURES).distinct()
    order = F.xxhash64(F.lit(SEED), *FEATURES)
    parts = [seeded_sample(rows.where(F.col("label") == x), order, sample) for x in (0, 1)]
    return parts[0].unionByName(parts[1]).repartition(1).sortWithinPartitions(order, *FEATURES, "label")


def scanned(docs: DataFrame, labelled: DataFrame | None = None, path: str = "source", level: float = LEVEL) -> DataFrame:
    """doc_id, start, n_chars, provider, probability, is_secret of each candidate of every row.

    labelled: findings with label 0 or 1 and the features, as `findings` gives them; None takes the sure rules'.
    """
    found = settled(findings(docs, path))
    rows = settled(training_rows(found if labelled is None else labelled))
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if counts.get(0) and counts.get(1):
        gather = VectorAssembler(inputCols=FEATURES, outputCol="features")
        forest = RandomForestClassifier(labelCol="label", featuresCol="features", numTrees=TREES, maxDepth=DEPTH, seed=SEED)
        model = forest.fit(gather.transform(rows).select("label", "features"))
        found = model.transform(gather.transform(found)).withColumn("likely", vector_to_array("probability")[1])
    else:
        found = found.withColumn("likely", F.lit(1.0 if counts.get(1) else 0.0))
    return found.select(
        "doc_id", "start", F.length("value").cast("long").alias("n_chars"), (F.col("provider") == 1).alias("provider"),
        F.col("likely").alias("probability"), (F.col("likely") >= level).alias("is_secret"),
    )
