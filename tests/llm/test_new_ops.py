"""Prefix trie, best-fit packing and periodic runs against plain versions on small fixtures."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cyclewright.llm import packing, periods, prefixes

TURNS = "conv_id long, turn long, role string, text string"
DOCS = "doc_id long, text string"
MODEL = public_tokenizers.path("word_bpe_49k.json")


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- prefix trie ---------------------------------------------------------------------------------

NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def turn_key(role, text):
    role, text = role or "", text or ""
    return role, text, hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()


def plain_trie(turns):
    lists = defaultdict(list)
    for conv, turn, role, text in turns:
        if conv is not None:
            lists[conv].append((turn is not None, turn or 0, turn_key(role, text)))
    lists = {c: [k[:2] for *_, k in sorted(own, key=lambda x: (x[0], x[1], x[2][2]))] for c, own in lists.items()}
    built = {}
    for c, own in lists.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = tuple(lists.get(c - c % 5, [])[:h] + own[h:])
    members = defaultdict(list)
    for c, own in built.items():
        for d in range(len(own) + 1):
            members[own[:d]].append(c)
    out = []
    for node, convs in members.items():
        below = [n for n in members if n[: len(node)] == node]
        children = [n for n in below if len(n) == len(node) + 1]
        childless = [n for n in below if not any(len(m) == len(n) + 1 and m[: len(n)] == n for m in below)]
        saved = sum((len(members[n]) - 1) * len(n[-1][1].encode()) for n in below if n)
        ends = sorted(c for c in convs if built[c] == node)
        parent = min(members[node[:-1]]) if node else None
        out.append((min(convs), len(node), parent, len(convs), len(children), len(childless), saved, sha(",".join(map(str, ends)))))
    return sorted(out, key=repr)


def random_turns(seed, n=60):
    rng = random.Random(seed)
    texts = ["hi", "é ok", "", None, "bye", "x" * 3000]
    out = []
    for c in rng.sample(range(200), n):
        for t in range(rng.choice([1, 2, 3, 9, 14])):
            out.append((c, t, rng.choice(["user", "user", "assistant", None]), rng.choice(texts[: rng.choice([1, 2, 6])])))
    return out


ODD_TURNS = [
    (None, 1, "user", "lost"), (5, None, "user", "first"), (5, 1, None, None), (5, 1, "", ""), (5, 1, "user", "a"), (6, 2, "user", "b"),
    (7, 1, "ab", "c"), (7, 2, "a", "bc"), (9, 1, "user", None), (12, 3, "user", "only"), (12, 3, "user", "only"),
]


@pytest.mark.parametrize("turns", [random_turns(1), random_turns(2), ODD_TURNS, random_turns(3) + ODD_TURNS])
def test_trie_equals_plain(spark, turns, monkeypatch):
    monkeypatch.setattr(prefixes, "SHARD_TURNS", 40)
    monkeypatch.setattr(prefixes, "RANGE_TURNS", 100)
    df = spark.createDataFrame(turns, TURNS)
    df = df.withColumns({"key": F.lit("x"), "place": F.lit(1), "digest": F.lit("y"), "shard": F.lit(0)}).repartition(5)
    assert rows(prefixes.prefix_trie(df), *NODE) == plain_trie(turns)


def test_copies_of_one_conversation_in_many_shards_are_one_path(spark, monkeypatch, no_broadcast):
    monkeypatch.setattr(prefixes, "SHARD_TURNS", 50)
    monkeypatch.setattr(prefixes, "RANGE_TURNS", 200)
    turns = [(c, t, "user", f"turn {t}") for c in range(0, 2000, 5) for t in range(3)] + [(10_001, 9, "user", "end")]
    got = rows(prefixes.prefix_trie(spark.createDataFrame(turns, TURNS)), *NODE)
    assert got == plain_trie(turns)


def test_trie_of_a_long_conversation_and_of_nothing(spark):
    turns = [(1, t, "user", f"{t % 7}") for t in range(30_000)]
    got = prefixes.prefix_trie(spark.createDataFrame(turns, TURNS))
    assert got.agg(F.count("*"), F.max("depth"), F.sum("n_leaves")).first()[1] >= 29_990
    assert prefixes.prefix_trie(spark.createDataFrame([], TURNS)).count() == 0
    assert prefixes.prefix_trie(spark.createDataFrame([(None, 1, "user", "x")], TURNS)).count() == 0


# --- packing -------------------------------------------------------------------------------------

ODD_TEXTS = [
    "", None, "  a b ", "H̱ x", "<|endoftext|> A<|ENDOFTEXT|>b", "it's  I'LL don’t", "\x1cfoo\x85bar baz 　 q",
    "İ Σας ΣΑΣ", "é É", "\n\n", "abc... x!?; 12 a1b2, été.", "\U0001f600\U0001f600 zß",
]


def test_words_have_the_tokenizers_ids():
    model = Tokenizer.from_file(MODEL)
    rng = random.Random(4)
    letters = list("abcXYZéİΣ́'.,!<|>19 \t\n ")
    texts = ODD_TEXTS + ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(3000)]
    words = packing.WordIds(model)
    for part in (texts, texts[:500], *[[t] for t in texts[:200]]):
        words = packing.WordIds(model) if len(part) == 1 else words
        got = [ids.tolist() for ids in words.of(pa.array(part, pa.string()).fill_null(""))]
        assert got == [model.encode(t or "", add_special_tokens=False).ids for t in part]


def plain_best_fit(lengths, sequence):
    """Number of sequences of best-fit decreasing, a piece at a time."""
    free = []
    for length in sorted(lengths, reverse=True):
        fitting = [f for f in free if f >= length]
        if fitting:
            free.remove(min(fitting))
            free.append(min(fitting) - length)
        else:
            free.append(sequence - length)
    return len(free)


@pytest.mark.parametrize("seed", range(40))
def test_plan_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    sequence = rng.choice([7, 50, 4096])
    counts = {min(sequence, 1 + int(rng.paretovariate(0.5))): rng.randrange(1, 30) for _ in range(rng.randrange(1, 60))}
    plan = packing.planned(counts, sequence)
    filled = defaultdict(list)
    for length, count in counts.items():
        own = sorted(row for row in plan if row[0] == length)
        for at in range(count):
            _, rank, first, each, offset = [row for row in own if row[1] <= at][-1]
            filled[first + (at - rank) // each].append((offset + (at - rank) % each * length, length))
    for pieces in filled.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= sequence
    assert sorted(filled) == list(range(len(filled)))
    assert len(filled) == plain_best_fit([n for n, c in counts.items() for _ in range(c)], sequence)


def check_packing(texts, got, sequence):
    model = Tokenizer.from_file(MODEL)
    want = []
    for doc, text in texts:
        ids = model.encode(text or "", add_special_tokens=False).ids + [1]
        for piece, start in enumerate(range(0, len(ids), sequence)):
            own = ids[start : start + sequence]
            want.append((doc, piece, start, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
    assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(want, key=repr)
    filled = defaultdict(list)
    for r in got:
        filled[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in filled.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= sequence
    assert len(filled) == plain_best_fit([w[3] for w in want], sequence)


@pytest.mark.parametrize("sequence", [8, 64])
def test_every_piece_has_its_slot(spark, sequence, no_broadcast):
    rng = random.Random(9)
    texts = list(enumerate(ODD_TEXTS)) + [(None, "null id"), (3, "again"), (3, "again")]
    texts += [(100 + i, " ".join(f"w{rng.randrange(50)}" for _ in range(rng.randrange(40)))) for i in range(300)]
    texts += [(1000 + i, "same text") for i in range(400)] + [(5000, "long " * 20_000)]
    df = spark.createDataFrame(texts, DOCS).withColumns({"length": F.lit("x"), "rank": F.lit(1), "part": F.lit(2)}).repartition(7)
    check_packing(texts, packing.packed(df, MODEL, sequence).collect(), sequence)


def test_packing_of_nothing(spark):
    assert packing.packed(spark.createDataFrame([], DOCS), MODEL).count() == 0


# --- periodic runs -------------------------------------------------------------------------------


def plain_runs(w):
    found = {}
    for q in range(1, len(w) // 3 + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(24, 3 * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def plain_document(doc, text):
    w = (text or "").encode().split()
    n, h = len(w), zlib.crc32(str(doc).encode())
    if doc is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
    stats = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return doc, len(runs), *stats, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), hashlib.sha256(kept).hexdigest()


def periodic_text(rng):
    w = []
    for _ in range(rng.randrange(7)):
        size = rng.choice([1, 2, 3, 50])
        unit = [f"w{rng.randrange(size)}" for _ in range(rng.choice([1, 2, 3, 5, 8, 13]))]
        w += (unit * 20)[: rng.randrange(1, 120)]
        if rng.random() < 0.3:
            w = w + w[: rng.randrange(len(w))] + w * 2
    return rng.choice([" ", "\n", " \t"]).join(w[:700])


def test_runs_equal_plain(spark):
    rng = random.Random(11)
    texts = [(i, periodic_text(rng)) for i in range(250)] + [(i, None) for i in range(300, 320)]
    texts += [(None, "a b " * 30), (7, "a " * 30), (7, "a " * 30), (8, ""), (9, " \n"), (10, "x y " * 24), (400, "deep " * 3000)]
    df = spark.createDataFrame(texts, DOCS).withColumn("start", F.lit("x")).withColumn("n_runs", F.lit(1)).repartition(3)
    names = [f.split()[0] for f in periods.RUNS.split(", ")]
    assert rows(periods.periodic_runs(df), *names) == sorted((plain_document(*t) for t in texts), key=repr)


def test_runs_do_not_reach_into_the_next_document():
    docs = [[1, 2] * 11, [1, 2] * 11, [3] * 24, [3] * 23]
    codes, doc = np.array(sum(docs, [])), np.repeat(np.arange(4), [len(d) for d in docs])
    assert periods.document_runs(codes, doc) == {2: [(0, 24, 1)]}


def test_long_texts_of_one_period_and_of_frequent_lines():
    rng = np.random.default_rng(2)
    lines = [list(range(100 * k, 100 * k + 100)) for k in range(5)]
    for words in ([0] * 200_000, list(range(997)) * 200, sum((lines[k] for k in rng.integers(0, 5, 1500)), [])):
        runs = periods.document_runs(np.array(words), np.zeros(len(words), np.int64)).get(0, [])
        for s, length, q in runs:
            assert words[s : s + length - q] == words[s + q : s + length]
    assert periods.document_runs(np.zeros(200_000, np.int64), np.zeros(200_000, np.int64)) == {0: [(0, 200_000, 1)]}


def test_runs_of_nothing(spark):
    assert periods.periodic_runs(spark.createDataFrame([], DOCS)).count() == 0
