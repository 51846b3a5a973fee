"""Exact groups, SimHash groups and repeated passages against plain versions on small fixtures."""

import hashlib
import random
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from cyclewright.llm import exact_dedup, passages, simhash
from cyclewright.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts, schema=DOCS):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts], schema)


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def words(n, rng, size=400):
    return [f"w{rng.randrange(size)}" for _ in range(n)]


# --- exact groups --------------------------------------------------------------------------------


def plain_exact(texts):
    groups = {}
    for i, t in texts:
        groups.setdefault(re.sub(r"[ \t-\r]+", " ", t or ""), []).append(i)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep, first = (min(known) if known else None), True
        for i in sorted(ids, key=lambda i: (i is None, i)):
            out.append((i, keep, len(ids), first, hashlib.sha256(text.encode()).hexdigest()))
            first = False
    return sorted(out, key=repr)


EXACT = [
    (5, "a  b\tc"), (3, "a b c"), (9, "a b c "), (4, None), (2, ""), (7, " "), (8, "\n\n"), (3, "a b\nc"), (None, "a b c"),
    (None, "solo"), (11, "é" * 40_000), (12, "é" * 40_000), (13, "é" * 40_000 + "x"), (20, "y" * 70_000 + " z"), (21, "y" * 70_000 + "\n z"),
]
COLUMNS = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def test_exact_groups_equal_plain(spark):
    assert rows(exact_dedup.exact_groups(frame(spark, EXACT)), *COLUMNS) == plain_exact(EXACT)


def test_equal_fingerprints_of_unequal_texts_are_told_apart(spark):
    rng = random.Random(1)
    texts = [(i, " ".join(words(2, rng, 12))) for i in range(60)]
    weak = ((7, 3), (1, 1))  # seven values in all
    assert rows(exact_dedup.exact_groups(frame(spark, texts), weak), *COLUMNS) == plain_exact(texts)


def test_chunks_combine_to_the_hash_of_the_whole():
    hasher = exact_dedup.Hasher(exact_dedup.MODULI)
    text = bytes(random.Random(2).randrange(256) for _ in range(2 * exact_dedup.CHUNK + 777))
    for (p, b), got in zip(exact_dedup.MODULI, hasher.whole(text), strict=True):
        want = 0
        for x in text:
            want = (want * b + x + 1) % p
        assert got == want


def test_exact_dedup_keeps_one_row_of_each_group_with_all_columns(spark):
    docs = frame(spark, EXACT).withColumn("row", F.lit(1)).withColumn("keep_id", F.lit("x")).withColumn("h1", F.lit(2))
    kept = exact_dedup.deduplicated(docs)
    assert kept.columns == docs.columns
    assert rows(kept, "doc_id") == sorted([(r[0],) for r in plain_exact(EXACT) if r[3]], key=repr)


def test_exact_groups_of_no_rows(spark):
    empty = frame(spark, [])
    assert exact_dedup.exact_groups(empty).count() == 0
    assert exact_dedup.deduplicated(empty).count() == 0


# --- SimHash -------------------------------------------------------------------------------------


def plain_fingerprint(text):
    own = re.findall(r"[^ \t-\r]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not own:
        return 0
    shingles = [" ".join(own[i : i + 4]) for i in range(max(1, len(own) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    ids = list(range(len(prints)))
    find = lambda i: i if ids[i] == i else find(ids[i])
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= 4:
                ids[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(prints):
        root = find(i)
        known = [x for x in (least.get(root), doc) if x is not None]
        least[root] = min(known) if known else None
    return sorted(((doc, f"{bits:016x}", least[find(i)]) for i, (doc, bits) in enumerate(prints)), key=repr)


def near_texts(seed):
    rng = random.Random(seed)
    texts, doc = [(0, None), (1, ""), (2, "  \n"), (3, "One"), (4, "one"), (5, "Ünder Über ǅ"), (None, "one")], 10
    for _ in range(12):
        own = words(rng.randrange(40, 900), rng)
        for _ in range(rng.randrange(1, 6)):
            copy = list(own)
            for _ in range(rng.randrange(0, 3)):
                copy[rng.randrange(len(copy))] = "changed"
            texts.append((doc, " ".join(copy)))
            doc += 1
    return texts + texts[-3:]


@pytest.mark.parametrize("cell_limit", [simhash.CELL_LIMIT, 1])
def test_simhash_groups_equal_plain(spark, cell_limit):
    texts = near_texts(3)
    got = simhash.near_groups(frame(spark, texts), cell_limit=cell_limit)
    assert rows(got, "doc_id", "fingerprint", "component_id") == plain_components([(i, plain_fingerprint(t)) for i, t in texts])


def test_tree_links_connect_what_is_linked():
    rng = np.random.default_rng(4)
    centres = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    points = [c ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 4), replace=False))) for c in centres for _ in range(6)]
    points = np.unique(np.array(points, np.uint64))
    assert len(points) > simhash.LEAF

    def roots(links):
        up = {}
        find = lambda x: x if up.get(x, x) == x else find(up[x])
        for a, b in links:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
        return {int(p): find(int(p)) for p in points}

    near = np.bitwise_count(points[:, None] ^ points[None, :]) <= 4
    want = roots([(int(points[i]), int(points[j])) for i, j in np.argwhere(near) if i < j])
    got = simhash.tree_links(points, 4)
    assert roots([(int(x), int(y)) for a, b in got for x, y in zip(a, b, strict=True)]) == want


def test_one_document_of_each_group_stays(spark):
    texts = [(i, t) for i, t in near_texts(5)[:-3] if i is not None]
    docs = frame(spark, texts).withColumn("component_id", F.lit("x")).withColumn("bits", F.lit(0))
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    groups = plain_components([(i, plain_fingerprint(t)) for i, t in texts])
    assert rows(kept, "doc_id") == sorted({(c,) for _, _, c in groups}, key=repr)


def test_null_and_repeated_ids_lose_no_text(spark):
    """Unequal texts of one doc_id are documents of their own; null ids go where their group has another one."""
    rng = random.Random(12)
    a, b, c, d = (" ".join(words(60, rng)) for _ in range(4))
    texts = [(1, a), (5, a), (5, c), (5, c), (None, a), (None, b), (None, b), (7, d), (7, None), (None, ""), (8, " ")]
    docs = frame(spark, texts).withColumn("stay_id", F.lit("x")).withColumn("bits", F.lit(1)).repartition(4)
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert rows(kept, "doc_id", "text") == sorted([(1, a), (5, c), (None, b), (7, d), (7, None)], key=repr)


@pytest.mark.parametrize("limit", [10, 60])
def test_crowded_cells_are_parted_and_lose_no_link(spark, limit):
    """Random fingerprints with planted pairs at each distance: shards stay small, and all links are there."""
    rng = np.random.default_rng(5)
    points = rng.integers(0, 1 << 64, 300_000, np.uint64)
    pairs = []
    for at in rng.choice(len(points), 300, replace=False).tolist():
        flip = sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 6), replace=False))
        pairs.append((int(points[at]), int(points[at]) ^ flip))
    every = np.unique(np.concatenate([points, np.array([q for _, q in pairs], np.uint64)]))
    df = spark.createDataFrame(pd.DataFrame({"bits": every.view(np.int64)})).repartition(4)
    sizes = simhash.shards(df, cell_limit=limit).groupBy("shard").count()
    assert sizes.agg(F.max("count")).first()[0] <= 2 * limit
    found = simhash.near_links(df, cell_limit=limit).collect()
    links = {tuple(sorted((r["a"] & (1 << 64) - 1, r["b"] & (1 << 64) - 1))) for r in found}
    want = {tuple(sorted(p)) for p in pairs if (p[0] ^ p[1]).bit_count() <= 4}
    assert want <= links and all((a ^ b).bit_count() <= 4 for a, b in links)


def test_simhash_of_no_rows(spark):
    assert simhash.near_groups(frame(spark, [])).count() == 0
    assert simhash.one_of_each(frame(spark, [])).count() == 0


def test_components_of_a_long_path_and_of_nothing(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(100, 160)] + [(7, 7), (3, 5), (5, 3)], "a long, b long")
    assert rows(components(path), "node", "root") == sorted([(i, 100) for i in range(101, 161)] + [(5, 3)], key=repr)
    assert components(path.where("false")).count() == 0


# --- repeated passages ---------------------------------------------------------------------------


def passage_docs(seed):
    rng = random.Random(seed)
    shared = words(80, rng, 5000)
    edited = list(shared)
    edited[30] = "edited"
    edited.insert(55, "inserted")
    texts = [
        (1, words(100, rng, 5000) + shared + words(40, rng, 5000)),
        (2, words(20, rng, 5000) + shared),
        (3, edited + words(200, rng, 5000)),
        (4, words(300, rng, 5000)),
        (5, words(30, rng, 5000) + shared[:30] + words(30, rng, 5000)),
        (6, words(7, rng, 5000)),
    ]
    return [(i, " ".join(t)) for i, t in texts] + [(7, None), (8, ""), (None, " ".join(shared))], len(shared)


def test_passages_are_found_and_clean_documents_left_alone(spark):
    texts, n = passage_docs(6)
    got = {r["doc_id"]: r for r in passages.repeated_passages(frame(spark, texts).withColumn("hub", F.lit("x"))).collect()}
    assert set(got) == {2, 3}
    assert all(r["source_doc_id"] == 1 for r in got.values())
    assert (got[2]["start_word"], got[2]["n_words"], got[2]["source_start_word"], got[2]["edits"]) == (20, n, 100, 0)
    assert (got[3]["start_word"], got[3]["n_words"], got[3]["source_n_words"], got[3]["edits"]) == (0, n + 1, n, 2)


def test_many_copies_of_a_passage_are_each_found_once(spark):
    rng = random.Random(7)
    shared = words(60, rng, 5000)
    texts = [(i, " ".join(words(20, rng, 5000) + shared + words(20, rng, 5000))) for i in range(120)]
    got = rows(passages.repeated_passages(frame(spark, texts)), "doc_id", "source_doc_id", "n_words")
    assert got == sorted([(i, 0, 60) for i in range(1, 120)], key=repr)


def plain_shared(a, b, least):
    """Whether a stretch of `least` words stands in both."""
    own = {tuple(a[i : i + least]) for i in range(len(a) - least + 1)}
    return any(tuple(b[i : i + least]) in own for i in range(len(b) - least + 1))


def test_every_exact_passage_of_fifty_words_is_found(spark):
    rng = random.Random(8)
    pool = [words(rng.randrange(30, 90), rng, 3000) for _ in range(15)]
    texts = []
    for i in range(60):
        own = words(rng.randrange(0, 60), rng, 3000)
        for p in rng.sample(pool, rng.randrange(0, 3)):
            own += p + words(rng.randrange(35, 60), rng, 3000)
        texts.append((i, own))
    got = {r["doc_id"] for r in passages.repeated_passages(frame(spark, [(i, " ".join(t)) for i, t in texts])).collect()}
    want = {i for i, t in texts if any(j < i and plain_shared(t, u, 50) for j, u in texts)}
    assert got == want


def test_exact_passages_around_nested_ones_are_found(spark):
    rng = random.Random(18)
    texts = []
    for n in (50, 52, 55, 60, 70, 100):
        for _ in range(8):
            shared, part = words(n, rng, 3000), rng.randrange(25, 50)
            at = rng.randrange(0, n - part + 1)
            for inner in (shared[at : at + part], shared, words(5, rng, 3000) + shared):
                texts.append((len(texts), words(rng.randrange(40, 60), rng, 3000) + inner + words(rng.randrange(40, 60), rng, 3000)))
    got = passages.repeated_passages(frame(spark, [(i, " ".join(t)) for i, t in texts])).collect()
    exact = {(r["doc_id"], r["source_doc_id"]) for r in got if r["edits"] == 0}
    want = {(i, j) for i, t in texts for j, u in texts[max(0, i - 2) : i] if plain_shared(t, u, 50)}
    assert len(want) == 48 and want <= exact


def test_edited_passages_whose_parts_stand_in_smaller_documents_are_found(spark):
    rng = random.Random(28)
    texts, want = [], set()
    for at in (36, 40, 44):
        shared = words(80, rng, 30000)
        edited = [*shared[:at], "edited", *shared[at + 1 :]]
        other = [*shared[: at + 3], "other", *shared[at + 4 :]]
        for part in (shared[:at], shared[at + 1 :], shared, edited, other):
            texts.append((len(texts), words(60, rng, 30000) + part + words(60, rng, 30000)))
        n = len(texts)
        want |= {(n - 2, n - 3), (n - 1, n - 3), (n - 1, n - 2)}
    got = rows(passages.repeated_passages(frame(spark, [(i, " ".join(t)) for i, t in texts])), "doc_id", "source_doc_id", "n_words")
    assert want <= {(i, j) for i, j, n in got if n >= 80}


def test_links_of_many_edited_copies_grow_with_the_copies(spark):
    rng = random.Random(38)
    shared = words(80, rng, 30000)
    texts = [(0, words(60, rng, 30000) + shared[:40]), (1, words(60, rng, 30000) + shared[41:])]
    for i in range(2, 62):  # each with an edit of its own; no document holds all of it
        edited = [*shared[:40], f"x{i}", *shared[41:]]
        texts.append((i, words(60, rng, 30000) + edited + words(60, rng, 30000)))
    got = [r for r in passages.repeated_passages(frame(spark, [(i, " ".join(t)) for i, t in texts])).collect() if r["n_words"] >= 78]
    assert {r["doc_id"] for r in got} == set(range(3, 62))  # all but the first, each with a source before it
    assert all(2 <= r["source_doc_id"] < r["doc_id"] and r["edits"] == 1 for r in got)
    assert len(got) <= 15 * 60  # of 1770 pairs; some keys with BEFORE + 1 links a document


def test_a_passage_is_found_however_many_unlike_documents_hold_its_seeds(spark):
    rng = random.Random(52)
    middle, left, right = words(40, rng, 30000), words(36, rng, 30000), words(36, rng, 30000)
    texts = [(0, middle[:22] + words(40, rng, 30000)), (1, words(40, rng, 30000) + middle[18:])]
    for i in range(2, 62):
        texts.append((i, words(60, rng, 30000) + middle + words(60, rng, 30000)))
    for i in (9, 40):  # alike around the middle, too, with edits so near that no seed stands between
        edited = [[f"x{i}" if k % 6 == 5 else w for k, w in enumerate(side)] for side in (left, right)]
        texts[i] = (i, words(60, rng, 30000) + edited[0] + middle + edited[1] + words(60, rng, 30000))
    got = rows(passages.repeated_passages(frame(spark, [(i, " ".join(t)) for i, t in texts])), "doc_id", "source_doc_id", "n_words", "edits")
    assert [(i, j) for i, j, *_ in got] == [(40, 9)]
    assert got[0][2] >= 100 and got[0][3] >= 10


def test_words_beside_seeds_tell_how_far_a_passage_goes_on():
    rng = np.random.default_rng(53)
    pairs = [rng.integers(1, 3, (2, rng.integers(0, 40))).astype(np.uint64) << np.uint64(33) for _ in range(500)]
    for a, b in pairs:
        b = b[: rng.integers(0, len(b) + 1)]
        if rng.random() < 0.7:
            n = min(len(a), len(b))
            b[:n] = np.where(rng.random(n) < 0.9, a[:n], b[:n])
        seed = np.arange(8, dtype=np.uint64)
        for left, right in ((a, b), (a[::-1], b[::-1])):
            sides = [passages.outwards(np.r_[s, seed, s], np.array([len(s)]), np.array([len(s)])) for s in (left, right)]
            want = [max(passages.extended(x.tolist(), y.tolist())[:2]) for x, y in ((left[::-1], right[::-1]), (left, right))]
            for k in (0, 1):
                told = int(passages.goes_on(sides[0][k], sides[1][k])[0])
                assert told == want[k] or told == passages.LEAST_WORDS and want[k] > 15


def test_periodic_passages_are_found(spark):
    rng = random.Random(48)
    texts = [(0, ["de"] * 58 + words(60, rng, 30000)), (1, words(90, rng, 30000) + ["de"] * 58 + words(20, rng, 30000) + ["de"] * 120), (2, words(30, rng, 30000) + ["de"] * 50)]
    got = passages.repeated_passages(frame(spark, [(i, " ".join(t)) for i, t in texts])).collect()
    told = {i: {w for r in got if r["doc_id"] == i for w in range(r["start_word"], r["start_word"] + r["n_words"])} for i in (1, 2)}
    assert told == {1: {*range(90, 148), *range(168, 288)}, 2: set(range(30, 80))}


def test_predecessors_are_the_same_however_batches_fall():
    keys = np.repeat([3, 5, 9], [1, 7, 12])
    docs = np.r_[4, np.arange(7), np.arange(12)]
    whole = pa.RecordBatch.from_arrays([pa.array(c) for c in (keys, docs, docs * 10, docs * 10 + 5)], names=["seed", "doc", "pos", "upto"])
    want = set()
    for n in (7, 12):
        for i in range(1, n):
            want |= {(i, 10 * i + e, j, 10 * j + e) for j in {0, *range(max(0, i - passages.BEFORE), i)} for e in (0, 5)}
    for size in (1, 3, 20):
        parts = [whole.slice(i, size) for i in range(0, 20, size)]
        assert {tuple(r.values()) for b in passages._partners(iter(parts)) for r in b.to_pylist()} == want


def test_places_of_pairs_in_periodic_words_are_few():
    n = 5000
    hub_pos = np.zeros(n, np.int64)
    key, context, first, second = passages.junctions(np.full(n, 7, np.uint64), np.arange(n), hub_pos, hub_pos)
    assert len(key) <= 4 and len(set(key.tolist())) == 1 and len(context) == len(first) == len(second)
    assert first.min() == 0 and first.max() == n - 2


def test_exact_part_of_an_unlike_chain_is_found():
    a = np.arange(200, dtype=np.uint64)
    b = np.r_[a[:60], a[60:90] + np.uint64(1000), a[90:100], a[100:] + np.uint64(2000)]
    anchors = np.array([[0, 20, 52, 90], [0, 20, 52, 90]])
    assert passages.parts_of(a, b, 0, 0, anchors) == [(0, 60, 0, 60, 0), (90, 100, 90, 100, 0)]


def test_stretch_hashes_tell_places_alike():
    rng = np.random.default_rng(3)
    own = rng.integers(0, 1 << 64, 300, np.uint64)
    got, moved = passages.stretch_hashes(own), passages.stretch_hashes(np.r_[own[:7], own])
    assert len(set(got.tolist())) == 251 and np.array_equal(got, moved[7:])
    assert len(passages.stretch_hashes(own[:49])) == 0


def test_chaining_prefers_the_long_chain_and_respects_order():
    x = np.array([0, 10, 20, 30, 30, 40, 50])
    y = np.array([500, 100, 110, 120, 5, 130, 140])
    best = passages.chained(x, y)[0]
    assert best.tolist() == [1, 2, 3, 5, 6]
    # Against all chains, by exhaustive search.
    rng = random.Random(9)
    for _ in range(40):
        pts = sorted({(rng.randrange(30), rng.randrange(30)) for _ in range(9)})
        x, y = np.array([p[0] for p in pts]), np.array([p[1] for p in pts])
        score = lambda c: len(c) - passages.GAP_COST * sum(x[b] - x[a] + y[b] - y[a] for a, b in zip(c, c[1:], strict=False))  # noqa: E731,B023
        chains = [[]]
        for j in range(len(x)):
            chains += [[*c, j] for c in chains if not c or (x[c[-1]] < x[j] and y[c[-1]] < y[j])]
        most = max(score(c) for c in chains if c)
        assert abs(max(score(c.tolist()) for c in passages.chained(x, y, most_gap=10**6)) - most) < 1e-9


def test_passages_of_no_rows(spark):
    assert passages.repeated_passages(frame(spark, [])).count() == 0
