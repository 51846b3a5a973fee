"""Every operator on a table with one very long text, whose end counts like its beginning."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from cyclewright.llm import chat, decontaminate, exact_dedup, licenses, mixing, packing, pages, passages, periods, quality, secrets, simhash

N_WORDS = 200_000
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    some = lambda n: [f"w{rng.randrange(50_000)}" for _ in range(n)]
    shared, item = some(80), some(30)
    end = [*shared, *item, "gnu", "general", "public", "license", "token", "=", "AKIA" + "Q7X2" * 4]
    long = some(N_WORDS - len(end)) + end
    return {1: " ".join(some(50) + shared), 2: " ".join(long), 3: "short text", "item": " ".join(item), "shared": N_WORDS - len(end)}


@pytest.fixture
def docs(spark, texts):
    rows = [(i, texts[i], "en", "s", len(texts[i])) for i in (1, 2, 3)]
    return spark.createDataFrame(rows, DOCS)


def of(df, doc):
    return [r for r in df.collect() if r["doc_id"] == doc]


def test_counts_and_phrases(docs):
    assert of(mixing.mixed(docs), 2)[0]["size"] == N_WORDS
    found = of(licenses.scanned(docs), 2)[0]
    assert (found["n_words"], found["base_labels"], found["last_word"]) == (N_WORDS - 1, "gpl", N_WORDS - 7)


def test_groups(docs, texts):
    again = docs.union(docs.where("doc_id = 2").withColumn("doc_id", F.lit(9).cast("long")))
    assert of(exact_dedup.exact_groups(again), 9)[0]["keep_id"] == 2
    got = of(simhash.near_groups(again), 9)[0]
    assert got["component_id"] == 2 and int(got["fingerprint"], 16) == simhash.text_fingerprint(texts[2].encode())


def test_passages_and_leaks(spark, docs, texts):
    found = of(passages.repeated_passages(docs), 2)
    assert [(r["start_word"], r["n_words"], r["source_doc_id"]) for r in found] == [(texts["shared"], 80, 1)]
    items = spark.createDataFrame([(5, texts["item"])], "item_id long, text string")
    leak = of(decontaminate.leaks(docs, items), 2)
    assert [(r["item_id"], r["edits"]) for r in leak] == [(5, 0)]
    assert {r["doc_id"] for r in decontaminate.without_leaks(docs, items).collect()} == {1, 3}


def test_secrets_and_weights(spark, docs):
    start = max(r["start"] for r in secrets.scanned(docs).where("doc_id = 2").collect())
    assert start > 1_000_000
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 0)], "doc_id long, quality int, toxic int")
    assert of(quality.resampled(docs, labels), 2)[0]["n_grams"] >= N_WORDS


def test_pages_and_chats(spark, texts):
    page = f"<body><nav>menu</nav><article><p>{texts[2]}</p><p>The end.</p></article></body>"
    got = pages.extracted(spark.createDataFrame([(1, "http://a.example/x", page)], "page_id long, url string, html string")).first()
    assert got["text"] == f"{texts[2]}\nThe end." and got["n_chars"] == len(texts[2]) + 9
    turns = spark.createDataFrame([(1, 1, "user", texts[2])], "conv_id long, turn long, role string, text string")
    assert texts[2] in chat.formatted(turns).first()["text"]


def test_pieces_and_runs(docs, texts):
    model = public_tokenizers.path("word_bpe_49k.json")
    ids = Tokenizer.from_file(model).encode(texts[2], add_special_tokens=False).ids
    got = packing.packed(docs, model).where("doc_id = 2").agg(F.sum("length"), F.max("start"), F.max("length")).first()
    assert tuple(got) == (len(ids) + 1, (len(ids) // 4096) * 4096, 4096)
    assert [x.tolist() for x in packing.WordIds(Tokenizer.from_file(model)).of(pa.array([texts[2]]))] == [ids]
    repeated = docs.withColumn("text", F.when(F.col("doc_id") == 2, F.concat("text", F.repeat(F.lit(" a b c"), 100))).otherwise(F.col("text")))
    run = of(periods.periodic_runs(repeated), 2)[0]
    assert run["n_runs"] >= 1 and np.isclose(run["length"] / run["period"], run["exponent_milli"] / 1000, atol=1e-3)


def test_pipeline(spark, docs, texts, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(7, "nowhere to be found at all")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == {1, 2, 3} and got[2]["text"] == texts[2] and got[2]["size"] == N_WORDS
