"""The corpus pipeline against a plain version of each stage on its own input."""

import random
import re

from pyspark.sql import functions as F

import corpus_pipeline
from cyclewright.llm import decontaminate, quality, simhash
from cyclewright.llm.common import stored


def fixture(spark, folder):
    rng = random.Random(1)
    common, junk = [f"w{i}" for i in range(600)], ["THE!!", "$$$", "BUY###", "click%%%"]
    some = lambda n, pool=common: [rng.choice(pool) for _ in range(n)]
    items = [(i, " ".join(some(30))) for i in range(5)]
    texts, labels = [], []
    for i in range(300):
        bad = i % 5 == 0
        own = some(rng.randrange(60, 300)) if not bad else some(100) + some(200, junk)
        if not bad and i % 11 == 0:
            own[10:10] = items[i % 5][1].split()
        texts.append((i, " ".join(own), f"s{i % 3}"))
        labels.append((i, int(not bad), 0))
    for i in range(1, 60, 2):
        own = texts[i][1].split()
        texts.append((1000 + i, texts[i][1].replace(" ", "\n", 3), "s0"))
        own[-1] = "changed"
        texts.append((2000 + i, " ".join(own), None))
    texts += [(5000, None, "s1"), (5001, "", "s1")]
    docs = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in texts], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return dict(items)


def test_each_stage_on_its_own_input(spark, tmp_path):
    items = fixture(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "exact dedup", "SimHash near-dedup", "benchmark decontamination", "mixing sources to target weights",
    ]
    held = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        out = stored(stage(spark, docs, str(tmp_path)))
        after = {r["doc_id"] for r in out.collect()}
        assert out.count() == len(after) and after <= set(before)
        if name != "mixing sources to target weights":
            assert out.columns == docs.columns
        if name == "quality classifier":
            bad = {i for i in before if i < 5000 and i % 1000 % 5 == 0}
            assert len(bad & after) <= 1 and len((set(before) - bad) - after) <= 0.02 * len(before)
        if name == "exact dedup":
            first = {}
            for i, t in sorted(before.items()):
                first.setdefault(re.sub(r"[ \t-\r]+", " ", t or ""), i)
            assert after == set(first.values())
        if name == "SimHash near-dedup":
            bits = {i: simhash.text_fingerprint((t or "").encode()) for i, t in before.items()}
            up = {i: i for i in before}
            find = lambda i: i if up[i] == i else find(up[i])  # noqa: E731,B023
            for i in before:
                for j in before:
                    if i < j and (bits[i] ^ bits[j]).bit_count() <= 4:
                        a, b = sorted((find(i), find(j)))
                        up[b] = a
            assert after == {i for i in before if find(i) == i}
        if name == "benchmark decontamination":
            leaks = {i for i, t in before.items() if any(x in " ".join(decontaminate.words_of(t)) for x in items.values())}
            assert leaks and after == set(before) - leaks
        if name == "mixing sources to target weights":
            assert all(0 < r["taken"] <= 3 * r["size"] for r in out.collect())
            assert {"size", "source_size", "target", "taken", *docs.columns} == set(out.columns)
        held[name], docs = after, out
    got = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").collect()
    assert {r["doc_id"] for r in got} == held["mixing sources to target weights"]


def test_stages_take_no_rows_and_extra_columns(spark, tmp_path):
    fixture(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").where("doc_id < 40")
    extra = docs.withColumn("log_weight", F.lit(1)).withColumn("h1", F.lit("x")).withColumn("bits", F.lit(2)).withColumn("item_id", F.lit(None).cast("string"))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), str(tmp_path)).count() == 0, name
        assert set(stage(spark, extra, str(tmp_path)).columns) >= set(extra.columns), name
    assert quality.free_name(extra, "LOG_WEIGHT") == "LOG_WEIGHT_"
