import datetime as dt
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cyclewright.operators import anchors, summaries
from cyclewright.sources import readers, snapshots


def write(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding))
    return str(path)


def test_csv_with_bom_quotes_and_newlines(spark, tmp_path):
    path = write(tmp_path / "a.csv", '﻿id,text,n\n1,"two\nlines, ""quoted""",5\n2,plain,\n')
    rows = readers.read_csv(spark, path).orderBy("id").collect()
    assert rows[0]["text"] == 'two\nlines, "quoted"' and rows[0]["n"] == 5
    assert rows[1]["n"] is None


def test_latin_csv(spark, tmp_path):
    path = write(tmp_path / "a.csv", "id,text\n1,café\n", "latin-1")
    assert readers.read_csv(spark, path, encoding="ISO-8859-1").first()["text"] == "café"


def test_json_lines_skip_what_is_broken(spark, tmp_path):
    lines = [
        '1:{"author": "a", "id": "x:1", "body": "b: c", "extra": 1}',
        " 2 : {\"author\": \"b\"} ",
        "",
        "no colon",
        '3:{"author": "cut',
        "4:[1, 2]",
        "5:text",
        "6:{}",
    ]
    path = write(tmp_path / "a.txt", "\n".join(lines))
    rows = readers.read_any(spark, path).collect()
    assert [(r["author"], r["id"], r["body"]) for r in rows] == [
        ("a", "x:1", "b: c"),
        ("b", None, None),
        (None, None, None),
    ]


def test_missing_and_unsupported_files(spark, tmp_path):
    good = write(tmp_path / "a.txt", '1:{"author": "a"}')
    found = readers.read_existing(spark, [str(tmp_path / "none.csv"), str(tmp_path / "x.xlsx"), good])
    assert len(found) == 1
    with pytest.raises(FileNotFoundError):
        readers.read_existing(spark, [str(tmp_path / "none.csv")])
    with pytest.raises(ValueError):
        readers.read_any(spark, "a.xlsx")


def test_first_source_wins_and_null_ids_are_one(spark):
    schema = "id string, author string, created_utc double, x int"
    first = spark.createDataFrame([("1", "a", 2.0, 10), ("1", "a", 1.0, 11), (None, "a", 1.0, 12)], schema)
    second = spark.createDataFrame([("1", "a", 0.0, 20), (None, "a", 0.0, 21), ("2", "b", 0.0, 22), ("3", "z", 0.0, 23)], schema)
    users = spark.createDataFrame([("a",), ("b",)], "user string")
    out = readers.load_posts([first, second], users)
    assert {r["id"]: r["x"] for r in out.collect()} == {"1": 11, None: 12, "2": 22}
    assert out.columns == ["id", "author", "created_utc", "x"]


def raw(spark, rows):
    return spark.createDataFrame(rows, readers.RAW_SCHEMA)


def test_content_length_excludes_the_joining_space(spark):
    rows = [
        ("a", 1.0, "s", "1", "x" * 75, "y" * 75, None),
        ("a", 1.0, "s", "2", "x" * 75, "y" * 74, None),
        ("a", 1.0, "s", "3", None, "  " + "y" * 148, None),
        ("z", 1.0, "s", "4", "x" * 200, "", None),
        ("a", 1.0, "s", "5", None, None, "b" * 150),
    ]
    users = spark.createDataFrame([("a",)], "user string")
    got = {r["id"]: (len(r["text"]), r["source"]) for r in readers.load_content(raw(spark, rows), users, "post").collect()}
    assert got == {"1": (151, "post"), "3": (148, "post")}
    comments = readers.load_content(raw(spark, rows), users, "comment").collect()
    assert [(r["id"], r["source"]) for r in comments] == [("5", "comment")]
    with pytest.raises(ValueError):
        readers.load_content(raw(spark, rows), users, "other")


def test_category_scan(spark):
    df = spark.createDataFrame([("a", "X", 1), ("b", "X", 2), ("a", "x", 3), ("a", None, 4)], "author string, c string, id int")
    assert {r["id"] for r in readers.scan_categories([df], ["X"], "c").collect()} == {1, 2}
    users = spark.createDataFrame([("a",)], "user string")
    assert [r["id"] for r in readers.scan_categories([df, df.where("id = 9")], ["X"], "c", users).collect()] == [1]


def test_posts_of_users(spark, tmp_path):
    path = write(tmp_path / "p.csv", "author,text\na,one\nb,two\n")
    users = spark.createDataFrame([("a",)], "user string")
    assert [r["text"] for r in readers.posts_of_users(spark, path, users).collect()] == ["one"]


def test_snapshots(spark, tmp_path):
    root = str(tmp_path / "out")
    old, new = (spark.createDataFrame([(i, f"r{i}")], "id int, name string") for i in (1, 2))
    assert snapshots.load_newest(spark, root, "consensus_periods") is None
    snapshots.save_snapshot(new, root, "periodicity_results", "20240102_000000")
    snapshots.save_snapshot(old, root, "periodicity_results", "20240101_000000")
    got = snapshots.load_newest(spark, root, "periodicity_results")
    assert [tuple(r) for r in got.collect()] == [(2, "r2")]
    first = snapshots.load_first_available(spark, root, snapshots.PERIOD_DATASETS)
    assert first.count() == 1
    snapshots.save_snapshot(old, root, "consensus_periods", "20230101_000000")
    assert snapshots.load_first_available(spark, root, snapshots.PERIOD_DATASETS).first()["id"] == 1
    skipped = snapshots.load_first_available(spark, root, snapshots.PERIOD_DATASETS, exclude="consensus")
    assert skipped.first()["id"] == 2
    users = got.withColumn("pattern_category", F.lit("pattern_1"))
    assert readers.load_users(users, "pattern_1").count() == 1
    assert readers.load_users(users, "pattern_2").count() == 0


def test_csv_export(spark, tmp_path):
    path = str(tmp_path / "csv")
    df = spark.createDataFrame([(1, "a,b"), (2, None)], "id int, t string")
    snapshots.export_csv(df, path)
    back = spark.read.csv(path, header=True, inferSchema=True, escape="\\").orderBy("id").collect()
    assert [tuple(r) for r in back] == [(1, "a,b"), (2, None)]


def test_required_columns(spark):
    df = spark.createDataFrame([(1, None), (None, None)], "a int, b string")
    got = {r["column_name"]: r["null_share"] for r in summaries.null_profile(df, ["a", "b"]).collect()}
    assert got == {"a": 0.5, "b": 1.0}
    with pytest.raises(ValueError):
        summaries.null_profile(df, ["a", "z"])


def test_category_shares_are_of_all_posts(spark):
    df = spark.createDataFrame([("a",)] * 6 + [("b",)] * 3 + [("c",), (None,), ("",)], "c string")
    got = [(r["c"], r["post_count"], r["percentage"]) for r in summaries.category_shares(df, "c", 2).collect()]
    assert got == [("a", 6, 60.0), ("b", 3, 30.0)]
    assert summaries.category_shares(df, "c", 1, 1).count() == 1


def test_times_are_utc(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 23, tzinfo=dt.timezone.utc),)], "t timestamp")
    assert df.select(F.col("t").cast("date")).first()[0] == dt.date(2024, 1, 1)


def test_json_lines_with_quoted_numbers_tabs_and_bad_values(spark):
    lines = [
        '1:{"id":"a","created_utc":"1500000000","body":"x"}',
        '2:\t{"id":"b","created_utc":1500000001.5}\t',
        '3: {"id":"c","created_utc":"soon","title":7}',
        '4: {"id":"d","created_utc":{"n":1}}',
        "5: [1]",
        '6: {"id":',
        "7:",
    ]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    got = {r["id"]: (r["created_utc"], r["title"]) for r in readers.parse_json_lines(df).collect()}
    assert got == {"a": (1.5e9, None), "b": (1500000001.5, None), "c": (None, "7"), "d": (None, None)}


def test_rows_of_one_id_and_time_fall_to_the_smallest(spark):
    rows = [("x", 1.0, "b"), ("x", 1.0, "a"), (None, 2.0, "d"), (None, 2.0, "c")]
    df = spark.createDataFrame(rows, "id string, created_utc double, text string")
    got = readers.first_row_per_id(df.repartition(3), "id", ["created_utc"]).collect()
    assert sorted(r["text"] for r in got) == ["a", "c"]


def test_empty_input_is_refused(spark):
    df = spark.range(2)
    assert summaries.require_rows(df) is df
    with pytest.raises(ValueError):
        summaries.require_rows(df.where("id > 5"), "posts")


def odd_csv(rng, n):
    """Rows of awkward fields, and the same as CSV text."""
    pieces = ["a", "é", '"', '""', "\n", "\r\n", ",", " ", "x" * 50, "\n\n", "'", "\\"]
    rows = [(i, "".join(rng.choice(pieces) for _ in range(rng.randrange(1, 12))), rng.choice([None, "z"])) for i in range(n)]
    rows[n // 2] = (n // 2, "\n".join(['long "line"'] * 3000), "z")
    lines = ["id,text,last"]
    for i, t, z in rows:
        quoted = '"' + t.replace('"', '""') + '"'
        lines.append(f"{i},{quoted},{z or ''}")
    return rows, "\n".join(lines) + "\n"


@pytest.mark.parametrize("encoding", ["UTF-8", "ISO-8859-1"])
def test_one_csv_file_is_read_by_many_tasks(spark, tmp_path, encoding):
    rng = random.Random(3)
    rows, text = odd_csv(rng, 3000)
    more, other = odd_csv(rng, 40)
    path = str(tmp_path / "many.csv")
    Path(path).mkdir()
    (tmp_path / "many.csv" / "a.csv").write_bytes(text.encode(encoding))
    (tmp_path / "many.csv" / "b.csv").write_bytes(other.encode(encoding))
    schema = T._parse_datatype_string("id int, text string, last string")
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in ("997", "20000", "128MB"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "100")
            df = readers.read_csv(spark, path, schema, encoding)
            assert sorted(map(tuple, df.collect()), key=repr) == sorted(rows + more, key=repr)
            if size == "20000":
                assert df.rdd.getNumPartitions() > 5
                guessed = readers.read_csv(spark, path, encoding=encoding)
                assert dict(guessed.dtypes) == {"id": "int", "text": "string", "last": "string"}
                assert guessed.count() == len(rows) + len(more)
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_csv_with_windows_line_ends_and_types(spark, tmp_path):
    path = write(tmp_path / "w.csv", 'a,b,c,d,e\r\n1,"x\r\ny",2.5,2024-01-02,true\r\n\r\n3000000000,"",,,false\r\n')
    df = readers.read_csv(spark, path)
    assert [k for _, k in df.dtypes] == ["bigint", "string", "double", "date", "boolean"]
    got = sorted(map(tuple, df.collect()))
    assert got[0][:3] == (1, "x\r\ny", 2.5) and got[1] == (3_000_000_000, None, None, None, False)
    # The other reader makes every line end one newline, inside quotes, too.
    plain = [(a, b and b.replace("\r\n", "\n"), *rest) for a, b, *rest in got]
    assert plain == sorted(map(tuple, readers.read_csv(spark, path, df.schema, split=False).collect()))
    assert readers.read_csv(spark, write(tmp_path / "h.csv", "a,b\n")).columns == ["a", "b"]


def test_posts_in_buckets_are_joined_where_they_are(spark, tmp_path, no_broadcast):
    posts = spark.range(5000).select(
        (F.col("id") % 37).alias("author"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 3600).alias("ts_utc"),
        "id",
    )
    users = spark.range(0, 30, 2).select(
        F.col("id").alias("user"),
        F.timestamp_seconds(F.lit(1_700_500_000)).alias("timestep"),
        F.lit(3).alias("offset_from_cd1"),
    )
    root = str(tmp_path)
    assert snapshots.load_bucketed(spark, root, "posts", "author") is None
    snapshots.save_bucketed(posts.where("id < 9"), root, "posts", "20240101_000000", "author", 4)
    snapshots.save_bucketed(posts, root, "posts", "20240102_000000", "author", 4)
    stored = snapshots.load_bucketed(spark, root, "posts", "author")
    assert stored.count() == 5000

    def result(rows, by_layout):
        kept = anchors.keep_users(rows, users.select(F.col("user").alias("author")), "author", by_layout)
        placed = anchors.add_offsets(kept, users, by_layout=by_layout)
        near = anchors.within_months(placed, users, months=2, by_layout=by_layout)
        return anchors.within_calendar_days(near, users, days=40, by_layout=by_layout)

    plan = result(stored, True)._jdf.queryExecution().executedPlan().toString()
    facts = [line for line in plan.splitlines() if "Exchange" in line and "id#" in line and "ts_utc" in line]
    # One exchange for each of the four tables of users; none above the scan of the posts.
    assert plan.count("Exchange hashpartitioning") == 4 and not facts
    assert "Bucketed: true" in plan
    assert sorted(result(stored, True).collect()) == sorted(result(posts, False).collect())
