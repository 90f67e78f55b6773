"""Readers and writers: recommendations, tasks, word sets, intervals, feeds, JSON; late events of a crawl."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from reviewloom.functions import parsing as P
from reviewloom.operators import rowstats
from reviewloom.sources import files
from reviewloom.streaming.crawl import first_seen


def test_reviews_json(spark, tmp_path):
    (tmp_path / "r.json").write_text('[{"content": " good\\n", "will_recommend": 1}, {"content": "bad", "will_recommend": 0}, {"content": "?", "will_recommend": null}]')
    rows = files.read_reviews_json(spark, f"{tmp_path}/r.json").collect()
    assert sorted((r.content, r.posneg) for r in rows) == [("?", 0), ("bad", 0), ("good", 1)]
    with pytest.raises(ValueError):
        files.read_reviews_json(spark, f"{tmp_path}/r.csv")


def test_tasks(spark, tmp_path):
    (tmp_path / "t.json").write_text('{"Id": "a-1", "Hotels": [{"Id2": 7611, "Name": "B"}, {"Id2": 1443, "Name": "V"}]}')
    assert sorted(map(tuple, files.read_tasks(spark, f"{tmp_path}/t.json", "Hotels").select("Id", "Id2", "Name").collect())) == [("a-1", 1443, "V"), ("a-1", 7611, "B")]


def test_word_sets(spark):
    lists = [spark.createDataFrame([(w,) for w in ws], "word string") for ws in ("ab", "bc", "a")]
    assert sorted(r.word for r in files.words_of_all(*lists).collect()) == ["a", "b", "c"]


def test_interval_folders(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.0, 5.0), (2, 0.5, 6.0), (3, 7.0, 7.0), (4, None, 8.0)], "id int, variance double, range double")
    files.write_intervals(df, f"{tmp_path}/v", "variance", rowstats.PRESETS["variance"], ("range",))
    back = spark.read.option("header", True).csv(f"{tmp_path}/v")
    assert back.columns == ["id", "variance", "part"] and sorted((r.id, r.part) for r in back.collect()) == [("1", "0_0"), ("2", "0_1"), ("3", "1_inf")]


def test_feeds(spark, tmp_path):
    items = spark.createDataFrame([("hotel", 1, "H"), ("review", 2, "R")], "kind string, id int, name string")
    files.write_feed(items, f"{tmp_path}/f", "review", ["name", "themes", "id"])
    assert [tuple(r) for r in spark.read.option("header", True).csv(f"{tmp_path}/f").collect()] == [("R", None, "2")]


def test_json_and_csv_writers(spark, tmp_path):
    df = spark.createDataFrame([(2, ["a", "b"]), (1, [])], "id int, words array<string>")
    files.write_json(df, f"{tmp_path}/j")
    assert sorted((r.id, r.words) for r in spark.read.json(f"{tmp_path}/j").collect()) == [(1, []), (2, ["a", "b"])]
    files.write_csv_indexed(df.select("id"), f"{tmp_path}/i", ["id"])
    assert sorted((r["index"], r.id) for r in spark.read.option("header", True).csv(f"{tmp_path}/i").collect()) == [("0", "1"), ("1", "2")]


def test_scores_and_texts_that_are_there(spark):
    rows = [(1, 0, "x"), (2, -1, "x"), (3, None, "x"), (4, 5, ""), (5, 5, None)]
    df = spark.createDataFrame(rows, "id int, a int, t string")
    assert [r.id for r in df.filter(rowstats.complete([F.col("a")], F.col("t"))).collect()] == [1]
    assert sorted(r.id for r in df.filter(rowstats.complete([F.col("a")])).collect()) == [1, 4, 5]


def test_recommendations(spark):
    given, out_of = P.recommendation(F.col("x"))
    rows = spark.createDataFrame([("Likely (1-10): 8",), ("none",)], "x string").select(given.alias("a"), out_of.alias("b")).collect()
    assert [tuple(r) for r in rows] == [(8, 10), (None, None)]


def test_first_event_of_a_link(spark, tmp_path):
    begin = datetime(2024, 1, 1)
    rows = [("a", begin, 1), ("a", begin + timedelta(seconds=5), 2), ("b", begin, 3)]
    spark.createDataFrame(rows, "url string, ts timestamp, n int").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("url string, ts timestamp, n int").parquet(f"{tmp_path}/in")
    query = first_seen(stream, "url", "ts", "1 minute").writeStream.format("memory").queryName("first_links").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r.url for r in spark.table("first_links").collect()) == ["a", "b"]
