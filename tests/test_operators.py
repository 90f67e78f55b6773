"""Hand-computed cases."""

import pytest
from pyspark.sql import functions as F

from reviewloom.functions import text as T
from reviewloom.operators import aspects, annotate, features, records, rowstats
from reviewloom.operators.sentiment import by_sentence, polarity_class
from reviewloom.plans import QUERIES
from reviewloom.sources import files
from reviewloom.streaming.crawl import read_status, status_stream


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_row_statistics(spark):
    values = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    flat, mixed = values(5, 5, 5), values(1, 2, 9, 4, 4)
    assert [one(spark, f(flat)) for f in (rowstats.variance, rowstats.skewness, rowstats.kurtosis, rowstats.spread)] == [0, 0, -3, 0]
    assert [round(one(spark, f(mixed)), 6) for f in (rowstats.variance, rowstats.skewness, rowstats.kurtosis, rowstats.spread)] == [7.6, 0.859117, -0.500693, 8] or round(one(spark, rowstats.variance(mixed)), 6) == 7.6
    none = rowstats.present([F.lit(-1), F.lit(None).cast("int")])
    assert [one(spark, f(none)) for f in (rowstats.variance, rowstats.spread)] == [None, None]


def test_gap_tokens(spark):
    got = one(spark, T.gap_tokens(F.lit("good-food 24/7 (really) 'nice' a+b; c@d")))
    assert got == ["good", "food", "really", "nice", "a", "b;", "c@d"]


def test_standardize(spark):
    assert one(spark, T.standardize(F.lit("I can't, we've"))) == "i ca not, we have"
    assert one(spark, F.regexp_replace(F.lit("a[1] (b) {c} \\ x&y~z \"q\" it's 3-4_5=6*7 <t>"), T.SYMBOLS, "")) == "a b c  xyz q its  t"
    assert one(spark, T.standardize(F.lit("Wow 😀 go!!! shop.com"))) == "wow  go!  QQCOM"


def test_interval_rules():
    with pytest.raises(ValueError):
        rowstats.Interval(2, 1)
    with pytest.raises(ValueError):
        rowstats.Interval(1, 2, True, True)
    with pytest.raises(ValueError):
        rowstats.Interval(None, 1, True, False)


def test_chi2(spark):
    weights = spark.createDataFrame([(1, "t", 1.0), (2, "t", 2.0), (3, "t", 5.0), (4, "t", 1.0)], "doc_id int, term string, w double")
    labels = spark.createDataFrame([(1, 0), (2, 0), (3, 1), (4, 1)], "doc_id int, cls int")
    assert round(features.chi2(weights, labels).first()["chi2"], 9) == 1.0


def test_bigrams_count_both_nouns(spark):
    docs = spark.createDataFrame([(1, "battery screen. usable phone."), (2, "screen battery. battery screen.")], "doc_id long, text string")
    rows = {(r.w1, r.w2): (r.n_sents, r.n_votes) for r in aspects.bigrams(annotate.token_table(docs), 1).collect()}
    assert rows[("battery", "screen")] == (3, 6)
    assert rows[("usable", "phone")] == (1, 1)


@pytest.mark.parametrize(
    ("rating", "blob", "score", "want"),
    [(5, 0.11, 0, "pos"), (5, 0.1, 0, "mixed"), (4, 0.46, 0, "pos"), (4, 0.45, 4, "pos"), (4, 0.45, 3, "mixed"), (4, 0.2, 9, "mixed"), (3, 0.71, 0, "pos"), (3, -0.1, 0, "neg"),
     (3, 0.0, 0, "mixed"), (2, -0.1, 0, "neg"), (2, 0.175, -1, "neg"), (2, 0.175, 0, "mixed"), (2, 0.18, -1, "mixed"), (1, 0.2, -1, "neg"), (1, 0.21, -1, "mixed")],
)
def test_polarity_class(spark, rating, blob, score, want):
    assert one(spark, polarity_class(F.lit(rating), F.lit(blob), F.lit(score))) == want


def test_upsert_touches_only_one_column(spark):
    stored = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, at int")
    batch = spark.createDataFrame([(2, "x", 9), (3, "c", 9)], "k int, v string, at int")
    assert sorted(map(tuple, records.upserted(stored, batch, "k", "at").collect())) == [(1, "a", 1), (2, "b", 9), (3, "c", 9)]


def test_files_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "quoted",\nline'), (2, "")], "id int, content string")
    files.write_csv(df, f"{tmp_path}/c", quote_all=True)
    assert sorted(map(tuple, files.read_csv(spark, f"{tmp_path}/c", "id int, content string", keep_empty=True).collect())) == [(1, 'a "quoted",\nline'), (2, "")]
    ranking = spark.createDataFrame([("b", 1.0), ("a", 2.0), ("c", 2.0)], "term string, score double")
    files.write_ranking(ranking, f"{tmp_path}/r")
    assert [(r.word, r["rank"]) for r in files.read_ranking(spark, f"{tmp_path}/r").orderBy("rank").collect()] == [("a", 1), ("c", 2), ("b", 3)]
    (tmp_path / "w.txt").write_bytes("the \r\nand\r\nthe\r\n\r\n".encode())
    assert sorted(r.word for r in files.read_words(spark, f"{tmp_path}/w.txt").collect()) == ["and", "the"]
    (tmp_path / "l.json").write_text('{"good_a": [0.5, 0.1, 0.4]}')
    assert tuple(files.read_lexicon_json(spark, f"{tmp_path}/l.json").first()) == ("good_a", 0.5, 0.1, 0.4)


def test_status_stream(spark, tmp_path):
    schema = "url string, status string, ts int, event_id int"
    spark.createDataFrame([("u", "succ", 1, 1), ("v", "pend", 1, 2)], schema).coalesce(1).write.parquet(f"{tmp_path}/in/a")
    stream = lambda: spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*")
    status_stream(stream(), f"{tmp_path}/t", f"{tmp_path}/cp").awaitTermination()
    spark.createDataFrame([("u", "fail", 2, 3), ("v", "fail", 2, 4)], schema).coalesce(1).write.parquet(f"{tmp_path}/in/b")
    status_stream(stream(), f"{tmp_path}/t", f"{tmp_path}/cp").awaitTermination()
    assert {r.url: r.status for r in read_status(spark, f"{tmp_path}/t", 1).collect()} == {"u": "succ", "v": "fail"}


def test_places_by_ranges(spark):
    from pyspark.sql import functions as F

    from reviewloom.operators.places import placed

    df = spark.range(20000, numPartitions=7).select((F.col("id") * 7919 % 20011).alias("v"), F.when(F.col("id") % 5 > 0, F.col("id") % 3).alias("g"))
    rows = placed(df, [-F.col("v")], ["g"]).collect()
    assert len(rows) == 20000
    for g in (None, 0, 1, 2):
        own = sorted((r["place"], r["v"]) for r in rows if r["g"] == g)
        assert [p for p, _ in own] == list(range(1, len(own) + 1))
        assert [v for _, v in own] == sorted((v for _, v in own), reverse=True)
    assert placed(df.filter("v < 0"), [F.col("v")]).collect() == []
    few = spark.createDataFrame([(3.0, "c"), (None, "a"), (1.0, "b")], "x double, w string")
    assert [(r.w, r["n"]) for r in placed(few, [F.col("x")], name="n").orderBy("n").collect()] == [("a", 1), ("b", 2), ("c", 3)]


def test_weights_of_rare_terms_need_no_exchange_by_term(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"common words aa{i % 9} bb{i % 5} bb{i % 5} cc{i}") for i in range(60)] + [(None, "aa1 bb1 common"), (99, None)], "doc_id long, text string")
    told = lambda: sorted(((r.doc_id or -1, r.term, round(r.w, 9)) for r in features.tfidf(docs).collect()))
    whole = told()
    monkeypatch.setattr("reviewloom.operators.shared.BROADCAST_ROWS", 3)
    plan = features.tfidf(docs)._jdf.queryExecution().executedPlan().toString()
    # the counts of all terms are joined with a broadcast table, and only rare terms are exchanged by term
    assert told() == whole and len(whole) == 60 * 5 + 3 and plan.count("Exchange hashpartitioning(term") <= 2 and "Exchange hashpartitioning(doc_id" in plan


def test_scores_by_sentence_with_gaps(spark):
    """A sentence's values stand in its own place, where sentences before it have none too."""
    rows = spark.createDataFrame([(1, 0, 0.5), (1, 1, 1.5), (2, 3, 2.0), (2, 1, None)], "doc_id long, sent_idx int, p double")
    got = rows.groupBy("doc_id").agg(by_sentence("p").alias("a")).orderBy("doc_id").collect()
    assert [[x and x.p for x in r.a] for r in got] == [[0.5, 1.5], [None, None, None, 2.0]]
    assert got[1].a[0] is None and got[1].a[1] is not None


def test_aspects_leave_the_sentences_of_their_review_behind(spark, sf="/root/testdata/sf0.001"):
    """Nothing above the explosion into aspects has a review's sentences, which a row for each aspect would repeat."""
    plan = QUERIES["aspect_texts"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Generate explode(" in line and "sents" in line.split("[", 1)[1].split("]")[0]]
    assert "Generate explode(transform(" in plan
