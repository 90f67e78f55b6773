"""Aspects, lemmas, words of Han text, snippets, page data and file order: hand cases and plain Python."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewloom.functions import parsing as P
from reviewloom.functions import text as T
from reviewloom.operators import annotate as A
from reviewloom.operators import aspects as G
from reviewloom.operators import sentiment as S
from reviewloom.operators.containment import contained
from reviewloom.operators.lemmas import IRREGULAR, lemmatized
from reviewloom.operators.segment import han_words
from reviewloom.operators.shared import kept_apart, met, sieved
from reviewloom.sources import files


def mined(spark, texts, least=1):
    tokens = A.with_starts(A.token_table(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).cache()
    near = G.noun_neighbours(tokens)
    found = G.bigrams(tokens, least, near=near)
    places = G.bigram_places(found, near)
    chained = G.trigrams(places, 0.09)
    return tokens, found, places, chained


def test_trigrams_stand_in_sentences_of_both_bigrams(spark):
    # the first review holds both bigrams, but in different sentences
    tokens, _, places, chained = mined(spark, ["alpha beta. beta gamma.", "alpha beta gamma. the alpha beta.", "of beta gamma."])
    assert ("alpha", "beta", "gamma", 2) in {tuple(r) for r in chained.collect()}
    where = G.trigram_places(chained, places)
    assert [tuple(r) for r in where.filter("w1 = 'alpha' and w2 = 'beta' and w3 = 'gamma'").collect()] == [("alpha", "beta", "gamma", 1, 0, 0)]
    rows = {(r.lemma, r.doc_id, r.sent_idx): r.tok_idx for r in G.occurrences(tokens, places, where).collect()}
    assert rows[("alpha beta gamma", 1, 0)] == 0 and ("alpha beta gamma", 0, 0) not in rows and rows[("alpha beta", 1, 1)] == 1 and rows[("beta gamma", 2, 0)] == 1


def test_complements_count_for_the_subject(spark):
    tokens = A.token_table(spark.createDataFrame([(1, "the room is spacious. the room is not usable. a famous room. usable is good. is spacious")], "doc_id long, text string"))
    arcs = {(r.sent_idx, r.word): (r.dep, r.head_word, r.subj_lemma, r.negated) for r in tokens.filter("dep in ('acomp', 'amod')").collect()}
    assert arcs == {(0, "spacious"): ("acomp", "is", "room", False), (1, "usable"): ("acomp", "is", "room", True), (2, "famous"): ("amod", "room", None, False), (4, "spacious"): ("acomp", "is", None, False)}
    assert sorted((r.lemma, r.child, r.word) for r in G.governed(tokens).collect()) == [("room", "acomp", "spacious"), ("room", "acomp", "usable"), ("room", "amod", "famous")]
    assert {r.lemma: r.a_share for r in G.unigrams(tokens, 0.0, 0.0).collect()}["room"] == 1.0
    lexicon = spark.createDataFrame([("spacious", 0.5, 0.0, 0.5), ("usable", 0.25, 0.0, 0.75), ("famous", 0.0, 0.125, 0.8)], "token string, pos double, neg double, obj double")
    assert [tuple(r) for r in S.adjective_noun(tokens, lexicon).collect()] == [(1, "room", 0.5 - 0.25 - 0.125)]


def test_starts_of_tokens(spark):
    text = "wow -- the  room, (is) ok. next  one"
    tokens = A.with_starts(A.token_table(spark.createDataFrame([(1, text)], "doc_id long, text string"))).collect()
    sents = ["wow -- the  room, (is) ok.", "next  one"]
    assert len(tokens) == 7 and all(sents[r.sent_idx][r.start :].startswith(r.word) for r in tokens)


def test_senses(spark):
    rows = [("x", 1, "n", 1), ("x", 2, "s", 1), ("x", 3, "a", 1), ("y", 1, "n", 1), ("y", 2, "a", 2), ("z", 1, "a", 2), ("z", 2, "r", 1), ("z", 3, "a", 1)]
    senses = spark.createDataFrame([(*r, 0.5, 0.25) for r in rows], "token string, place int, cls string, number int, pos double, neg double")
    assert {(r.token, r.place) for r in S.preferred_sense(senses).collect()} == {("x", 2), ("y", 1), ("z", 3)}


def test_contained(spark):
    rng = random.Random(2)
    strings = {"".join(rng.choice("abcé ") for _ in range(rng.randint(0, 9))) for _ in range(300)} | {"a_b%c", "ab"}
    words = {"".join(rng.choice("abcé") for _ in range(rng.randint(0, 5))) for _ in range(150)} | {"_", "%", "zzz", "ab "}
    df = contained(spark.createDataFrame([(w,) for w in words], "word string"), spark.createDataFrame([(s,) for s in strings], "string string"))
    assert {tuple(r) for r in df.collect()} == {(w, s) for w in words for s in strings if w and w in s}
    plan = df._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_han_words(spark):
    rng = random.Random(4)
    alphabet = "天地人大小中"
    words = {"".join(rng.choice(alphabet) for _ in range(n)): rng.randint(2, 5000) for n in (1, 1, 2, 2, 2, 2, 2, 2, 3, 3, 3, 4)}
    total = sum(words.values())
    runs = ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 11))) for _ in range(60)]

    def best(run):
        """Over all splits."""
        if not run:
            return 0.0, []
        options = []
        for n in range(1, min(4, len(run)) + 1):
            if n == 1 or run[:n] in words:
                score, rest = best(run[n:])
                options.append((math.log(words.get(run[:n], 1) / total) + score, n, [run[:n], *rest]))
        top = max(options, key=lambda o: (round(o[0], 9), o[1]))
        return top[0], top[2]

    docs = spark.createDataFrame([(i, f"Go_1, {r}! é{r}") for i, r in enumerate(runs)] + [(900, None), (901, "..."), (902, "中" * 300)], "doc_id long, text string")
    got = {r.doc_id: r.words for r in han_words(docs, spark.createDataFrame(list(words.items()), "word string, freq long"), 4).collect()}
    assert len(got) == 63 and got[900] == [] and got[901] == [] and "".join(got[902]) == "中" * 300

    def score(ws):
        return sum(math.log(words.get(w, 1) / total) for w in ws)

    for i, run in enumerate(runs):
        half = len(best(run)[1])
        assert got[i][0] == "Go_1" and got[i][1 + half] == "é" and "".join(got[i][1 : 1 + half]) == run
        assert got[i][1 : 1 + half] == got[i][2 + half :] and score(got[i][1 : 1 + half]) == pytest.approx(best(run)[0])


def test_lemmas(spark):
    words = ["dog", "boss", "glass", "churches", "wolves", "ladies", "firemen", "misses"]
    dictionary = [(w, "n") for w in ("dog", "boss", "glass", "church", "wolf", "lady", "fireman", "child", "as", "ba")] + [("run", "v"), ("make", "v"), ("mak", "v"), ("hope", "v"), ("be", "v"), ("fine", "a"), ("good", "a"), ("well", "r")]
    cases = {
        ("dogs", "n"): "dog", ("boss", "n"): "boss", ("glasses", "n"): "glass", ("churches", "n"): "church", ("wolves", "n"): "wolf", ("ladies", "n"): "lady", ("firemen", "n"): "fireman", ("children", "n"): "child",
        ("making", "v"): "mak", ("hoped", "v"): "hope", ("was", "v"): "be", ("runs", "v"): "run", ("finest", "a"): "fine", ("better", "a"): "good", ("best", "r"): "well", ("quickly", "r"): "quickly", ("unknowns", "n"): "unknowns",
        ("dogss", "n"): "dog", ("dogs", "r"): "dogs", ("basses", "n"): "ba", ("", "n"): "",
    }
    assert len(words) == 8
    asked = spark.createDataFrame([*cases, ("x", None)], "word string, cls string")
    got = lemmatized(asked, spark.createDataFrame(dictionary, "word string, cls string"), spark.createDataFrame(IRREGULAR, "word string, cls string, lemma string")).collect()
    assert {(r.word, r.cls): r.lemma for r in got if r.cls is not None} == cases


def plain_snippet(txt, asp_idx, most):
    reach, frag = 10, txt
    while len(frag) > most:
        stacked = np.hstack([0, np.cumsum([len(w) for w in txt.split(" ")])])
        places = np.arange(stacked.shape[0]) + stacked
        where = np.searchsorted(places, asp_idx)
        start, end = places[min(max(0, where - reach), len(places) - 1)], places[min(where + reach + 1, len(places) - 1)]
        frag = txt[start:end]
        reach -= 1
    return frag.strip()


def test_snippets(spark):
    rng = random.Random(6)
    rows = []
    for _ in range(400):
        text = " ".join("x" * rng.choice([0, 1, 3, 7, 12, 40]) + rng.choice(["é", ""]) for _ in range(rng.randint(1, 60)))
        rows.append((text, rng.randint(0, max(0, len(text) - 1)), rng.choice([10, 30, 80])))
    df = spark.createDataFrame(rows, "x string, at int, most int")
    for most in (10, 30, 80):
        got = df.filter(F.col("most") == most).select("x", "at", T.snippet(F.col("x"), F.col("at"), most).alias("s")).collect()
        assert [(r.x, r.at, r.s) for r in got] == [(r.x, r.at, plain_snippet(r.x, r.at, most)) for r in got]


PAGES = {
    '<script>var a = {\n"x": 1}\n;</script>': {"x": 1},
    "{a: 'it', b: \"it's\"}": {"a": "it", "b": "it's"},
    '{a: "x" || "", b: 2}': {"a": "x", "b": 2},
    '{a: encodeURIComponent("u v"), b: (3)}': {"a": "u v", "b": 3},
    '{a: encodeURIComponent("u" || "")}': {"a": "u"},
    "{awardYear:  0000, n: -007, z: 0, f: 0.50}": {"awardYear": 0, "n": -7, "z": 0, "f": 0.5},
    '{name : "Online Shopper", $y_1: true}': {"name": "Online Shopper", "$y_1": True},
    "{a: 1, b: false, c: null, d: {e: 2}, f: [1]}": {"a": 1, "b": False, "c": None, "d": {"e": 2}, "f": [1]},
    r'{a: "left\right and one\two"}': {"a": "left right and one two"},
    "{a: [1, 2, ], b: {c: 1, }, }": {"a": [1, 2], "b": {"c": 1}},
    '{a: ""Beginner" Shopper", b: 1}': {"a": "Beginner Shopper", "b": 1},
    r'{a: "N\\A", b: "n\\\\a"}': {"a": "n/a", "b": "n/a"},
    "{note: \"k: 1, {x}, 'q' || ) ]\", t: 'say \"hi\", it\\'s'}": {"note": "k: 1, {x}, 'q' || ) ]", "t": 'say "hi", it\'s'},
    "{a: undefined, 'b': 1, http: 'http://x/y?z=1'}": {"a": None, "b": 1, "http": "http://x/y?z=1"},
}


def test_page_data(spark):
    got = spark.createDataFrame([(k,) for k in PAGES] + [("none",), (None,)], "x string").select("x", P.page_data(F.col("x")).alias("y")).collect()
    assert {r.x: json.loads(r.y) for r in got if r.x in PAGES} == PAGES
    assert {r.x: r.y for r in got if r.x not in PAGES} == {"none": "", None: None}


def test_file_order_over_several_splits(spark, tmp_path):
    rng = random.Random(9)
    lines = [f"{rng.choice('zyxabc')}{i}: {7 - i // 40}" for i in range(400)]
    (tmp_path / "r.txt").write_text("\n".join([*lines[:5], "no colon", "", *lines[5:]]) + "\n")
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    try:
        ranking = files.read_ranking(spark, f"{tmp_path}/r.txt")
        assert files.numbered_lines(spark, f"{tmp_path}/r.txt").rdd.getNumPartitions() > 3
        assert [(f"{r.word}: {r.value:g}", r["rank"]) for r in ranking.orderBy("rank").collect()] == [(x, i + 1) for i, x in enumerate(lines)]
        first = files.read_ranking(spark, f"{tmp_path}/r.txt", 7).orderBy("rank").collect()
        assert [f"{r.word}: {r.value:g}" for r in first] == lines[:7] and [r["rank"] for r in first] == [1, 2, 3, 4, 5, 6, 7]
        assert [r.term for r in files.read_term_list(spark, f"{tmp_path}/r.txt", 6).orderBy("rank").collect()] == [*lines[:5], "no colon"]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_classes_of_tags_and_quotes(spark):
    row = spark.range(1).select(*[P.word_class(F.lit(t)).alias(t) for t in ("JJR", "RB", "NNS", "VBZ", "DT")], P.plain_quotes(F.lit("‘a’ “b”")).alias("q"), T.strip(F.lit("\t x\n")).alias("s"), P.report_line((F.lit("abc"), 5), (F.lit(12), 1)).alias("r")).first()
    assert tuple(row) == ("a", "r", "n", "v", None, "'a' \"b\"", "x", "abc  1")


def test_noun_sums_need_no_exchange_by_document(spark):
    docs = spark.createDataFrame([(i, "The room is spacious. Rooms and rooms, good view.") for i in range(20)], "doc_id long, text string")
    found = G.unigrams(A.token_table(docs.repartition("doc_id")), 0.0, 0.0)
    assert "doc_id" not in found._jdf.queryExecution().executedPlan().toString()
    assert {(r.lemma, r.n_occ, r.n_sents, r.n_reviews, r.a_share) for r in found.collect()} >= {("room", 60, 40, 20, 1.0)}


def test_governors_are_derived_once(spark):
    tokens = A.token_table(spark.createDataFrame([(1, "the room is spacious")], "doc_id long, text string"))
    assert " OR isnotnull(" not in G.governed(tokens)._jdf.queryExecution().optimizedPlan().toString()


def test_rare_keys_are_exchanged_and_frequent_ones_not(spark):
    rows = spark.createDataFrame([(i % 50, i) for i in range(1000)], "k long, v long")
    table = spark.createDataFrame([(k, f"x{k}", k) for k in range(0, 80, 2)], "k long, name string, n long")
    here, moved = met(rows, table, ["k"], "n", most=30)
    assert {r.k for r in moved.collect()} == set(range(0, 20, 2)) and {r.k for r in here.collect()} == set(range(20, 50, 2))
    assert sorted(map(tuple, here.unionByName(moved).collect())) == sorted((i % 50, i, f"x{i % 50}") for i in range(1000) if i % 2 == 0)
    assert sieved(rows, table.filter("k = 4"), ["k"]).count() < 500 and met(rows, table, ["k"], "n")[1] is None


def test_aspects_are_grouped_by_review_in_their_place(spark):
    docs = spark.createDataFrame([(i, "alpha beta gamma. the alpha beta. good room") for i in range(20)], "doc_id long, text string")
    tokens = A.token_rows(kept_apart("sentences", 3, "doc_id", A.sentence_table(docs.repartition(3, "doc_id"))))
    near = G.noun_neighbours(tokens)
    found = G.bigrams(tokens, 2, near=near)
    places = G.bigram_places(found.localCheckpoint(), near, 3)
    where = G.trigram_places(G.trigrams(places).localCheckpoint(), places, 3)
    for rows, lemma in zip(G.aspect_rows(tokens, places, where), ("room", "alpha beta", "alpha beta gamma"), strict=True):
        per = rows.groupBy("lemma", "doc_id").count()
        assert "Exchange" not in per._jdf.queryExecution().executedPlan().toString() and per.filter(F.col("lemma") == lemma).count() == 20


def test_rare_words_of_a_lexicon_count_like_frequent_ones(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"good rooms and w{i % 7} never w{i % 5}. greatly nicely badly slowly surely x{i}") for i in range(40)], "doc_id long, text string")
    tokens = A.token_table(docs)
    counts = tokens.groupBy(F.col("word").alias("term")).agg(F.count("*").alias("n"))
    lexicon = S.hash_lexicon(counts).localCheckpoint()
    weights = counts.select(F.lit(1).alias("doc_id"), "term", F.lit(2.0).alias("w"))
    told = lambda: [sorted(map(tuple, f.collect())) for f in (S.sentence_scores(tokens, lexicon), S.noun_scores(tokens, lexicon, A.NOUNS), S.all_words(weights, lexicon), S.objective_words(tokens, lexicon, S.sentence_polarity(tokens, lexicon)))]
    whole = told()
    monkeypatch.setattr("reviewloom.operators.shared.BROADCAST_ROWS", 3)
    assert told() == whole and all(whole) and len(whole[2]) == counts.count()
