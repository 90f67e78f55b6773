"""Queries over nested records, saved responses, pages, scraped texts and ablation sets, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import parsing as P
from ..operators import features as X
from ..operators import records as R
from ..operators import rowstats as S
from ..operators.shared import written
from ..sources.files import with_index
from .registry import Tables, query
from .text_queries import W_, weights

_NESTED = "key bigint, author string, ratings struct<price:int,ease:int,delivery:struct<time:int>>"


def nested(t: Tables) -> DataFrame:
    """Orders as nested reviews, read from JSON: ratings from 0 to 4, -1 where missing."""
    k = F.col("o_orderkey")
    score = lambda n: (F.pmod(k, F.lit(n)) - 1).cast("int")
    ratings = F.struct(score(5).alias("price"), score(4).alias("ease"), F.struct(score(3).alias("time")).alias("delivery"))
    text = F.to_json(F.struct(k.alias("key"), F.col("o_orderpriority").alias("author"), ratings.alias("ratings")))
    return t.orders.select(F.from_json(text, _NESTED).alias("r")).select("r.*")


@query("""SELECT o_orderkey AS key, o_orderpriority AS author, nullif(o_orderkey % 5 - 1, -1)::INT AS ratings_price, nullif(o_orderkey % 4 - 1, -1)::INT AS ratings_ease,
 nullif(o_orderkey % 3 - 1, -1)::INT AS ratings_delivery_time FROM orders""")
def nested_flatten(t: Tables) -> DataFrame:
    return R.flattened(nested(t), -1)


@query("SELECT o_orderkey AS key FROM orders WHERE o_orderkey % 5 - 1 >= 2 AND o_orderkey % 3 - 1 <> -1")
def nested_filter(t: Tables) -> DataFrame:
    return nested(t).filter((F.col("ratings.price") >= 2) & (F.col("ratings.delivery.time") != -1)).select("key")


@query("SELECT event_id // 500 AS page, event_id AS id, event_type AS text FROM events")
def response_rows(t: Tables) -> DataFrame:
    rows = F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("text"))
    page = t.events.groupBy(F.floor(F.col("event_id") / 500).alias("page")).agg(F.collect_list(rows).alias("reviews"))  # 500 at most
    saved = page.select("page", F.to_json(F.struct(F.struct("reviews").alias("data"))).alias("body"))
    return R.response_rows(saved, "body", "data struct<reviews:array<struct<id:bigint,text:string>>>", "data.reviews")


@query("""WITH p AS (SELECT user_id, event_id, event_id % 7 = 0 AS empty FROM events), e AS (SELECT user_id, min(event_id) AS last FROM p WHERE empty GROUP BY user_id)
 SELECT user_id, event_id FROM p LEFT JOIN e USING (user_id) WHERE last IS NULL OR event_id < last""")
def paged_until_empty(t: Tables) -> DataFrame:
    rows = F.when(F.col("event_id") % 7 == 0, F.array().cast("array<string>")).otherwise(F.array("event_type"))
    return R.until_empty(t.events.select("user_id", "event_id", rows.alias("rows")), "user_id", "event_id", "rows").select("user_id", "event_id")


@query("SELECT r_name AS subject, n_name AS name, n_nationkey::BIGINT AS ranking FROM nation JOIN region ON n_regionkey = r_regionkey")
def json_table_rankings(t: Tables) -> DataFrame:
    row = F.struct(F.concat(F.lit(" "), "n_name", F.lit(" ")).alias("name"), F.col("n_nationkey").cast("string").alias("ranking"))
    tables = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.collect_list(row).alias("data"))
    saved = tables.select(F.col("r_name").alias("subject"), F.to_json(F.struct("data")).alias("body"))
    found = R.response_rows(saved, "body", "data array<struct<name:string,ranking:string>>", "data")
    return found.select("subject", F.trim("name").alias("name"), F.col("ranking").try_cast("long").alias("ranking"))


@query("""WITH m AS (SELECT page_id, regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a></li>', 1) AS h, regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a></li>', 2) AS s FROM pages)
 SELECT page_id, i - 1 AS place, h[i] AS link, s[i] AS shown FROM m, unnest(range(1, len(h) + 1)) AS u(i)""")
def repeated_nodes(t: Tables) -> DataFrame:
    """One row of several fields for each list item of a page's navigation."""
    item = F.lit('<li><a href="([^"]*)">([^<]*)</a></li>')
    fields = F.arrays_zip(F.regexp_extract_all("html", item, F.lit(1)).alias("link"), F.regexp_extract_all("html", item, F.lit(2)).alias("shown"))
    return t.pages.select("page_id", F.posexplode(fields).alias("place", "f")).select("page_id", F.col("place").cast("long").alias("place"), "f.link", "f.shown")


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN lang END AS label, doc_id % 3 <> 1 AS raw, 'd/' || source || CASE doc_id % 3 WHEN 0 THEN '__' || lang WHEN 1 THEN '_split_1' ELSE '' END || '__std.csv' AS made FROM documents")
def file_labels(t: Tables) -> DataFrame:
    k = F.col("doc_id") % 3
    path = F.concat(F.lit("d/"), "source", F.when(k == 0, F.concat(F.lit("__"), "lang")).when(k == 1, "_split_1").otherwise(""), F.lit(".csv"))
    return t.documents.select("doc_id", P.file_label(path).alias("label"), P.unsplit_csv(path).alias("raw"), P.output_name(path, "__std.csv").alias("made"))


@query("SELECT count(*) FILTER (event_id % 10 <> 0) AS good, count(*) FILTER (event_id % 10 = 0) AS bad, sum((props->>'$.k')::BIGINT) FILTER (event_id % 10 <> 0)::BIGINT AS k FROM events")
def bad_records(t: Tables) -> DataFrame:
    body = F.when(F.col("event_id") % 10 == 0, F.lit('{"k": ')).otherwise(F.col("props"))
    good, bad = R.parsed_or_bad(t.events.select("event_id", body.alias("body")), "body", "k bigint")
    return good.agg(F.count("*").alias("good"), F.sum("k").alias("k")).join(bad.agg(F.count("*").alias("bad"))).select("good", "bad", "k")


@query("SELECT row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS place, o_orderkey FROM orders")
def indexed_rows(t: Tables) -> DataFrame:
    return with_index(t.orders.select("o_orderdate", "o_orderkey"), ["o_orderdate", "o_orderkey"], "place").select("place", "o_orderkey")


@query("WITH " + W_ + " SELECT doc_id, term FROM w WHERE NOT regexp_matches(term, '[0-9_]')")
def plain_terms(t: Tables) -> DataFrame:
    return weights(t).filter(~F.col("term").rlike(r"[0-9_]")).select("doc_id", "term")


@query("SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def sentence_marks(t: Tables) -> DataFrame:
    """Turns joined with a mark after each, then the marks left out."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "text")))
    marked = t.conversations.groupBy("conv_id").agg(F.array_join(F.transform(turns, lambda x: F.concat(x["text"], F.lit(" ###"))), " ").alias("m"))
    kept = F.filter(F.split("m", " "), lambda w: ~w.startswith("###"))
    return marked.select("conv_id", F.array_join(kept, " ").alias("text"))


@query("SELECT event_id, CASE user_id % 4 WHEN 0 THEN 'food' WHEN 1 THEN 'hotel' WHEN 2 THEN 'car' END AS category FROM events")
def category_names(t: Tables) -> DataFrame:
    names = F.create_map(F.lit(0), F.lit("food"), F.lit(1), F.lit("hotel"), F.lit(2), F.lit("car"))
    return t.events.select("event_id", F.element_at(names, (F.col("user_id") % 4).cast("int")).alias("category"))


@query("""SELECT o_orderkey, o_orderkey || '/' || (o_orderkey + 1) AS ratio, o_orderkey::INT AS head, (o_orderkey * 1000)::DOUBLE AS miles, (o_orderkey + 0.5)::DOUBLE AS hours,
 'it''s "' || o_orderkey || '"' AS quoted, CASE o_orderkey % 3 WHEN 0 THEN 'ab' WHEN 1 THEN '###' ELSE '' END AS letters FROM orders""")
def scraped_numbers(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    of = F.concat(k.cast("string"), F.lit(" of "), (k + 1).cast("string"))
    miles = F.concat(F.lit("Mileage: "), F.format_number(k * 1000, 0), F.lit(" miles"))
    hours = F.concat(k.cast("string"), F.lit(".5 hrs on record"))
    return t.orders.select(
        "o_orderkey", P.as_ratio(of).alias("ratio"), P.ratio_head(of).alias("head"), P.amount_before(miles, "miles").alias("miles"), P.amount_before(hours, "hrs").alias("hours"),
        P.plain_quotes(F.concat(F.lit("it’s “"), k.cast("string"), F.lit("”"))).alias("quoted"),
        P.first_letters_or_mark(F.concat(k.cast("string"), F.element_at(F.array(F.lit("ab12cd"), F.lit("##4####x"), F.lit("##")), (k % 3 + 1).cast("int")))).alias("letters"),
    )


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d') AS folder, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderdate::DATE END AS d FROM orders")
def split_dates(t: Tables) -> DataFrame:
    d = F.col("o_orderdate").cast("timestamp")
    shown = F.when(F.col("o_orderkey") % 3 == 0, F.date_format(d, "M-d")).otherwise(F.date_format(d, "yyyy-M-d"))
    return t.orders.select("o_orderkey", P.folder_day(d).alias("folder"), P.date_of_parts(shown).alias("d"))


@query("SELECT conv_id, string_agg(DISTINCT role, ', ' ORDER BY role) || ', any' AS tags FROM conversations GROUP BY conv_id")
def joined_tags(t: Tables) -> DataFrame:
    """The roles of a conversation as tags, with one that all have."""
    tags = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_set("role")).alias("tags"))
    return tags.select("conv_id", F.array_join(F.array_union("tags", F.array(F.lit("any"))), ", ").alias("tags"))


@query("SELECT doc_id, lang, (dense_rank() OVER (ORDER BY lang) - 1)::INT AS code FROM documents")
def label_codes(t: Tables) -> DataFrame:
    return X.encoded_labels(t.documents.select("doc_id", "lang"), "lang").select("doc_id", "lang", "code")


@query("SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS place FROM documents WHERE n_chars > 100 ORDER BY doc_id LIMIT 5000")
def ordered_head(t: Tables) -> DataFrame:
    """The first 5000 documents, by identifier, that pass a filter: the limit is the feature."""
    head = t.documents.filter("n_chars > 100").select("doc_id").orderBy("doc_id").limit(5000)
    return with_index(head, ["doc_id"], "place").select("doc_id", (F.col("place") + 1).alias("place"))


_CHOSEN = """chosen AS (SELECT term, row_number() OVER (ORDER BY count(*) DESC, term) % 2 = 1 AS appears FROM w GROUP BY term ORDER BY count(*) DESC, term LIMIT 10),
 means AS (SELECT term, avg(w) AS mean_w FROM w WHERE doc_id % 10 < 7 AND w > 0 GROUP BY term), test AS (SELECT * FROM w WHERE doc_id % 10 >= 7),
 removed AS (SELECT doc_id, term, w FROM test ANTI JOIN chosen USING (term)),
 sub AS (SELECT * FROM removed UNION ALL SELECT doc_id, term, mean_w FROM (SELECT DISTINCT doc_id FROM test), chosen JOIN means USING (term) WHERE appears)"""


def _ablation(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Test rows, means of the training rows, and ten terms in turn to appear and not to."""
    w = written(weights(t), "weights")
    top = X.ranked(w.groupBy("term").agg(F.count("*").alias("n")), "n", 10)
    chosen = written(top.select("term", (F.col("rank") % 2 == 1).alias("appears")), "chosen")
    return w.filter("doc_id % 10 >= 7"), X.mean_nonzero(w, F.col("doc_id") % 10 < 7), chosen


@query("WITH " + W_ + ", " + _CHOSEN + " SELECT doc_id, term, round(w, 6) AS w, 'pos' AS class FROM sub")
def ablation_substituted(t: Tables) -> DataFrame:
    test, means, chosen = _ablation(t)
    return X.substituted(test, means, chosen).select("doc_id", "term", F.round("w", 6).alias("w"), F.lit("pos").alias("class"))


@query("WITH " + W_ + ", " + _CHOSEN + " SELECT doc_id, term, round(w, 6) AS w FROM removed")
def ablation_removed(t: Tables) -> DataFrame:
    test, _, chosen = _ablation(t)
    return X.removed(test, chosen).select("doc_id", "term", F.round("w", 6).alias("w"))


@query("WITH " + W_ + ", " + _CHOSEN + " SELECT doc_id, term, round(w, 6) AS w, 'pos' AS class FROM test")
def ablation_class_changed(t: Tables) -> DataFrame:
    """The untouched test rows under one class."""
    test, _, _ = _ablation(t)
    return X.class_changed(test, "pos").select("doc_id", "term", F.round("w", 6).alias("w"), "class")


@query("WITH " + W_ + ", " + _CHOSEN + " SELECT doc_id, term, round(w, 6) AS w, 'pos' AS class FROM removed")
def ablation_removed_class_changed(t: Tables) -> DataFrame:
    test, _, chosen = _ablation(t)
    return X.class_changed(X.removed(test, chosen), "pos").select("doc_id", "term", F.round("w", 6).alias("w"), "class")


@query("""SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_orderkey % 5 > 0 AND o_orderkey % 7 > 0 AND o_orderkey % 11 > 0 AND o_orderkey % 3 <> 0""")
def filter_complete(t: Tables) -> DataFrame:
    """Rows of one status with all scores and a text; -1 and null scores, empty and null texts are missing."""
    k = F.col("o_orderkey")
    scores = [k % 5 - 1, F.when(k % 7 > 0, k % 7 - 1), k % 11 - 1]
    content = F.when(k % 6 == 0, "").when(k % 3 != 0, "text")
    scores = [F.when(s >= 0, s).otherwise(-1) if i != 1 else s for i, s in enumerate(scores)]
    return t.orders.filter((F.col("o_orderstatus") == "O") & S.complete(scores, content)).select("o_orderkey")


@query("""WITH u AS (SELECT event_id, user_id AS n FROM events) SELECT event_id, CASE event_id % 7 WHEN 0 THEN n WHEN 1 THEN n END AS store, CASE event_id % 7 WHEN 0 THEN event_id WHEN 1 THEN event_id END AS review,
 CASE event_id % 7 WHEN 2 THEN n END AS profile, CASE event_id % 7 WHEN 3 THEN n END AS forum, CASE event_id % 7 WHEN 4 THEN n END AS member, CASE event_id % 7 WHEN 5 THEN n END AS topic, CASE event_id % 7 WHEN 6 THEN n END AS company FROM u""")
def link_ids(t: Tables) -> DataFrame:
    """Identifiers of stores, reviews, profiles, forums, users, topics and companies in links."""
    n, e = F.col("user_id").cast("string"), F.col("event_id").cast("string")
    cat = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    shapes = [cat("http://a.b/c/", n, "/", e), cat("https://a.b/", n, "/", e, "?x"), cat("http://s.c/profiles/", n, "/"), cat("http://x/forumdisplay.php?fid=", n, "&page=2"), cat("/home?uid=", n, "&a=1"), cat("http://s.d/topic/", n, "?q"), cat("https://h/company/", n, "/kuchikomi/")]
    url = F.element_at(F.array(*shapes), (F.col("event_id") % 7 + 1).cast("int"))
    names = {"store": "store", "review": "review", "profile": "profile", "forum": "forum", "member": "user", "topic": "topic", "company": "company"}
    return t.events.select("event_id", *[P.link_id(url, kind).alias(name) for name, kind in names.items()])


@query("""SELECT event_id, CASE WHEN event_id % 4 > 0 THEN event_type END AS theme, (event_id % 4 >= 3 OR event_type = 'error' AND event_id % 4 > 0) AS has_error FROM events WHERE event_id % 5 <> 0 ORDER BY ts DESC, event_id DESC""")
def response_firsts(t: Tables) -> DataFrame:
    """Of responses that have data, newest first, the first theme's label, if there is one, and whether a label is among
    them."""
    themes = F.slice(F.array(*[F.struct(F.when(F.lit(i) == 0, F.col("event_type")).otherwise(F.when(F.lit(i) == 2, "error").otherwise("x")).alias("label")) for i in range(3)]), F.lit(1), (F.col("event_id") % 4).cast("int"))
    data = F.when(F.col("event_id") % 5 != 0, F.struct(themes.alias("themes")))
    saved = t.events.select("event_id", "ts", F.from_json(F.to_json(F.struct(data.alias("data"))), "data struct<themes:array<struct<label:string>>>").alias("r"))
    held = saved.filter(F.col("r.data").isNotNull()).orderBy(F.desc("ts"), F.desc("event_id"))
    labels = F.transform("r.data.themes", lambda x: x["label"])
    return held.select("event_id", F.get("r.data.themes", 0)["label"].alias("theme"), F.array_contains(labels, "error").alias("has_error"))
