"""Queries over scores, orders, events and pages, with SQL for each that SQL can express."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import parsing as P
from ..functions import text as T
from ..operators import records as R
from ..operators import rowstats as S
from .registry import Tables, query

#: Nine scores of a line, -1 where missing, and the same in SQL.
SCORES = [f"pmod(l_partkey * {i} + l_linenumber, 12) - 1" for i in range(1, 10)]
_SQL_SCORES = ", ".join(f"((l_partkey * {i} + l_linenumber) % 12 - 1)::DOUBLE" for i in range(1, 10))
STATS = (
    "v AS (SELECT l_orderkey, l_linenumber, l_partkey, list_filter([" + _SQL_SCORES + """], lambda x: x <> -1) AS v FROM lineitem),
 m AS (SELECT *, CASE WHEN len(v) > 0 THEN list_sum(v) / len(v) END AS mean FROM v),
 s AS (SELECT *, list_sum(list_transform(v, lambda x: (x - mean) ** 2)) / len(v) AS m2, list_sum(list_transform(v, lambda x: (x - mean) ** 3)) / len(v) AS m3,
   list_sum(list_transform(v, lambda x: (x - mean) ** 4)) / len(v) AS m4 FROM m),
 t AS (SELECT *, m2 AS variance, CASE WHEN m2 < 1e-12 THEN 0 ELSE m3 / m2 ** 1.5 END AS skewness,
   CASE WHEN m2 < 1e-12 THEN -3 ELSE m4 / m2 ** 2 - 3 END AS kurtosis, list_max(v) - list_min(v) AS range FROM s)"""
)


def scored(t: Tables) -> DataFrame:
    vals = S.present([F.expr(s) for s in SCORES])
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", vals.alias("v"))


def _stat(t: Tables, name: str) -> DataFrame:
    return scored(t).select("l_orderkey", "l_linenumber", "l_partkey", F.round(S.curated(name, F.col("v")), 6).alias(name))


def _stat_sql(name: str) -> str:
    return f"WITH {STATS} SELECT l_orderkey, l_linenumber, l_partkey, round({name}, 6) AS {name} FROM t"


@query(_stat_sql("variance"))
def row_variance(t: Tables) -> DataFrame:
    return _stat(t, "variance")


@query(_stat_sql("skewness"))
def row_skewness(t: Tables) -> DataFrame:
    return _stat(t, "skewness")


@query(_stat_sql("kurtosis"))
def row_kurtosis(t: Tables) -> DataFrame:
    return _stat(t, "kurtosis")


@query(_stat_sql("range"))
def row_range(t: Tables) -> DataFrame:
    return _stat(t, "range")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity >= 25 THEN 'pos' ELSE 'neg' END AS label FROM lineitem")
def curated_label(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", S.label(F.col("l_quantity"), 25).alias("label"))


def _split(t: Tables, name: str, presets: dict = S.PRESETS) -> DataFrame:
    return _stat(t, name).groupBy(S.interval_name(F.col(name), presets[name]).alias("part")).agg(F.count("*").alias("n"))


def _split_sql(name: str, presets: dict = S.PRESETS) -> str:
    def held(i: S.Interval) -> str:
        low = "true" if i.low is None else f"x {'>=' if i.low_in else '>'} {i.low}"
        return low + (" AND true" if i.high is None else f" AND x {'<=' if i.high_in else '<'} {i.high}")

    parts = " ".join(f"WHEN {held(i)} THEN '{i.name}'" for i in presets[name])
    return f"WITH {STATS}, x AS (SELECT round({name}, 6) AS x FROM t) SELECT CASE {parts} END AS part, count(*) AS n FROM x GROUP BY ALL"


@query(_split_sql("variance"))
def interval_split_variance(t: Tables) -> DataFrame:
    return _split(t, "variance")


@query(_split_sql("skewness"))
def interval_split_skewness(t: Tables) -> DataFrame:
    return _split(t, "skewness")


@query(_split_sql("kurtosis"))
def interval_split_kurtosis(t: Tables) -> DataFrame:
    return _split(t, "kurtosis")


@query(_split_sql("variance", S.COARSE_PRESETS))
def interval_split_variance_coarse(t: Tables) -> DataFrame:
    return _split(t, "variance", S.COARSE_PRESETS)


@query(_split_sql("kurtosis", S.COARSE_PRESETS))
def interval_split_kurtosis_coarse(t: Tables) -> DataFrame:
    return _split(t, "kurtosis", S.COARSE_PRESETS)


@query(_split_sql("range"))
def interval_split_range(t: Tables) -> DataFrame:
    return _split(t, "range")


@query("SELECT quality AS cls, count(*) AS n, rank() OVER (ORDER BY count(*) DESC, quality DESC) = 1 AS major FROM labels GROUP BY quality")
def class_counts(t: Tables) -> DataFrame:
    n = t.labels.groupBy(F.col("quality").alias("cls")).agg(F.count("*").alias("n"))
    return n.withColumn("major", F.rank().over(W.orderBy(F.desc("n"), F.desc("cls"))) == 1)


_DRAWN = """WITH r AS (SELECT doc_id AS id, quality AS cls, row_number() OVER (PARTITION BY quality ORDER BY md5(doc_id || '#41'), doc_id) AS place,
 count(*) OVER (PARTITION BY quality) AS n FROM labels), g AS (SELECT {}(n) AS target FROM r)
 SELECT id, cls, unnest(range(((target - place) // n + 1)::BIGINT))::INT AS copy FROM r, g WHERE place <= target"""


@query(_DRAWN.format("max"))
def oversample(t: Tables) -> DataFrame:
    return S.resampled(t.labels.select(F.col("doc_id").alias("id"), F.col("quality").alias("cls")), "cls", "major")


@query(_DRAWN.format("min"))
def downsample(t: Tables) -> DataFrame:
    return S.resampled(t.labels.select(F.col("doc_id").alias("id"), F.col("quality").alias("cls")), "cls", "minor")


@query("SELECT doc_id, ('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT % 100 < 70 AS train FROM documents")
def hash_split(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", S.hash_split(F.col("doc_id"), 70).alias("train"))


@query("SELECT source, count(*) AS n FROM documents GROUP BY source")
def store_counts(t: Tables) -> DataFrame:
    return t.documents.groupBy("source").agg(F.count("*").alias("n"))


@query("SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL")
def make_model_counts(t: Tables) -> DataFrame:
    return t.documents.groupBy("lang", "source").agg(F.count("*").alias("n"))


@query("SELECT lang, list_sort(list(DISTINCT source)) AS sources FROM documents GROUP BY lang")
def distinct_nested(t: Tables) -> DataFrame:
    return t.documents.groupBy("lang").agg(F.array_sort(F.collect_set("source")).alias("sources"))


_NINE = [f"s{i}" for i in range(1, 10)]
_NINE_SQL = ", ".join(f"(l_partkey * {i} + l_linenumber) % 12 - 1 AS s{i}" for i in range(1, 10))


def nine(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", *[F.expr(s).alias(n) for s, n in zip(SCORES, _NINE, strict=True)])


@query(f"SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, {_NINE_SQL} FROM lineitem) WHERE " + " AND ".join(f"{n} > -1" for n in _NINE))
def filter_all_scores(t: Tables) -> DataFrame:
    return nine(t).filter(F.forall(F.array(*_NINE), lambda v: v > -1)).select("l_orderkey", "l_linenumber", "l_partkey")


@query(f"SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, {_NINE_SQL} FROM lineitem) WHERE {' + '.join(_NINE)} > -9")
def filter_any_score(t: Tables) -> DataFrame:
    total = sum((F.col(n) for n in _NINE[1:]), F.col(_NINE[0]))
    return nine(t).filter(total > -9).select("l_orderkey", "l_linenumber", "l_partkey")


def condition(df: DataFrame, text: str) -> Column:
    """A filter written as `column operator value`, with <= >= != < > = or `exists` and `not exists`."""
    words = text.split()
    if words[1:] in (["exists"], ["not", "exists"]):
        return F.col(words[0]).isNotNull() if len(words) == 2 else F.col(words[0]).isNull()
    name, op, value = text.split(None, 2)
    operand = F.lit(value).cast(df.schema[name].dataType)
    ops = {"<=": "__le__", ">=": "__ge__", "!=": "__ne__", "<": "__lt__", ">": "__gt__", "=": "__eq__"}
    return getattr(F.col(name), ops[op])(operand)


@query("SELECT event_id FROM events WHERE value >= 5.5 AND event_type <> 'click' AND props IS NOT NULL")
def expr_filter(t: Tables) -> DataFrame:
    df = t.events
    for c in ("value >= 5.5", "event_type != click", "props exists"):
        df = df.filter(condition(df, c))
    return df.select("event_id")


@query("SELECT event_id, (value >= 9)::INT AS posneg FROM events")
def label_by_threshold(t: Tables) -> DataFrame:
    return t.events.select("event_id", (F.col("value") >= 9).cast("int").alias("posneg"))


@query("SELECT o_orderkey, CASE left(o_orderpriority, 1) WHEN '1' THEN 'neg' WHEN '2' THEN 'neg' ELSE 'pos' END AS label FROM orders")
def label_by_map(t: Tables) -> DataFrame:
    made = {"1": "neg", "2": "neg", "3": "pos", "4": "pos", "5": "pos"}
    table = t.spark.createDataFrame(list(made.items()), "k string, label string")
    joined = t.orders.withColumn("k", F.left("o_orderpriority", F.lit(1))).join(F.broadcast(table), "k", "left")
    return joined.select("o_orderkey", F.coalesce("label", F.raise_error(F.lit("a score has no label"))).alias("label"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN concat('new ', text) ELSE text END AS text FROM documents")
def update_join_text(t: Tables) -> DataFrame:
    changed = t.documents.filter("doc_id % 3 = 0").select("doc_id", F.concat(F.lit("new "), "text").alias("text"))
    return R.updated_text(t.documents.select("doc_id", "text"), changed, "doc_id", "text")


_FIRST_LINE = "(SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) = 1)"


def first_line(t: Tables) -> DataFrame:
    """The first line of each order: a 1:1 child."""
    return t.lineitem.groupBy("l_orderkey").agg(F.min(F.struct("l_linenumber", "l_partkey", "l_quantity")).alias("c")).select("l_orderkey", "c.*")


@query(f"SELECT o_orderkey, o_orderstatus, l_partkey FROM orders JOIN {_FIRST_LINE} ON o_orderkey = l_orderkey")
def parent_child_join(t: Tables) -> DataFrame:
    return t.orders.join(first_line(t), F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "o_orderstatus", "l_partkey")


@query("""WITH s AS (SELECT o_orderkey AS k, o_orderstatus AS v, o_orderdate AS moved FROM orders WHERE o_orderkey % 3 <> 0),
 b AS (SELECT o_orderkey AS k, 'new' AS v, o_orderdate + INTERVAL 1 DAY AS moved FROM orders WHERE o_orderkey % 2 = 0)
 SELECT s.k, s.v, coalesce(b.moved, s.moved) AS moved FROM s LEFT JOIN b USING (k) UNION ALL SELECT k, v, moved FROM b ANTI JOIN s USING (k)""")
def upsert_merge(t: Tables) -> DataFrame:
    o = t.orders.select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("v"), F.col("o_orderdate").alias("moved"))
    batch = o.filter("k % 2 = 0").select("k", F.lit("new").alias("v"), F.expr("moved + interval 1 day").alias("moved"))
    return R.upserted(o.filter("k % 3 <> 0"), batch, "k", "moved")


@query("""WITH p AS (SELECT r_regionkey + 1 AS id, r_name AS name FROM region WHERE r_regionkey < 3),
 b AS (SELECT r_name AS name, n_name AS subject FROM nation JOIN region ON n_regionkey = r_regionkey),
 e AS (SELECT id::BIGINT AS id, name FROM p UNION ALL SELECT (SELECT max(id) FROM p) + row_number() OVER (ORDER BY name), name FROM (SELECT DISTINCT name FROM b WHERE name NOT IN (SELECT name FROM p)))
 SELECT id, name, subject FROM b JOIN e USING (name)""")
def upsert_two_level(t: Tables) -> DataFrame:
    stored = t.region.filter("r_regionkey < 3").select((F.col("r_regionkey") + 1).cast("long").alias("id"), F.col("r_name").alias("name"))
    batch = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("name"), F.col("n_name").alias("subject"))
    return R.upserted_two_levels(stored, batch, "name", ["subject"])[1].select("id", "name", "subject")


@query(f"""SELECT o_orderkey AS pid, 'review' AS tab, o_orderstatus AS a, o_orderpriority AS b FROM orders
 UNION ALL SELECT l_orderkey, 'line', l_partkey::VARCHAR, l_linenumber::VARCHAR FROM {_FIRST_LINE} JOIN orders ON l_orderkey = o_orderkey
 UNION ALL SELECT o_orderkey, 'customer', c_name, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey""")
def normalize_three_tables(t: Tables) -> DataFrame:
    doc = t.orders.join(first_line(t), F.col("o_orderkey") == F.col("l_orderkey"), "left").join(t.customer, F.col("o_custkey") == F.col("c_custkey"), "left")
    part = lambda tab, a, b: doc.filter(F.col(a).isNotNull()).select(F.col("o_orderkey").alias("pid"), F.lit(tab).alias("tab"), F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b"))
    return part("review", "o_orderstatus", "o_orderpriority").unionByName(part("line", "l_partkey", "l_linenumber")).unionByName(part("customer", "c_name", "c_mktsegment"))


_EVENTS = "ev AS (SELECT 'u' || user_id AS url, ts, event_id, CASE WHEN event_type = 'error' THEN 'fail' WHEN event_type = 'purchase' AND user_id % 4 < 3 THEN 'succ' ELSE 'pend' END AS status FROM events)"


def crawled(t: Tables) -> DataFrame:
    """Every event as a visit of its user's link; a purchase is a success for three links in four."""
    success = (F.col("event_type") == "purchase") & (F.col("user_id") % 4 < 3)
    status = F.when(F.col("event_type") == "error", "fail").when(success, "succ").otherwise("pend")
    return t.events.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("url"), "ts", "event_id", status.alias("status"))


_STATUS = _EVENTS + ", st AS (SELECT url, CASE WHEN bool_or(status = 'succ') THEN 'succ' ELSE arg_max(status, (ts, event_id)) END AS status FROM ev GROUP BY url)"


@query("WITH " + _STATUS + " SELECT * FROM st")
def crawl_status(t: Tables) -> DataFrame:
    return R.crawl_status(crawled(t), "url", ["ts", "event_id"])


@query("WITH " + _STATUS + " SELECT event_id, url FROM ev WHERE url NOT IN (SELECT url FROM st WHERE status = 'succ')")
def dedupe_seen(t: Tables) -> DataFrame:
    rows = crawled(t)
    return R.unseen(rows.select("event_id", "url"), R.crawl_status(rows, "url", ["ts", "event_id"]), "url")


@query("""WITH w AS (SELECT item_id, string_split(text, ' ') AS ws FROM benchmark)
 SELECT item_id, lower(array_to_string(ws, ' ')) AS text FROM w""")
def inverted_abstract(t: Tables) -> DataFrame:
    words = t.benchmark.select("item_id", F.posexplode(F.split("text", " ")).alias("at", "word"))
    index = words.groupBy("item_id", "word").agg(F.collect_list("at").alias("places")).groupBy("item_id").agg(F.map_from_entries(F.collect_list(F.struct("word", "places"))).alias("index"))
    return R.inverted_text(index, "item_id", "index")


@query("SELECT event_id, (props->>'$.k')::INT AS k, to_json({'k': (props->>'$.k')::INT, 'v': [event_type]})::VARCHAR AS packed FROM events")
def json_field_extract(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k").try_cast("int")
    return t.events.select("event_id", k.alias("k"), F.to_json(F.struct(k.alias("k"), F.array("event_type").alias("v"))).alias("packed"))


@query("SELECT event_id, event_type AS kind, user_id AS who FROM events")
def js_repair(t: Tables) -> DataFrame:
    loose = F.concat(F.lit("{kind: '"), "event_type", F.lit("', who: "), F.col("user_id").cast("string"), F.lit(", }"))
    parsed = F.from_json(P.json_repaired(loose), "kind string, who bigint")
    return t.events.select("event_id", parsed.alias("p")).select("event_id", "p.kind", "p.who")


@query(r"SELECT page_id, md5(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '[ \t\n\r]+', ' ', 'g'))) AS text FROM pages")
def html_text(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.md5(P.plain_html(F.col("html"))).alias("text"))


@query("""SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS link FROM pages""")
def html_links(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.explode(P.links(F.col("html"))).alias("link"))


@query("""SELECT page_id, nullif(regexp_extract(url, '/([0-9]+)', 1), '')::BIGINT AS id, regexp_extract(url, '[?&]ref=([^&#]*)', 1) AS ref FROM pages""")
def url_ids(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.regexp_extract("url", "/([0-9]+)", 1).try_cast("long").alias("id"), F.regexp_extract("url", "[?&]ref=([^&#]*)", 1).alias("ref"))


@query("SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]+') || '/' AS domain, 'a ' || page_id || ' c%d ' || replace(url, '+', ' ') AS shown FROM pages")
def url_domain(t: Tables) -> DataFrame:
    return t.pages.select("page_id", P.domain(F.col("url")).alias("domain"), P.decoded(F.concat(F.lit("a+"), F.col("page_id").cast("string"), F.lit("%20c%25d+"), F.url_encode("url"))).alias("shown"))


@query("SELECT page_id, list_max(list_transform(regexp_extract_all(url, 'page=([0-9]+)', 1), lambda x: x::INT)) AS last_page FROM pages")
def max_page(t: Tables) -> DataFrame:
    found = F.regexp_extract_all("url", F.lit("page=([0-9]+)"), F.lit(1))
    return t.pages.select("page_id", F.array_max(F.transform(found, lambda x: x.cast("int"))).alias("last_page"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderdate::DATE END AS d1, o_orderdate::DATE AS d2, o_orderdate::DATE AS d3 FROM orders")
def parse_dates(t: Tables) -> DataFrame:
    d = F.col("o_orderdate").cast("timestamp")
    shown = F.when(F.col("o_orderkey") % 7 == 0, "").otherwise(F.date_format(d, "MMM d, yyyy"))
    return t.orders.select(
        "o_orderkey", P.month_day_year(shown).alias("d1"), P.cjk_date(F.date_format(d, "yyyy'年'M'月'd'日'")).alias("d2"),
        F.try_to_timestamp(F.date_format(d, "yyyy-MM-dd HH:mm"), F.lit("yyyy-MM-dd HH:mm")).cast("date").alias("d3"),
    )


@query("SELECT o_orderkey, strftime(o_orderdate - INTERVAL 8 HOUR, '%Y-%m-%d %H:%M:%S') AS utc FROM orders")
def local_to_utc(t: Tables) -> DataFrame:
    utc = P.to_utc(F.col("o_orderdate").cast("timestamp"))
    return t.orders.select("o_orderkey", F.date_format(utc, "yyyy-MM-dd HH:mm:ss").alias("utc"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN DATE '2024-03-10' WHEN 1 THEN DATE '2024-03-09' WHEN 2 THEN DATE '2024-03-08' ELSE ts::DATE END AS d FROM events""")
def relative_dates(t: Tables) -> DataFrame:
    shown = F.element_at(F.array(F.lit("today 10:05"), F.lit("yesterday 09:00"), F.lit("day before 01:00"), F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm")), (F.col("event_id") % 4 + 1).cast("int"))
    return t.events.select("event_id", P.relative_day(shown, F.lit("2024-03-10").cast("date")).alias("d"))


@query("""SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN NULL WHEN 1 THEN round((o_orderkey * 1000)::DOUBLE, 6) ELSE round(o_orderkey / 100, 6) END AS x,
 nullif(o_orderkey % 5 - 1, -1) AS y FROM orders""")
def parse_numbers(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    shown = F.when(k % 3 == 0, "n/a").when(k % 3 == 1, F.format_number(k * 1000, 0)).otherwise(F.concat(k.cast("string"), F.lit(" %")))
    return t.orders.select("o_orderkey", F.round(P.number(shown), 6).alias("x"), P.unless(k % 5 - 1).alias("y"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 15000 + (o_orderkey % 10) * 10000 ELSE o_orderkey END AS coins FROM orders")
def coin_suffix(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    shown = F.when(k % 2 == 0, F.concat((k % 10 + 1).cast("string"), F.lit(".5w"))).otherwise(k.cast("string"))
    return t.orders.select("o_orderkey", P.ten_thousands(shown).alias("coins"))


@query("SELECT doc_id, unnest(range(0, n_chars, 500))::BIGINT AS start FROM documents")
def page_offsets(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.explode(P.page_offsets(F.col("n_chars"), 500)).alias("start"))


@query("SELECT doc_id, md5(concat_ws('|', doc_id, lang, source, n_chars)) AS fingerprint FROM documents")
def fingerprint_md5(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(F.concat_ws("|", F.col("doc_id").cast("string"), "lang", "source", F.col("n_chars").cast("string"))).alias("fingerprint"))


@query("SELECT conv_id, string_agg(role || '@' || length(text), ';' ORDER BY turn) AS authors FROM conversations GROUP BY conv_id")
def author_concat(t: Tables) -> DataFrame:
    shown = F.struct("turn", F.concat("role", F.lit("@"), F.length("text").cast("string")).alias("s"))
    return t.conversations.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(shown)), lambda x: x["s"]), ";").alias("authors"))


@query("SELECT count(*) AS n, (SELECT count(*) FROM documents WHERE text IS NOT NULL AND length(text) > 0 AND NOT regexp_matches(text, 'GPL|CC BY')) AS clean FROM documents")
def collection_count(t: Tables) -> DataFrame:
    clean = F.col("text").isNotNull() & (F.length("text") > 0) & ~F.col("text").rlike("GPL|CC BY")
    return t.documents.agg(F.count("*").alias("n"), F.count_if(clean).alias("clean"))
