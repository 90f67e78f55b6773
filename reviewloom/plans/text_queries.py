"""Queries over review text and term features, with SQL for each that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import features as X
from .registry import Tables, query

#: Endings that bring the rules for contractions, links, emoji and Han text to bear on the synthetic prose.
TAILS = (" I'm sure it’s fine, don't we'll?? see http://a.b/c me@x 5€", " they´ve [said] so... w!!! 100% shop.com", "")
STOP = ("the", "and", "for", "der", "que", "les")


def _sql_chain(x: str, rules) -> str:
    """Nested regexp_replace calls of the fixed rules, for the oracle."""
    for pattern, to in rules:
        x = "regexp_replace({}, '{}', '{}', 'g')".format(x, pattern.replace("'", "''"), to)
    return x


_TAILED = "concat(text, CASE doc_id % 3 WHEN 0 THEN '{}' WHEN 1 THEN '{}' ELSE '' END)".format(*[t.replace("'", "''") for t in TAILS[:2]])
#: Beginning of SQL: the documents' terms, their counts, and classes of labelled documents.
TOK = r"tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS term FROM documents)"
TF = TOK + ", tf AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY ALL)"
CLS = "cls AS (SELECT doc_id, quality AS cls FROM labels WHERE quality IN (0, 1))"
W_ = TF + """, df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), n AS (SELECT count(*) AS n FROM documents),
 raw AS (SELECT doc_id, term, tf * (ln((1 + n) / (1 + df)) + 1) AS v FROM tf JOIN df USING (term), n),
 w AS (SELECT doc_id, term, v / sqrt(sum(v * v) OVER (PARTITION BY doc_id)) AS w FROM raw)"""
CHI = W_ + ", " + CLS + """, p AS (SELECT cls, count(*) / sum(count(*)) OVER () AS p FROM cls GROUP BY cls),
 o AS (SELECT term, cls, sum(w) AS o FROM w JOIN cls USING (doc_id) GROUP BY ALL),
 chi AS (SELECT term, sum(o * o / p) / sum(o) - sum(o) AS chi2 FROM o JOIN p USING (cls) GROUP BY term)"""
GINI = TF + ", " + CLS + """, g AS (SELECT term, sum(cls) AS num_pos, count(*) AS total FROM tf JOIN cls USING (doc_id) GROUP BY term),
 gini AS (SELECT term, (num_pos / total) ** 2 + ((total - num_pos) / total) ** 2 AS gini,
   CASE WHEN num_pos > total - num_pos THEN 1 WHEN num_pos < total - num_pos THEN 0 ELSE 2 END AS major,
   num_pos, total - num_pos AS num_neg, total FROM g)"""


def tailed(t: Tables) -> DataFrame:
    tail = F.when(F.col("doc_id") % 3 == 0, TAILS[0]).when(F.col("doc_id") % 3 == 1, TAILS[1]).otherwise("")
    return t.documents.select("doc_id", F.concat("text", tail).alias("text"))


def classes(t: Tables) -> DataFrame:
    return t.labels.filter("quality in (0, 1)").select("doc_id", F.col("quality").alias("cls"))


def weights(t: Tables, only: DataFrame | None = None) -> DataFrame:
    return X.tfidf(t.documents, only=only)


@query("SELECT doc_id, md5({}) AS clean FROM documents".format(_sql_chain("lower(regexp_replace({}, '[\\x{{1F000}}-\\x{{1FAFF}}\\x{{2600}}-\\x{{27BF}}\\x{{FE0F}}\\x{{200D}}]', '', 'g'))".format(_TAILED), [*T.contraction_rules(), *T.RULES])))
def standardize_text(t: Tables) -> DataFrame:
    return tailed(t).select("doc_id", F.md5(T.standardize(F.col("text"))).alias("clean"))


@query("SELECT doc_id, md5(lower({})) AS clean FROM documents".format(_sql_chain(_TAILED, [*T.contraction_rules("’"), *T.PLAIN_RULES])))
def standardize_v2(t: Tables) -> DataFrame:
    return tailed(t).select("doc_id", F.md5(T.standardize_plain(F.col("text"))).alias("clean"))


@query(r"SELECT doc_id, length(regexp_replace(regexp_replace(text, '^[ \t\n\r\f\v]+', ''), '[ \t\n\r\f\v]+$', '')) AS n FROM documents WHERE n BETWEEN 50 AND 5000")
def text_length_filter(t: Tables) -> DataFrame:
    return t.documents.filter(T.long_enough(F.col("text"), 50, 5000)).select("doc_id", F.length(T.strip(F.col("text"))).cast("long").alias("n"))


@query(r"""SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}'), lambda x: length(x) >= 3 AND x NOT IN ('the','and','for','der','que','les')) AS tokens FROM documents""")
def stopword_filter(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.kept_tokens(T.vector_tokens(F.col("text")), STOP, 3).alias("tokens"))


@query(r"SELECT doc_id, len(regexp_extract_all(text, '[a-zA-Z]{2,}'))::INT AS n FROM documents")
def short_token_filter(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.size(T.letter_tokens(F.col("text"))).alias("n"))


@query(r"SELECT doc_id, list_filter(regexp_split_to_array(" + _TAILED + r", '[ \t\n\r\f\v,.?!-:\-]+'), lambda x: x <> '') AS tokens FROM documents")
def tokenize_gaps(t: Tables) -> DataFrame:
    return tailed(t).select("doc_id", T.gap_tokens(F.col("text")).alias("tokens"))


@query(r"SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}') AS tokens FROM documents")
def vectorizer_tokens(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.vector_tokens(F.col("text")).alias("tokens"))


@query("WITH " + TOK + " SELECT DISTINCT term FROM tok")
def vocabulary(t: Tables) -> DataFrame:
    return X.term_counts(t.documents).select("term").distinct()


@query("SELECT doc_id, md5(lower(replace(regexp_replace(text, '[.,'']', '', 'g'), ' ', '_'))) AS shown, lower(replace(regexp_replace(source || ', Inc.', '[.,'']', '', 'g'), ' ', '_')) AS slug FROM documents")
def file_slug(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(T.slug(F.col("text"))).alias("shown"), T.slug(F.concat("source", F.lit(", Inc."))).alias("slug"))


@query("WITH " + TF + " SELECT term, sum(tf)::BIGINT AS freq FROM tf GROUP BY term")
def term_frequency(t: Tables) -> DataFrame:
    return X.term_frequency(X.term_counts(t.documents))


@query("WITH " + TF + " SELECT term, count(*) AS df FROM tf GROUP BY term")
def doc_frequency(t: Tables) -> DataFrame:
    return X.document_frequency(X.term_counts(t.documents))


@query("WITH " + W_ + " SELECT doc_id, term, round(w, 6) AS w FROM w")
def tfidf_l2(t: Tables) -> DataFrame:
    return weights(t).withColumn("w", F.round("w", 6))


@query("WITH " + W_.replace("tf AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY ALL)", "tf AS (SELECT doc_id, term, count(*) AS tf FROM tok WHERE term NOT IN ('the','and','for','der','que','les') GROUP BY ALL)") + " SELECT doc_id, term, round(w, 6) AS w FROM w")
def tfidf_stopwords(t: Tables) -> DataFrame:
    return X.tfidf(t.documents, without=STOP).withColumn("w", F.round("w", 6))


@query("WITH " + CHI + " SELECT term, round(chi2, 6) AS chi2 FROM chi")
def chi2_rank(t: Tables) -> DataFrame:
    return X.chi2(weights(t, classes(t)), classes(t)).withColumn("chi2", F.round("chi2", 6))


@query("WITH " + GINI + " SELECT term, round(gini, 6) AS gini, major, num_pos::BIGINT AS num_pos, num_neg::BIGINT AS num_neg, total FROM gini")
def gini_rank(t: Tables) -> DataFrame:
    return X.gini(X.term_counts(t.documents), classes(t)).withColumn("gini", F.round("gini", 6))


@query("WITH " + CLS + " SELECT round(avg(cls) ** 2 + (1 - avg(cls)) ** 2, 6) AS base_gini, sum(cls)::BIGINT AS n_pos, (count(*) - sum(cls))::BIGINT AS n_neg FROM cls")
def base_gini(t: Tables) -> DataFrame:
    return X.base_gini(classes(t)).withColumn("base_gini", F.round("base_gini", 6))


@query("WITH " + GINI + """, b AS (SELECT avg(cls) ** 2 + (1 - avg(cls)) ** 2 AS base_gini, sum(cls) AS n_pos, count(*) - sum(cls) AS n_neg FROM cls)
 SELECT term, round(gini, 6) AS gini, major, num_pos::BIGINT AS num_pos, num_neg::BIGINT AS num_neg, total FROM gini, b
 WHERE round(gini, 9) >= round(base_gini, 9) AND (num_neg = 0 OR num_pos / nullif(num_neg, 0) >= n_pos / n_neg)""")
def gini_threshold(t: Tables) -> DataFrame:
    g = X.gini(X.term_counts(t.documents), classes(t)).withColumn("gini", F.round("gini", 9))
    return X.gini_threshold(g, X.base_gini(classes(t)).withColumn("base_gini", F.round("base_gini", 9))).withColumn("gini", F.round("gini", 6))


@query("WITH " + W_ + " SELECT term, round(avg(w), 6) AS mean_w FROM w WHERE doc_id % 10 < 7 AND w > 0 GROUP BY term")
def mean_nonzero_weight(t: Tables) -> DataFrame:
    return X.mean_nonzero(weights(t), F.col("doc_id") % 10 < 7).withColumn("mean_w", F.round("mean_w", 6))


@query("WITH " + TF + " SELECT term, sum(tf)::BIGINT AS freq, row_number() OVER (ORDER BY sum(tf) DESC, term)::INT AS rank FROM tf GROUP BY term ORDER BY rank LIMIT 100")
def select_topk_freq(t: Tables) -> DataFrame:
    return X.ranked(X.term_frequency(X.term_counts(t.documents)), "freq", 100)


@query("WITH " + CHI + ", r AS (SELECT term, round(chi2, 6) AS chi2 FROM chi) SELECT *, row_number() OVER (ORDER BY chi2 DESC, term)::INT AS rank FROM r ORDER BY rank LIMIT 100")
def select_topk_chi2(t: Tables) -> DataFrame:
    return X.ranked(X.chi2(weights(t, classes(t)), classes(t)).withColumn("chi2", F.round("chi2", 6)), "chi2", 100)


@query("WITH " + TF + """, r AS (SELECT term, row_number() OVER (ORDER BY sum(tf) DESC, term)::INT AS rank FROM tf GROUP BY term)
 SELECT k, term, rank FROM r JOIN (SELECT unnest([10, 25, 50])::INT AS k) ON rank <= k""")
def topk_prefixes(t: Tables) -> DataFrame:
    top = X.ranked(X.term_frequency(X.term_counts(t.documents)), "freq", 50)
    return top.withColumn("k", F.explode(F.array(F.lit(10), F.lit(25), F.lit(50)))).filter("rank <= k").select("k", "term", "rank")


@query("WITH " + CHI + """, ra AS (SELECT term, row_number() OVER (ORDER BY sum(tf) DESC, term) AS rank FROM tf GROUP BY term QUALIFY rank <= 100),
 rb AS (SELECT term, row_number() OVER (ORDER BY round(chi2, 6) DESC, term) AS rank FROM chi QUALIFY rank <= 100),
 c AS (SELECT term FROM ra SEMI JOIN rb USING (term)),
 a1 AS (SELECT term, row_number() OVER (ORDER BY rank) AS rank FROM ra ANTI JOIN c USING (term)),
 b1 AS (SELECT term, row_number() OVER (ORDER BY rank) AS rank FROM rb ANTI JOIN c USING (term))
 SELECT term, 'A' AS part, rank::INT AS rank FROM a1 WHERE rank <= (SELECT count(*) FROM c)
 UNION ALL SELECT term, 'B', rank::INT FROM b1 WHERE rank <= (SELECT count(*) FROM c)
 UNION ALL SELECT term, 'C', row_number() OVER (ORDER BY term)::INT FROM c""")
def abc_sets(t: Tables) -> DataFrame:
    return X.abc_sets(select_topk_freq(t), select_topk_chi2(t))


@query("WITH " + TF + r""", r AS (SELECT term, sum(tf) AS freq FROM tf GROUP BY term), a AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[a-zA-Z]{2,}'))) AS term FROM benchmark)
 SELECT term, freq::BIGINT AS freq FROM r SEMI JOIN a USING (term)""")
def aspect_semi_filter(t: Tables) -> DataFrame:
    aspects = t.benchmark.select(F.explode(T.letter_tokens(F.col("text"))).alias("word")).select(F.lower("word").alias("term")).distinct()
    return X.term_frequency(X.term_counts(t.documents)).join(aspects, "term", "left_semi")


@query(r"""WITH r AS (SELECT doc_id, regexp_extract_all('这家店很好 ' || text || ' 服务快' || ['好', '中国', '学生们'][doc_id % 3 + 1], '\p{Han}+') AS runs FROM documents)
 SELECT doc_id, flatten(list_transform(runs, lambda r: list_transform(range(1, length(r)), lambda i: substr(r, i, 2)))) AS tokens FROM r""")
def cjk_tokens(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.han_bigrams(F.concat(F.lit("这家店很好 "), "text", F.lit(" 服务快"), F.element_at(F.array(F.lit("好"), F.lit("中国"), F.lit("学生们")), (F.col("doc_id") % 3 + 1).cast("int")))).alias("tokens"))
