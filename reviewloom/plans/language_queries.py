"""Queries over words of Han text and lemmas, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.parsing import word_class
from ..operators import lemmas as L
from ..operators.segment import han_words
from ..operators.shared import written
from .aspect_queries import ANN, annotated, tagged_words
from .registry import Tables, query

#: Words of a small dictionary with frequencies, and phrases that can be cut in several ways.
HAN = {
    "研究": 4021, "研究生": 881, "生命": 1973, "命": 307, "起源": 557, "这家": 1013, "店": 733, "的": 90001, "服务": 3011, "服务员": 691, "员": 409, "态度": 1201, "很": 6007, "很好": 1501, "好": 5003,
    "结婚": 1709, "和": 30011, "和尚": 503, "尚未": 907, "未": 1103, "中国": 8009, "科学": 2503, "学院": 1301, "科学院": 601, "计算": 2003, "所": 3203, "计算所": 103, "南京": 1607, "南京市": 401, "市长": 709,
    "市": 2203, "长江": 1409, "江": 613, "大桥": 1009, "大": 7001, "来到": 1801, "北京": 4507, "清华": 811, "华大": 13, "大学": 5501, "清华大学": 907, "我": 20011,
}
PHRASES = ("研究生命起源", "这家店的服务员态度很好", "结婚的和尚未结婚的", "中国科学院计算所", "南京市长江大桥", "我来到北京清华大学")

_DICT = ", ".join(f"('{w}', {n})" for w, n in HAN.items())
_PHRASE = "[" + ", ".join(f"'{p}'" for p in PHRASES) + "]"


@query(f"""WITH RECURSIVE dict(word, freq) AS (VALUES {_DICT}), total AS (SELECT sum(freq) AS total FROM dict),
 docs AS (SELECT doc_id, {_PHRASE}[doc_id % 6 + 1] || {_PHRASE}[doc_id // 6 % 6 + 1] AS run, regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+') AS rest FROM documents), runs AS (SELECT DISTINCT run FROM docs),
 path AS (SELECT run, 1 AS spot, 0::DOUBLE AS score, []::VARCHAR[] AS words FROM runs
  UNION ALL SELECT run, spot + n, score + ln(coalesce(freq, 1) / total), list_append(words, substr(run, spot, n))
   FROM path JOIN (SELECT unnest([1, 2, 3, 4]) AS n) ON spot + n <= length(run) + 1 LEFT JOIN dict ON word = substr(run, spot, n), total WHERE n = 1 OR freq IS NOT NULL),
 best AS (SELECT run, arg_max(words, score) AS words FROM path WHERE spot = length(run) + 1 GROUP BY run)
 SELECT doc_id, array_to_string(list_concat(words, rest), '/') AS words FROM docs JOIN best USING (run)""")
def cjk_words(t: Tables) -> DataFrame:
    """Two phrases before each text, cut into their most probable words."""
    phrase = lambda i: F.element_at(F.array(*[F.lit(p) for p in PHRASES]), (i % 6 + 1).cast("int"))
    k = F.col("doc_id")
    docs = t.documents.select("doc_id", F.concat(phrase(k), phrase(F.floor(k / 6)), F.lit(" "), "text").alias("text"))
    words = han_words(docs, t.spark.createDataFrame(list(HAN.items()), "word string, freq long"), max(map(len, HAN)))
    return words.select("doc_id", F.array_join("words", "/").alias("words"))


_RULES = ", ".join(f"('{c}', {i}, '{old}', '{new}')" for c, rules in L.DETACHED.items() for i, (old, new) in enumerate(rules))
_IRREGULAR = ", ".join(f"('{w}', '{c}', '{m}')" for w, c, m in L.IRREGULAR)
#: Nouns count as a dictionary's nouns, verbs and adjectives, adjectives as its adjectives.
_LEMMAS = ANN + f""", rule(cls, o, old, new) AS (VALUES {_RULES}), irr(word, cls, lemma) AS (VALUES {_IRREGULAR}),
 voc AS (SELECT DISTINCT word, CASE left(tag, 2) WHEN 'NN' THEN 'n' WHEN 'VB' THEN 'v' WHEN 'JJ' THEN 'a' ELSE 'r' END AS cls FROM tokens WHERE left(tag, 2) IN ('NN', 'VB', 'JJ', 'RB')),
 dict AS (SELECT DISTINCT word, c AS cls FROM tokens, (VALUES ('n'), ('v'), ('a')) AS x(c) WHERE tag = 'NN' UNION SELECT DISTINCT word, 'a' FROM tokens WHERE tag = 'JJ' UNION SELECT lemma, cls FROM irr),
 form AS (SELECT word, cls, word AS form, 0 AS round, '' AS path FROM voc
  UNION ALL SELECT word, form.cls, left(form, length(form) - length(old)) || new, round + 1, path || o FROM form JOIN rule ON form.cls = rule.cls AND ends_with(form, old)),
 cand AS (SELECT word, cls, form, greatest(round, 1) AS round, CASE WHEN round = 0 THEN '' ELSE '.' || path END AS path FROM form ANTI JOIN irr USING (word, cls)
  UNION ALL SELECT word, cls, word, 1, '' FROM voc SEMI JOIN irr USING (word, cls) UNION ALL SELECT word, cls, lemma, 1, '.' || lemma FROM voc JOIN irr USING (word, cls)),
 best AS (SELECT c.*, row_number() OVER (PARTITION BY c.word, c.cls ORDER BY round, length(form), path) AS r FROM cand c SEMI JOIN dict d ON d.word = c.form AND d.cls = c.cls)"""


def _lemmatized(t: Tables, a: DataFrame, default: str | None = None) -> DataFrame:
    seen = written(a.select("word", "tag").distinct().select("word", "tag", word_class(F.col("tag")).alias("cls")), "tagged-words")
    irregular = t.spark.createDataFrame(L.IRREGULAR, "word string, cls string, lemma string")
    as_any = seen.filter("tag = 'NN'").select("word", F.explode(F.array(*[F.lit(c) for c in "nva"])).alias("cls"))
    dictionary = as_any.unionByName(seen.filter("tag = 'JJ'").select("word", "cls")).unionByName(irregular.select(F.col("lemma").alias("word"), "cls"))
    asked = seen.filter("cls is not null") if default is None else seen.withColumn("cls", F.coalesce("cls", F.lit(default)))
    return L.lemmatized(asked, dictionary, irregular)


_CHOSEN = " SELECT word, cls, coalesce(form, word) AS lemma FROM voc LEFT JOIN (SELECT word, cls, form FROM best WHERE r = 1) USING (word, cls)"


@query("WITH RECURSIVE " + _LEMMAS + _CHOSEN)
def lemmas(t: Tables) -> DataFrame:
    """The lemma of each word by its word class."""
    return _lemmatized(t, tagged_words(t))


_OF_TOKEN = """, lem AS ({}), cl AS (SELECT word, CASE left(tag, 2) WHEN 'NN' THEN 'n' WHEN 'VB' THEN 'v' WHEN 'JJ' THEN 'a' WHEN 'RB' THEN 'r' END AS cls FROM tokens)
 SELECT lemma || '_' || cls AS lemma_pos, count(*) AS n FROM ({}) JOIN lem USING (word, cls) GROUP BY ALL"""


@query("WITH RECURSIVE " + _LEMMAS + _OF_TOKEN.format(_CHOSEN, "SELECT * FROM cl WHERE cls IS NOT NULL"))
def lemma_counts(t: Tables) -> DataFrame:
    """How often each lemma stands with each class; words of other classes are left out."""
    a = annotated(t)
    of_tokens = L.lemma_tokens(a.select("word", word_class(F.col("tag")).alias("cls")), _lemmatized(t, a))
    return of_tokens.groupBy("lemma_pos").agg(F.count("*").alias("n"))


@query("WITH RECURSIVE " + _LEMMAS.replace("ELSE 'r' END AS cls FROM tokens WHERE left(tag, 2) IN ('NN', 'VB', 'JJ', 'RB'))", "WHEN 'RB' THEN 'r' ELSE 'n' END AS cls FROM tokens)")
       + _OF_TOKEN.format(_CHOSEN, "SELECT word, coalesce(cls, 'n') AS cls FROM cl"))
def lemma_counts_all(t: Tables) -> DataFrame:
    """The same with words of other classes as nouns."""
    a = annotated(t)
    of_tokens = L.lemma_tokens(a.select("word", word_class(F.col("tag")).alias("cls")), _lemmatized(t, a, "n"), "n")
    return of_tokens.groupBy("lemma_pos").agg(F.count("*").alias("n"))
