"""Queries over annotated tokens: aspects, sentiment and polarity, with SQL."""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import letter_tokens, sentences, snippet
from ..operators import annotate as A
from ..operators import aspects as G
from ..operators import features as X
from ..operators import sentiment as L
from ..operators.containment import contained
from ..operators.places import placed
from ..operators.shared import kept_apart, parts_of, written
from .registry import Tables, query
from .text_queries import TOK, W_, weights

_CASE = " ".join(f"WHEN word IN ({', '.join(repr(w) for w in ws)}) THEN '{t}'" for t, ws in A.CLOSED.items())
_CASE += " " + " ".join(f"WHEN length(word) > {len(e) + 1} AND ends_with(word, '{e}') THEN '{t}'" for e, t in A.ENDINGS)
#: Beginning of SQL: the token table.
SENT = r"""pieces AS (SELECT doc_id, regexp_split_to_array(regexp_replace(lower(text), '([.!?])[ \n\t]+', '\1' || chr(1), 'g'), chr(1)) AS ss FROM documents),
 kept AS (SELECT doc_id, list_filter(list_transform(ss, lambda s: regexp_replace(regexp_replace(s, '^[ \t\n\r\f\v]+', ''), '[ \t\n\r\f\v]+$', '')), lambda s: s <> '') AS ss FROM pieces),
 sents AS (SELECT doc_id, i - 1 AS sent_idx, ss[i] AS sent FROM kept, unnest(range(1, len(ss) + 1)) AS u(i))"""
ANN = SENT + r""", ws AS (SELECT doc_id, sent_idx, regexp_extract_all(sent, '[\p{L}\p{N}_]+') AS ws, string_split_regex(sent, '[\p{L}\p{N}_]+') AS gs FROM sents),
 words AS (SELECT doc_id, sent_idx, j - 1 AS tok_idx, ws[j] AS word, length(gs[j]) AS gap FROM ws, unnest(range(1, len(ws) + 1)) AS u(j)),
 tagged AS (SELECT *, CASE """ + _CASE + """ ELSE 'NN' END AS tag FROM words),
 near AS (SELECT *, coalesce(lag(tag) OVER s, '') AS tag0, coalesce(lag(tag, 2) OVER s, '') AS tag00, coalesce(lead(tag) OVER s, '') AS tag1,
   sum(gap + length(word)) OVER s - length(word) AS start FROM tagged WINDOW s AS (PARTITION BY doc_id, sent_idx ORDER BY tok_idx)),
 deps AS (SELECT *, CASE WHEN tag = 'NEG' AND tag1 <> '' THEN 'neg' WHEN tag = 'JJ' AND tag1 IN ('NN', 'NNS') THEN 'amod'
   WHEN tag = 'JJ' AND (tag0 = 'VBZ' OR tag0 = 'NEG' AND tag00 = 'VBZ') THEN 'acomp' WHEN tag IN ('NN', 'NNS') AND tag1 = 'VBZ' THEN 'nsubj' ELSE 'dep' END AS dep,
   CASE WHEN tag = 'NNS' THEN left(word, length(word) - 1) ELSE word END AS lemma FROM near),
 tokens AS MATERIALIZED (SELECT doc_id, sent_idx::INT AS sent_idx, tok_idx::INT AS tok_idx, word, lemma, tag, dep, start::INT AS start,
   CASE WHEN dep IN ('neg', 'amod', 'nsubj') THEN tok_idx + 1 WHEN dep = 'acomp' AND tag0 = 'NEG' THEN tok_idx - 2 WHEN dep = 'acomp' THEN tok_idx - 1 END::INT AS head_idx FROM deps)"""
#: Dependents of nouns: by their head, and a complement of a copula also by the copula's subject.
GOV = ANN + """, gov AS (SELECT h.lemma, c.dep AS child, c.doc_id, c.sent_idx, c.tok_idx, c.word, c.tag FROM tokens c JOIN tokens h ON c.doc_id = h.doc_id AND c.sent_idx = h.sent_idx AND c.head_idx = h.tok_idx
   WHERE h.tag IN ('NN', 'NNS')
  UNION ALL SELECT n.lemma, c.dep, c.doc_id, c.sent_idx, c.tok_idx, c.word, c.tag FROM tokens c JOIN tokens n ON c.doc_id = n.doc_id AND c.sent_idx = n.sent_idx AND c.head_idx = n.head_idx
   WHERE c.dep = 'acomp' AND n.dep = 'nsubj')"""
_COMMON = ", ".join(repr(x) for x in G.COMMON_TAGS)
PAIRS = ANN + f""", side AS (SELECT doc_id, sent_idx, tok_idx + 1 AS tok_idx, lemma AS other, tag AS other_tag, true AS before FROM tokens
   UNION ALL SELECT doc_id, sent_idx, tok_idx - 1, lemma, tag, false FROM tokens),
 pairs AS MATERIALIZED (SELECT doc_id, sent_idx, tok_idx AS noun_idx, least(lemma, other) AS w1, greatest(lemma, other) AS w2,
   (CASE WHEN before THEN other ELSE lemma END) = least(lemma, other) AS forward
   FROM tokens JOIN side USING (doc_id, sent_idx, tok_idx) WHERE tag IN ('NN', 'NNS') AND other_tag NOT IN ({_COMMON}) AND lemma <> other)"""
BI = PAIRS + """, cnt AS (SELECT lemma, count(*) AS c FROM tokens GROUP BY lemma),
 bi0 AS (SELECT w1, w2, count(DISTINCT (doc_id, sent_idx)) AS n_sents, count(*) AS n_votes, sum(forward::INT) AS fwd FROM pairs GROUP BY ALL),
 bi AS MATERIALIZED (SELECT CASE WHEN n_votes - fwd > fwd THEN bi0.w2 ELSE bi0.w1 END AS w1, CASE WHEN n_votes - fwd > fwd THEN bi0.w1 ELSE bi0.w2 END AS w2,
   n_sents, n_votes, n_sents / (a.c * b.c) AS score FROM bi0 JOIN cnt a ON a.lemma = bi0.w1 JOIN cnt b ON b.lemma = bi0.w2 WHERE n_sents >= {least})"""
#: Trigrams stand in those sentences of their first bigram that are also their second's, at the first one's place.
TRI = BI.replace("{least}", "3") + """, bs AS MATERIALIZED (SELECT bi.w1, bi.w2, p.doc_id, p.sent_idx, min(p.noun_idx) AS tok_idx
   FROM bi JOIN pairs p ON p.w1 = least(bi.w1, bi.w2) AND p.w2 = greatest(bi.w1, bi.w2) GROUP BY ALL),
 rev AS (SELECT DISTINCT w1, w2, doc_id FROM bs), sz AS (SELECT w1, w2, count(*) AS n FROM rev GROUP BY ALL),
 tri0 AS (SELECT a.w1, a.w2, b.w2 AS w3, count(*) AS n_common FROM rev a JOIN rev b ON a.w2 = b.w1 AND a.doc_id = b.doc_id GROUP BY ALL),
 tri AS MATERIALIZED (SELECT t.* FROM tri0 t JOIN sz x ON x.w1 = t.w1 AND x.w2 = t.w2 JOIN sz y ON y.w1 = t.w2 AND y.w2 = t.w3 WHERE n_common / least(x.n, y.n) >= 0.09),
 ts AS MATERIALIZED (SELECT tri.w1, tri.w2, tri.w3, a.doc_id, a.sent_idx, a.tok_idx FROM tri JOIN bs a ON a.w1 = tri.w1 AND a.w2 = tri.w2
   WHERE EXISTS (SELECT 1 FROM bs b WHERE b.w1 = tri.w2 AND b.w2 = tri.w3 AND b.doc_id = a.doc_id AND b.sent_idx = a.sent_idx))"""
LEX = """ lex0 AS (SELECT token, ('0x' || substr(md5(token), 3, 2))::INT / 256 AS pos, ('0x' || substr(md5(token), 5, 2))::INT / 256 AS neg
   FROM (SELECT DISTINCT word AS token FROM vocab) WHERE ('0x' || substr(md5(token), 1, 2))::INT % 2 = 1),
 lex1 AS (SELECT *, greatest(1 - pos - neg, 0) AS obj FROM lex0),
 lex AS (SELECT *, CASE WHEN greatest(pos, neg, obj) = pos THEN pos WHEN greatest(pos, neg, obj) = neg THEN -neg ELSE 0 END AS s FROM lex1)"""
TLEX = ANN + ", vocab AS (SELECT DISTINCT word FROM tokens)," + LEX
WLEX = W_ + ", vocab AS (SELECT DISTINCT term AS word FROM tf)," + LEX
_POL = """, sp AS (SELECT doc_id, sent_idx, sum(coalesce(pos, 0)) AS p, sum(coalesce(neg, 0)) AS n, count(*) AS c, bool_or(word IN ('no', 'not', 'but', 'however')) AS flip
   FROM tokens LEFT JOIN lex ON word = token GROUP BY ALL),
 pol AS (SELECT doc_id, sent_idx, (CASE WHEN flip THEN -1 ELSE 1 END) * CASE WHEN abs(p - n) / c >= 0.1 THEN CASE WHEN p > n THEN p ELSE -n END ELSE 0 END AS polarity FROM sp)"""
POL = TLEX + _POL
OCC = TRI + """, occ AS MATERIALIZED (SELECT lemma, doc_id, sent_idx, min(tok_idx) AS tok_idx FROM tokens WHERE tag IN ('NN', 'NNS') GROUP BY ALL
  UNION ALL SELECT w1 || ' ' || w2, doc_id, sent_idx, tok_idx FROM bs
  UNION ALL SELECT w1 || ' ' || w2 || ' ' || w3, doc_id, sent_idx, tok_idx FROM ts),
 top AS (SELECT lemma, count(DISTINCT doc_id) AS n_reviews FROM occ GROUP BY lemma)"""
ASP = OCC + ", vocab AS (SELECT DISTINCT word FROM tokens)," + LEX + _POL + """,
 ls AS (SELECT doc_id, sent_idx, sum(s) AS lx FROM tokens JOIN lex ON word = token GROUP BY ALL),
 per AS (SELECT lemma, doc_id, doc_id % 5 + 1 AS rating, floor(avg(polarity) * 1e6) / 1e6 AS blob, count(*) AS n_sents, min(sent_idx) AS first_sent, sum(coalesce(lx, 0)) AS lx FROM occ JOIN pol USING (doc_id, sent_idx) LEFT JOIN ls USING (doc_id, sent_idx) GROUP BY ALL),
 cls AS (SELECT *, CASE WHEN rating = 5 AND blob > 0.1 THEN 'pos' WHEN rating = 4 AND blob > 0.45 THEN 'pos' WHEN rating = 4 AND blob > 0.2 THEN CASE WHEN lx >= 4 THEN 'pos' ELSE 'mixed' END
   WHEN rating = 3 AND blob > 0.7 THEN 'pos' WHEN rating <= 3 AND blob < 0 THEN 'neg' WHEN rating = 2 AND blob <= 0.175 THEN CASE WHEN lx < 0 THEN 'neg' ELSE 'mixed' END
   WHEN rating = 1 AND blob <= 0.2 THEN CASE WHEN lx < 0 THEN 'neg' ELSE 'mixed' END ELSE 'mixed' END AS class FROM per)"""


def tokens(t: Tables) -> DataFrame:
    return A.token_table(t.documents)


def tagged_words(t: Tables) -> DataFrame:
    """(word, tag) of each token, for what needs no neighbours."""
    return A.sentence_table(t.documents).select(F.explode("ts").alias("x")).select("x.word", "x.tag")


def annotated(t: Tables) -> DataFrame:
    """The tokens, from a table of sentences, kept apart by document, that is written once for what reads it several times."""
    return A.token_rows(sentences_apart(t, parts_of(t.documents)))


def sentences_apart(t: Tables, parts: int) -> DataFrame:
    """The table of sentences, kept apart by document in so many parts."""
    return kept_apart("sentences", parts, "doc_id", A.sentence_table(t.documents.select("doc_id", "text").repartition(parts, "doc_id")))


def dealt_out(t: Tables) -> DataFrame:
    """The tokens of documents that are dealt out by doc_id, for what reads them once or twice: what groups them by document
    needs no other exchange. They are made from the texts again for each reader."""
    return A.token_table(t.documents.select("doc_id", "text").repartition("doc_id"))


class Mined:
    """Tokens, neighbours, bigrams, trigrams and their places. Sentences and places are kept apart by document, bigrams and
    trigrams are written; keep are columns of the tokens that places have too."""

    def __init__(self, t: Tables, keep: tuple[str, ...] = ()):
        self.parts, self.keep = parts_of(t.documents), keep
        tokens = A.token_rows(sentences_apart(t, self.parts))
        self.tokens = A.with_starts(tokens) if "start" in keep else tokens
        self.bigrams = written(G.supported(G.pair_sentences(G.noun_neighbours(tokens)), 3).select(*G.oriented(), "n_sents", "n_reviews"), "bigrams")

    @cached_property
    def places(self) -> DataFrame:
        return G.bigram_places(self.bigrams, G.noun_neighbours(self.tokens, keep=self.keep), self.parts, self.keep)

    @cached_property
    def trigrams(self) -> DataFrame:
        return written(G.trigrams(self.places, 0.09), "trigrams")

    @cached_property
    def trigram_places(self) -> DataFrame:
        return G.trigram_places(self.trigrams, self.places, self.parts, self.keep)

    def aspects(self) -> list[DataFrame]:
        return G.aspect_rows(self.tokens, self.places, self.trigram_places, self.keep)


def lexicon(words: DataFrame, col: str) -> DataFrame:
    """The stand-in lexicon of the words, written, with the number of rows of each (n): joins broadcast the most frequent."""
    counts = words.groupBy(F.col(col).alias("term")).agg(F.count("*").alias("n"))
    scored = L.hash_lexicon(counts.select("term", "n"))
    return written(scored, "lexicon")


@query("WITH " + SENT + " SELECT doc_id, sent_idx::INT AS sent_idx, sent FROM sents")
def sentence_split(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.posexplode(sentences(F.lower("text"))).alias("sent_idx", "sent"))


@query("WITH " + SENT + " SELECT row_number() OVER (ORDER BY doc_id, sent_idx) - 1 AS number, doc_id, sent_idx::INT AS sent_idx, length(sent) AS n_chars FROM sents")
def sentence_numbers(t: Tables) -> DataFrame:
    """Sentences numbered through all documents."""
    sents = t.documents.select("doc_id", F.posexplode(sentences(F.lower("text"))).alias("sent_idx", "sent"))
    told = placed(sents.select("doc_id", "sent_idx", F.length("sent").cast("long").alias("n_chars")), [F.col("doc_id"), F.col("sent_idx")], name="number")
    return told.withColumn("number", F.col("number") - 1)


@query("WITH " + ANN + " SELECT doc_id, sent_idx, tok_idx, word, tag FROM tokens")
def pos_tag(t: Tables) -> DataFrame:
    return tokens(t).select("doc_id", "sent_idx", "tok_idx", "word", "tag")


@query("WITH " + ANN + " SELECT lemma || '_' || lower(left(tag, 1)) AS lemma_pos, count(*) AS n FROM tokens GROUP BY ALL")
def lemma_pos(t: Tables) -> DataFrame:
    key = F.concat("lemma", F.lit("_"), F.lower(F.left("tag", F.lit(1))))
    return tokens(t).groupBy(key.alias("lemma_pos")).agg(F.count("*").alias("n"))


@query("WITH " + ANN + " SELECT doc_id, sent_idx, lemma, min(tok_idx) AS first_idx FROM tokens WHERE tag IN ('NN', 'NNS') GROUP BY ALL")
def first_occurrence(t: Tables) -> DataFrame:
    return tokens(t).filter(F.col("tag").isin(*A.NOUNS)).groupBy("doc_id", "sent_idx", "lemma").agg(F.min("tok_idx").alias("first_idx"))


@query("WITH " + ANN + " SELECT t.doc_id, t.sent_idx, t.tok_idx, t.dep, h.word AS head FROM tokens t JOIN tokens h ON t.doc_id = h.doc_id AND t.sent_idx = h.sent_idx AND t.head_idx = h.tok_idx")
def head_join(t: Tables) -> DataFrame:
    return tokens(t).filter("head_idx is not null").select("doc_id", "sent_idx", "tok_idx", "dep", F.col("head_word").alias("head"))


@query("WITH " + GOV + " SELECT lemma, child, count(*) AS n FROM gov GROUP BY ALL")
def governed_children(t: Tables) -> DataFrame:
    """How often each noun has a dependent of each kind; an adjective after a copula is the subject's too."""
    return G.governed(tokens(t)).groupBy("lemma", "child").agg(F.count("*").alias("n"))


@query("WITH " + PAIRS + " SELECT w1, w2, count(*) AS n FROM pairs GROUP BY ALL")
def neighbor_pairs(t: Tables) -> DataFrame:
    return G.noun_neighbours(tokens(t)).groupBy("w1", "w2").agg(F.count("*").alias("n"))


@query("WITH " + GOV + """, occ AS (SELECT lemma, count(*) AS n_occ, count(DISTINCT (doc_id, sent_idx)) AS n_sents, count(DISTINCT doc_id) AS n_reviews FROM tokens WHERE tag IN ('NN', 'NNS') GROUP BY lemma),
 sh AS (SELECT lemma, avg((child IN ('amod', 'acomp'))::INT) AS a_share FROM gov GROUP BY lemma)
 SELECT lemma, n_occ, n_sents, n_reviews, round(a_share, 6) AS a_share FROM occ LEFT JOIN sh USING (lemma)
 WHERE n_sents >= 0.001 * (SELECT count(*) FROM (SELECT DISTINCT doc_id, sent_idx FROM tokens)) AND (a_share IS NULL OR a_share >= 0.09)""")
def aspect_unigrams(t: Tables) -> DataFrame:
    return G.unigrams(dealt_out(t), 0.001, 0.09).withColumn("a_share", F.round("a_share", 6))


@query("WITH " + BI.replace("{least}", "2") + " SELECT w1, w2, n_sents, n_votes, round(score, 9) AS score FROM bi")
def aspect_bigrams(t: Tables) -> DataFrame:
    return G.bigrams(annotated(t), 2).drop("avg_distance", "n_reviews").withColumn("score", F.round("score", 9))


@query("WITH " + BI.replace("{least}", "2") + " SELECT w1, w2, n_sents, 1.0::DOUBLE AS avg_distance, round(score, 9) AS score FROM bi WHERE score >= 0.0003")
def bigram_support(t: Tables) -> DataFrame:
    """Bigrams by support, mean distance and association together."""
    return G.bigrams(annotated(t), 2, 0.0003, max_avg_distance=2.0).select("w1", "w2", "n_sents", "avg_distance", F.round("score", 9).alias("score"))


@query("WITH " + TRI + """ SELECT w1, w2, w3, any_value(n_common) AS n_common, count(DISTINCT (doc_id, sent_idx)) FILTER (doc_id IS NOT NULL) AS n_sents, count(DISTINCT doc_id) AS n_reviews
 FROM tri LEFT JOIN ts USING (w1, w2, w3) GROUP BY ALL""")
def aspect_trigrams(t: Tables) -> DataFrame:
    """Chained bigrams, the reviews that hold both, and the sentences and reviews in which the trigram stands."""
    m = Mined(t)
    per_review = m.trigram_places.groupBy("w1", "w2", "w3", "doc_id").agg(F.count("*").alias("n_sents"))
    where = per_review.groupBy("w1", "w2", "w3").agg(F.sum("n_sents").alias("n_sents"), F.count("*").alias("n_reviews"))
    return m.trigrams.join(where, ["w1", "w2", "w3"], "left").na.fill(0, ["n_sents", "n_reviews"])


@query("WITH " + TRI + """, uni AS (SELECT DISTINCT lemma, doc_id FROM tokens WHERE tag IN ('NN', 'NNS')), bw AS (SELECT w1 AS word FROM bi UNION SELECT w2 FROM bi),
 hold AS (SELECT w1 || ' ' || w2 AS aspect, doc_id FROM bs UNION SELECT w1 || ' ' || w2 || ' ' || w3, doc_id FROM ts), names AS (SELECT DISTINCT aspect FROM hold),
 cov AS (SELECT DISTINCT word AS lemma, doc_id FROM (SELECT word, aspect FROM bw, names WHERE contains(aspect, word)) JOIN hold USING (aspect))
 SELECT lemma, count(*) AS n_reviews FROM uni ANTI JOIN cov USING (lemma, doc_id) GROUP BY lemma""")
def unigram_review_dedupe(t: Tables) -> DataFrame:
    """Reviews of each noun without those of the bigrams and trigrams that hold it as a part, if it is a bigram's word.

    A part without blanks lies within one word of an aspect, and a review's trigrams have only words of its bigrams. So
    a noun is looked for in the words of its own review's bigrams, and whether it is a bigram's word is asked of each
    noun's counts."""
    m = Mined(t)
    held = m.places.groupBy("doc_id").agg(F.array_join(F.array_distinct(F.flatten(F.collect_set(F.array("w1", "w2")))), " ").alias("held"))
    uni = m.tokens.filter(F.col("tag").isin(*A.NOUNS)).groupBy("doc_id").agg(F.collect_set("lemma").alias("lemmas"))
    per = uni.join(held, "doc_id", "left").select("held", F.explode("lemmas").alias("lemma"))
    sums = per.groupBy("lemma").agg(F.count("*").alias("n_all"), F.count_if(F.contains("held", F.col("lemma"))).alias("n_held"))
    words = m.bigrams.select(F.explode(F.array("w1", "w2")).alias("lemma")).distinct().withColumn("_part", F.lit(True))
    left = F.col("n_all") - F.when(F.col("_part"), F.col("n_held")).otherwise(0)
    return sums.join(words, "lemma", "left").select("lemma", left.alias("n_reviews")).filter("n_reviews > 0")


@query("WITH " + TOK + """, v AS (SELECT DISTINCT term FROM tok), b AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[a-zA-Z]{2,}'))) AS word FROM benchmark)
 SELECT word, count(*) AS n FROM b, v WHERE contains(term, word) GROUP BY word""")
def contained_words(t: Tables) -> DataFrame:
    """How many terms of the documents hold each word of the benchmark, anywhere within."""
    words = t.benchmark.select(F.explode(letter_tokens(F.col("text"))).alias("w")).select(F.lower("w").alias("word"))
    terms = X.term_counts(t.documents).select(F.col("term").alias("string"))
    return contained(words, terms).groupBy("word").agg(F.count("*").alias("n"))


@query("WITH " + TRI + """, inside AS (SELECT least(w1, w2) AS a, greatest(w1, w2) AS b FROM tri UNION SELECT least(w2, w3), greatest(w2, w3) FROM tri UNION SELECT least(w1, w3), greatest(w1, w3) FROM tri)
 SELECT w1, w2, n_sents FROM bi ANTI JOIN inside ON least(w1, w2) = a AND greatest(w1, w2) = b""")
def bigram_subsumed(t: Tables) -> DataFrame:
    m = Mined(t)
    sides = F.array(*[F.struct(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")) for x, y in (("w1", "w2"), ("w2", "w3"), ("w1", "w3"))])
    inside = m.trigrams.select(F.explode(sides).alias("p")).select("p.a", "p.b").distinct()
    return m.bigrams.join(inside, (F.least("w1", "w2") == F.col("a")) & (F.greatest("w1", "w2") == F.col("b")), "left_anti").select("w1", "w2", "n_sents")


@query("WITH " + TLEX + " SELECT token, round(pos, 6) AS pos, round(neg, 6) AS neg, round(obj, 6) AS obj FROM lex")
def lexicon_build(t: Tables) -> DataFrame:
    return lexicon(tagged_words(t), "word").select("token", *[F.round(c, 6).alias(c) for c in ("pos", "neg", "obj")])


@query("WITH " + TLEX + " SELECT word FROM vocab ANTI JOIN lex ON word = token")
def lexicon_noscore(t: Tables) -> DataFrame:
    words = written(tagged_words(t).select("word").distinct(), "words")
    return words.join(lexicon(words, "word").select(F.col("token").alias("word")), "word", "left_anti")


@query("WITH " + WLEX + " SELECT doc_id, term, round(w * coalesce(s, 1), 6) AS mul FROM w LEFT JOIN lex ON term = token")
def all_words_mul(t: Tables) -> DataFrame:
    w = written(weights(t), "weights")
    return L.all_words(w, lexicon(w, "term")).select("doc_id", "term", F.round("mul", 6).alias("mul"))


@query("WITH " + WLEX + " SELECT doc_id, term, round(coalesce(s, 0), 6) AS score FROM w LEFT JOIN lex ON term = token")
def all_words_score(t: Tables) -> DataFrame:
    w = written(weights(t), "weights")
    return L.all_words(w, lexicon(w, "term")).select("doc_id", "term", F.round("score", 6).alias("score"))


_NOUN = TLEX + """, ns AS (SELECT doc_id, avg(s) AS score FROM tokens JOIN lex ON word = token WHERE tag NOT IN ('NN', 'NNS') AND s <> 0 GROUP BY doc_id)"""


@query("WITH " + _NOUN + " SELECT DISTINCT doc_id, lemma, round(score, 6) AS score FROM tokens JOIN ns USING (doc_id) WHERE tag IN ('NN', 'NNS')")
def noun_scores(t: Tables) -> DataFrame:
    a = annotated(t)
    return L.noun_scores(a, lexicon(a, "word"), A.NOUNS).withColumn("score", F.round("score", 6))


@query("WITH " + _NOUN + """, nl AS (SELECT DISTINCT doc_id, lemma AS term, score FROM tokens JOIN ns USING (doc_id) WHERE tag IN ('NN', 'NNS')), """
       + W_ + " SELECT doc_id, term, round(w * score, 6) AS mul FROM w JOIN nl USING (doc_id, term)")
def noun_mul(t: Tables) -> DataFrame:
    a = annotated(t)
    scores = L.noun_scores(a, lexicon(a, "word"), A.NOUNS).withColumnRenamed("lemma", "term")
    return weights(t).join(scores, ["doc_id", "term"]).select("doc_id", "term", F.round(F.col("w") * F.col("score"), 6).alias("mul"))


@query("WITH " + POL + " SELECT doc_id, sent_idx, round(polarity, 6) + 0 AS polarity FROM pol")
def sentence_polarity(t: Tables) -> DataFrame:
    a = annotated(t)
    return L.sentence_polarity(a, lexicon(a, "word")).withColumn("polarity", F.round("polarity", 6) + 0.0)


@query("WITH " + POL + """, v AS (SELECT word, sum((polarity > 0)::INT)::BIGINT AS n_pos, sum((polarity < 0)::INT)::BIGINT AS n_neg, count(*) AS n_all
   FROM (SELECT DISTINCT doc_id, sent_idx, word FROM tokens) JOIN lex ON word = token JOIN pol USING (doc_id, sent_idx) WHERE s = 0 GROUP BY word)
 SELECT word, n_pos, n_neg, n_all, round(CASE WHEN n_pos / n_all > 0.5 THEN n_pos / n_all WHEN n_neg / n_all > 0.5 THEN -n_neg / n_all ELSE 0 END, 6) AS prob FROM v""")
def objective_words(t: Tables) -> DataFrame:
    a = annotated(t)
    lex = lexicon(a, "word")
    return L.objective_words(a, lex, L.sentence_polarity(a, lex)).withColumn("prob", F.round("prob", 6))


@query("WITH " + GOV + ", vocab AS (SELECT DISTINCT word FROM tokens)," + LEX + """ SELECT a.doc_id, a.lemma, round(sum((CASE WHEN pos > neg THEN pos WHEN neg > pos THEN -neg ELSE 0 END) * CASE WHEN g.tok_idx IS NULL THEN 1 ELSE -1 END), 6) AS score
 FROM gov a JOIN lex ON a.word = token LEFT JOIN tokens g ON g.dep = 'neg' AND g.doc_id = a.doc_id AND g.sent_idx = a.sent_idx AND g.head_idx = a.tok_idx
 WHERE a.tag = 'JJ' AND child IN ('amod', 'acomp') GROUP BY ALL""")
def adjective_noun_score(t: Tables) -> DataFrame:
    a = annotated(t)
    return L.adjective_noun(a, lexicon(a, "word")).withColumn("score", F.round("score", 6))


_SENSES = """byte AS (SELECT word, p AS place, md5(word || '#' || p) AS h FROM (SELECT DISTINCT word FROM tokens), unnest(range(1, ('0x' || substr(md5(word), 1, 2))::INT % 4 + 2)) AS u(p)),
 sense AS (SELECT word AS token, place, substr('asnr', ('0x' || substr(h, 1, 2))::INT % 4 + 1, 1) AS cls, ('0x' || substr(h, 3, 2))::INT % 2 + 1 AS number,
   ('0x' || substr(h, 5, 2))::INT / 256 AS pos, ('0x' || substr(h, 7, 2))::INT / 256 AS neg FROM byte)"""


@query("WITH " + ANN + ", " + _SENSES + """, r AS (SELECT *, row_number() OVER (PARTITION BY token ORDER BY NOT (cls IN ('a', 's') AND number = 1), place) AS r FROM sense)
 SELECT token, place::INT AS place, cls, number::INT AS number, round(pos, 6) AS pos, round(neg, 6) AS neg FROM r WHERE r = 1""")
def sense_choice(t: Tables) -> DataFrame:
    """The sense of each word that counts: the first adjective's or satellite's of number 1, else the first."""
    senses = L.hash_senses(tagged_words(t).select(F.col("word").alias("term")).distinct())
    return L.preferred_sense(senses).select("token", "place", "cls", "number", F.round("pos", 6).alias("pos"), F.round("neg", 6).alias("neg"))


def _aspect_reviews(t: Tables) -> DataFrame:
    """Each aspect (noun, bigram or trigram) in each review: mean polarity of its sentences, and their words' signed
    lexicon scores as one sum. A review's sentence scores are one array, so that aspects meet them by document."""
    m = Mined(t)
    scores = L.sentence_scores(m.tokens, lexicon(m.tokens, "word"))
    of_review = scores.groupBy("doc_id").agg(L.by_sentence("polarity", "signed").alias("scores"))
    of_review = kept_apart("review-scores", m.parts, "doc_id", of_review.repartition(m.parts, "doc_id"))
    score = F.get("scores", F.col("sent_idx"))

    def per_review(rows: DataFrame) -> DataFrame:
        scored = rows.join(of_review, "doc_id").select("lemma", "doc_id", "sent_idx", score["polarity"].alias("polarity"), score["signed"].alias("signed"))
        return scored.groupBy("lemma", "doc_id").agg(
            (F.floor(F.avg("polarity") * 1e6) / 1e6).alias("blob"), F.count("*").alias("n_sents"), F.min("sent_idx").alias("first_sent"), F.sum("signed").alias("lx")
        )

    per = reduce(DataFrame.unionByName, map(per_review, m.aspects())).withColumn("rating", F.col("doc_id") % 5 + 1)
    return per.withColumn("class", L.polarity_class(F.col("rating"), F.col("blob"), F.col("lx")))


@query("WITH " + OCC + " SELECT lemma, n_reviews FROM top")
def top_aspects(t: Tables) -> DataFrame:
    """Aspects by the reviews that hold them; each is grouped by review in its place."""
    counts = [rows.groupBy("lemma", "doc_id").agg(F.lit(1)).groupBy("lemma").agg(F.count("*").alias("n_reviews")) for rows in Mined(t).aspects()]
    return reduce(DataFrame.unionByName, counts).orderBy(F.desc("n_reviews"), "lemma")


@query("WITH " + OCC + """, txt AS (SELECT lemma, doc_id, string_agg(sent, '' ORDER BY sent_idx) AS text, min(sent_idx) AS first_sent, arg_min(start, sent_idx) AS first_char
   FROM occ JOIN sents USING (doc_id, sent_idx) JOIN tokens USING (doc_id, sent_idx, tok_idx) GROUP BY occ.lemma, doc_id)
 SELECT lemma, doc_id, md5(text) AS text_md5, length(text) AS text_length, first_sent::INT AS first_sent, first_char FROM txt""".replace("SELECT lemma, doc_id, string_agg", "SELECT occ.lemma, doc_id, string_agg"))
def aspect_texts(t: Tables) -> DataFrame:
    """The sentences of each aspect in each review as one text, and the character at which the aspect stands first. A
    review's sentences are one array, which its aspects, as one array too, meet by document."""
    m = Mined(t, ("start",))
    sents = t.documents.select("doc_id", sentences(F.lower("text")).alias("sents")).repartition(m.parts, "doc_id")
    held = kept_apart("review-sentences", m.parts, "doc_id", sents)

    def per_review(rows: DataFrame) -> DataFrame:
        per = rows.groupBy("lemma", "doc_id").agg(F.array_sort(F.collect_list("sent_idx")).alias("at"), F.min_by("start", "sent_idx").alias("first_char"))
        whole = per.groupBy("doc_id").agg(F.collect_list(F.struct("lemma", "at", "first_char")).alias("all")).join(held, "doc_id")
        return whole.select("doc_id", F.explode(F.transform("all", told)).alias("a")).select("a.lemma", "doc_id", "a.t.text_md5", "a.t.text_length", "a.first_sent", "a.first_char")

    def told(a: Column) -> Column:
        # within the array: a row for each aspect would take all sentences of its review along
        texts = F.array(F.array_join(F.transform(a["at"], lambda i: F.get("sents", i)), ""))
        sums = F.get(F.transform(texts, lambda x: F.struct(F.md5(x).alias("text_md5"), F.length(x).cast("long").alias("text_length"))), 0)
        return F.struct(a["lemma"].alias("lemma"), sums.alias("t"), F.get(a["at"], F.lit(0)).alias("first_sent"), a["first_char"].alias("first_char"))

    return reduce(DataFrame.unionByName, map(per_review, m.aspects()))


@query("WITH " + ANN + """, f AS (SELECT doc_id, sent_idx, min(start) AS spot FROM tokens WHERE tag IN ('NN', 'NNS') GROUP BY ALL), x AS (SELECT doc_id, sent_idx, sent, spot, string_split(sent, ' ') AS ws FROM f JOIN sents USING (doc_id, sent_idx)),
 w AS (SELECT doc_id, sent_idx, spot, sent, len(ws) AS m, j, j + sum(length(ws[j])) OVER (PARTITION BY doc_id, sent_idx ORDER BY j) AS place FROM x, unnest(range(0, len(ws) + 1)) AS u(j)),
 l AS (SELECT doc_id, sent_idx, any_value(sent) AS sent, any_value(m) AS m, count(*) FILTER (place < spot) AS word, list(place ORDER BY j) AS places
   FROM (SELECT * REPLACE (coalesce(place, 0) AS place) FROM w) GROUP BY ALL),
 r AS (SELECT doc_id, sent_idx, sent, r, substr(sent, places[greatest(0, word - r) + 1]::INT + 1, (places[least(word + r + 1, m) + 1] - places[greatest(0, word - r) + 1])::INT) AS part FROM l, unnest(range(0, 11)) AS u(r)),
 b AS (SELECT doc_id, sent_idx, any_value(sent) AS sent, arg_max(part, r) FILTER (length(part) <= 80) AS part FROM r GROUP BY ALL)
 SELECT doc_id, sent_idx, regexp_replace(regexp_replace(CASE WHEN length(sent) <= 80 THEN sent ELSE coalesce(part, '') END, '^[ \\t\\n\\r\\f\\v]+', ''), '[ \\t\\n\\r\\f\\v]+$', '') AS shown FROM b""")
def snippets(t: Tables) -> DataFrame:
    """Each sentence, where it is long, cut down to the words around its first noun."""
    first = A.with_starts(tokens(t)).filter(F.col("tag").isin(*A.NOUNS)).groupBy("doc_id", "sent_idx").agg(F.min("start").alias("at"))
    sents = t.documents.select("doc_id", F.posexplode(sentences(F.lower("text"))).alias("sent_idx", "sent"))
    return sents.join(first, ["doc_id", "sent_idx"]).select("doc_id", "sent_idx", snippet(F.col("sent"), F.col("at")).alias("shown"))


_RARE = ANN + """, rare AS (SELECT lemma FROM (SELECT lemma, count(*) AS c, sum(count(*)) OVER () AS n FROM tokens GROUP BY lemma) WHERE ln(c / n) < -5 AND lemma NOT IN ('the', 'data')),
 occ AS (SELECT lemma, count(*) AS n_occ, count(DISTINCT (doc_id, sent_idx)) AS n_sents, count(DISTINCT doc_id) AS n_reviews FROM tokens SEMI JOIN rare USING (lemma) WHERE tag IN ('NN', 'NNS') GROUP BY lemma)"""


@query("WITH " + _RARE + " SELECT lemma, n_occ, n_sents, n_reviews FROM occ")
def rare_unigrams(t: Tables) -> DataFrame:
    docs = t.documents.select("doc_id", "text").repartition(parts_of(t.documents), "doc_id")
    excluded = docs.sparkSession.createDataFrame([("the",), ("data",)], "lemma string")
    sums = written(G.lemma_sums(A.lemma_rows(docs)), "lemma-sums")
    return G.rare_of(sums, -5.0, excluded).filter("n_occ > 0").select("lemma", "n_occ", "n_sents", "n_reviews")


@query("WITH " + ASP + " SELECT lemma, doc_id, rating, blob + 0 AS blob, n_sents, first_sent, class FROM cls")
def aspect_polarity(t: Tables) -> DataFrame:
    return _aspect_reviews(t).select("lemma", "doc_id", "rating", (F.col("blob") + 0.0).alias("blob"), "n_sents", "first_sent", "class")


@query("WITH " + ASP + " SELECT lemma, doc_id, class, CASE WHEN class = 'neg' THEN blob ELSE -blob END + 0 AS place_key FROM cls")
def class_order(t: Tables) -> DataFrame:
    """Reviews of an aspect and class from the clearest on: the least polarity first where it is negative."""
    key = F.when(F.col("class") == "neg", F.col("blob")).otherwise(-F.col("blob")) + 0.0
    rows = _aspect_reviews(t).select("lemma", "doc_id", "class", key.alias("place_key"))
    return rows.orderBy("lemma", "class", "place_key", "doc_id")


@query("WITH " + ASP + """ SELECT lemma, round(avg((class = 'pos')::INT), 3) * 100 AS pos, round(avg((class = 'mixed')::INT), 3) * 100 AS mixed,
 round(avg((class = 'neg')::INT), 3) * 100 AS neg, round(sum(rating * n_sents) / sum(n_sents), 6) AS rating FROM cls GROUP BY lemma""")
def polarity_share(t: Tables) -> DataFrame:
    """Shares of an aspect's reviews by class; the mean rating counts each of its sentences."""
    share = lambda c: (F.round(F.avg((F.col("class") == c).cast("double")), 3) * 100).alias(c)
    return _aspect_reviews(t).groupBy("lemma").agg(share("pos"), share("mixed"), share("neg"), F.round(F.sum(F.col("rating") * F.col("n_sents")) / F.sum("n_sents"), 6).alias("rating"))
