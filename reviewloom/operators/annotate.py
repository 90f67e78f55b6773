"""A rule-based annotator: token tables with tags, lemmas and heads, all in column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import sentences

# Closed-class words and their tags.
CLOSED = {
    "DT": ("the", "a", "an", "this", "that", "der", "die", "das", "le", "la", "les", "el", "los", "un", "une"),
    "IN": ("of", "in", "on", "at", "to", "for", "with", "by", "from", "de", "en", "von", "mit", "zu"),
    "CC": ("and", "or", "but", "und", "et", "que", "y"),
    "VBZ": ("is", "are", "was", "were", "be", "ist", "est", "es"),
    "NEG": ("not", "never", "no", "nicht", "pas"),
}
# Endings and their tags, tried in this order.
ENDINGS = (("ly", "RB"), ("ing", "VBG"), ("ed", "VBD"), ("ous", "JJ"), ("ful", "JJ"), ("able", "JJ"), ("ible", "JJ"), ("ive", "JJ"), ("ble", "JJ"), ("s", "NNS"))
NOUNS = ("NN", "NNS")
_WORD = "[\\p{L}\\p{N}_]+"


def tag(word: Column) -> Column:
    """Tag of a lower-case word: closed class, else ending, else NN."""
    out = F.when(word.isNull(), F.lit(None).cast("string"))
    for name, words in CLOSED.items():
        out = out.when(word.isin(*words), name)
    for ending, name in ENDINGS:
        out = out.when((F.length(word) > len(ending) + 1) & word.endswith(ending), name)
    return out.otherwise("NN")


def lemma(word: Column, tagged: Column) -> Column:
    """A plural noun without its s; any other word as it is."""
    return F.when(tagged == "NNS", F.left(word, F.length(word) - 1)).otherwise(word)


def _shifted(ts: Column, by: int) -> Column:
    """The array moved by so many places, nulls before it; the longer array's end counts for nothing."""
    empty = F.struct(*[F.lit(None).cast("string").alias(c) for c in ("word", "tag")])
    return F.concat(F.array_repeat(empty, by), ts)


def sentence_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, sent_idx, ts, gaps): one row a sentence, its words with their tags, and the numbers of characters before
    each word and after the last one. Small enough to be written once for what reads it several times."""
    sents = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(sentences(F.lower(text_col))).alias("sent_idx", "sent"))
    words = sents.select("doc_id", "sent_idx", F.regexp_extract_all("sent", F.lit(_WORD), F.lit(0)).alias("ws"), F.transform(F.split("sent", _WORD), F.length).alias("gaps"))
    return words.select("doc_id", "sent_idx", F.transform("ws", lambda w: F.struct(w.alias("word"), tag(w).alias("tag"))).alias("ts"), "gaps")


def lemma_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, sent_idx, lemma, noun), one row a token, for what needs neither neighbours nor heads: words are tagged as
    rows, not within arrays."""
    sents = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(sentences(F.lower(text_col))).alias("sent_idx", "sent"))
    words = sents.select("doc_id", "sent_idx", F.explode(F.regexp_extract_all("sent", F.lit(_WORD), F.lit(0))).alias("word")).withColumn("tag", tag(F.col("word")))
    return words.select("doc_id", "sent_idx", lemma(F.col("word"), F.col("tag")).alias("lemma"), F.col("tag").isin(*NOUNS).alias("noun"))


def token_rows(sents: DataFrame) -> DataFrame:
    """(doc_id, sent_idx, tok_idx, word, lemma, tag, dep, head_idx, head_word, head_lemma, head_tag, subj_idx,
    subj_lemma, negated, prev_lemma, prev_tag, next_lemma, next_tag, gap), one row a token of a sentence table.

    An adjective before a noun is its amod; one after a copula, or after a copula and a negation, is the copula's acomp;
    a noun before a copula is its nsubj; a negation belongs to the next word. Other tokens have dep `dep` and no head.
    subj is a second governor: the copula's subject, of an acomp that has one. negated: a negation stands just before.
    gap counts the characters between a token and the one before it, or the sentence's beginning. All are read off a
    sentence's array, so that no table is joined with itself.
    """
    ts = F.col("ts")
    beside = {"t": ts, "p1": _shifted(ts, 1), "p2": _shifted(ts, 2), "p3": _shifted(ts, 3), "n1": F.slice(ts, F.lit(2), F.size(ts)), "g": F.col("gaps")}
    near = sents.select("doc_id", "sent_idx", F.posexplode(F.arrays_zip(*[x.alias(n) for n, x in beside.items()])).alias("tok_idx", "x")).filter("x.t is not null")
    at = lambda name, field="tag": F.coalesce(F.col(f"x.{name}.{field}"), F.lit(""))
    base = lambda x: lemma(x["word"], x["tag"])
    late = (at("p1") == "NEG") & (at("p2") == "VBZ")
    dep = (
        F.when((at("t") == "NEG") & (at("n1") != ""), "neg")
        .when((at("t") == "JJ") & at("n1").isin(*NOUNS), "amod")
        .when((at("t") == "JJ") & ((at("p1") == "VBZ") | late), "acomp")
        .when(at("t").isin(*NOUNS) & (at("n1") == "VBZ"), "nsubj")
        .otherwise("dep")
    )
    rows = near.withColumn("dep", dep).withColumn("_late", late)
    ahead, behind = F.col("dep").isin("neg", "amod", "nsubj"), F.col("dep") == "acomp"
    head = F.when(ahead, F.col("x.n1")).when(behind & F.col("_late"), F.col("x.p2")).when(behind, F.col("x.p1"))
    subject = F.when(behind, F.when(F.col("_late"), F.col("x.p3")).otherwise(F.col("x.p2")))
    place = F.when(ahead, F.col("tok_idx") + 1).when(behind, F.col("tok_idx") - F.when(F.col("_late"), 2).otherwise(1))
    told = rows.withColumn("_head", head).withColumn("_subject", F.when(subject["tag"].isin(*NOUNS), subject))
    return told.select(
        "doc_id", "sent_idx", "tok_idx", "x.t.word", base(F.col("x.t")).alias("lemma"), "x.t.tag", "dep", place.alias("head_idx"),
        F.col("_head.word").alias("head_word"), base(F.col("_head")).alias("head_lemma"), F.col("_head.tag").alias("head_tag"),
        F.when(F.col("_subject").isNotNull(), F.col("tok_idx") - F.when(F.col("_late"), 3).otherwise(2)).alias("subj_idx"), base(F.col("_subject")).alias("subj_lemma"), (at("p1") == "NEG").alias("negated"),
        base(F.col("x.p1")).alias("prev_lemma"), F.col("x.p1.tag").alias("prev_tag"), base(F.col("x.n1")).alias("next_lemma"), F.col("x.n1.tag").alias("next_tag"), F.col("x.g").alias("gap"),
    )


def token_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The tokens of documents, as token_rows has them."""
    return token_rows(sentence_table(docs, id_col, text_col))


def with_starts(tokens: DataFrame) -> DataFrame:
    """tokens with start: the characters of the sentence before each token."""
    before = W.partitionBy("doc_id", "sent_idx").orderBy("tok_idx").rowsBetween(W.unboundedPreceding, -1)
    return tokens.withColumn("start", (F.coalesce(F.sum(F.col("gap") + F.length("word")).over(before), F.lit(0)) + F.col("gap")).cast("int"))
