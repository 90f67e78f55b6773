"""Term features in long form: one row for each document and term."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import vector_tokens
from .shared import if_few, parts_of, sieved, split_often, written


def term_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, term, tf). Documents without terms have no rows."""
    tokens = docs.select(F.col(id_col).alias("doc_id"), F.explode(vector_tokens(F.col(text_col))).alias("term"))
    return tokens.groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


def term_frequency(counts: DataFrame) -> DataFrame:
    return counts.groupBy("term").agg(F.sum("tf").alias("freq"))


def ranked(scores: DataFrame, value: str, k: int | None = None) -> DataFrame:
    """scores with rank: by value downward, equal values by term. With k, only the first k, found without ranking all."""
    order = [F.desc(value), F.asc("term")]
    if k is not None:
        scores = scores.orderBy(*order).limit(k)
    return scores.withColumn("rank", F.row_number().over(W.orderBy(*order)))


def document_frequency(counts: DataFrame) -> DataFrame:
    return counts.groupBy("term").agg(F.count("*").alias("df"))


def tfidf(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", without: Sequence[str] = (), only: DataFrame | None = None) -> DataFrame:
    """(doc_id, term, w): tf * (ln((1+n)/(1+df)) + 1), each document's weights of unit length.

    n and df are of all documents; terms in `without` count for nothing; weights are those of the documents in `only`
    (doc_id), if it is given. id_col is each document's own. Document frequencies are made first, as a table of the terms
    that more than one document has. The most frequent are broadcast; occurrences of the others, once a document, are
    exchanged to meet their weights and go on to their document with its text, which is dealt out by id once, so that
    its counts and its length need no more exchange.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kept = lambda tokens: F.filter(tokens, lambda t: ~t.isin(list(without))) if without else tokens
    n = texts.count()
    df = texts.select(F.explode(F.array_distinct(kept(vector_tokens(F.col("text"))))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    weight = lambda x: F.log(F.lit(1.0 + n) / (1 + x)) + 1
    table = written(df.filter("df > 1").select("term", weight(F.col("df")).alias("idf"), "df"), "idf")
    often, seldom = split_often(table, "df")
    parts = parts_of(texts)
    if only is not None:
        texts = texts.join(if_few(only.select("doc_id")), "doc_id", "left_semi")
    terms = kept(vector_tokens(F.col("text")))
    dealt = texts.select("doc_id", "text", F.lit(None).cast("string").alias("term"), F.lit(None).cast("double").alias("idf"))
    if seldom is not None:
        own = texts.select("doc_id", F.explode(F.array_distinct(terms)).alias("term"))
        moved = sieved(own, seldom, ["term"]).join(seldom.drop("df"), "term")
        dealt = dealt.unionByName(moved.select("doc_id", F.lit(None).cast("string").alias("text"), "term", "idf"))
    found = F.when(F.col("term").isNull(), terms).otherwise(F.array("term"))
    each = dealt.repartition(parts, "doc_id").select("doc_id", "idf", F.explode(found).alias("term"))
    counts = each.groupBy("doc_id", "term").agg(F.count_if(F.col("idf").isNull()).alias("tf"), F.max("idf").alias("own"))
    known = F.coalesce("own", "idf", weight(F.lit(1)))
    raw = counts.join(F.broadcast(often.drop("df")), "term", "left").select("doc_id", "term", (F.col("tf") * known).alias("v"))
    length = F.sqrt(F.sum(F.col("v") * F.col("v")).over(W.partitionBy("doc_id")))
    return raw.select("doc_id", "term", (F.col("v") / length).alias("w"))


def without_terms(counts: DataFrame, words: list[str]) -> DataFrame:
    return counts.filter(~F.col("term").isin(words))


def chi2(weights: DataFrame, labels: DataFrame, value: str = "w") -> DataFrame:
    """(term, chi2) of summed weights against classes, over documents with a label (doc_id, cls)."""
    shares = labels.groupBy("cls").agg(F.count("*").alias("n")).withColumn("p", F.col("n") / F.sum("n").over(W.partitionBy()))
    observed = weights.join(if_few(labels), "doc_id").groupBy("term", "cls").agg(F.sum(value).alias("o"))
    # classes where a term is absent add p * total each: sum (o-e)^2/e = sum o^2/e - total
    parts = observed.join(F.broadcast(shares.select("cls", "p")), "cls")
    return parts.groupBy("term").agg((F.sum(F.col("o") * F.col("o") / F.col("p")) / F.sum("o") - F.sum("o")).alias("chi2"))


def gini(counts: DataFrame, labels: DataFrame) -> DataFrame:
    """(term, gini, major, num_pos, num_neg, total): purity of the classes (cls 1 or 0) among documents with a term;
    major is 1, 0, or 2 when even."""
    per = counts.join(if_few(labels), "doc_id").groupBy("term").agg(F.sum("cls").alias("num_pos"), F.count("*").alias("total"))
    neg = F.col("total") - F.col("num_pos")
    purity = F.pow(F.col("num_pos") / F.col("total"), 2) + F.pow(neg / F.col("total"), 2)
    major = F.when(F.col("num_pos") > neg, 1).when(F.col("num_pos") < neg, 0).otherwise(2)
    return per.select("term", purity.alias("gini"), major.alias("major"), "num_pos", neg.alias("num_neg"), "total")


def base_gini(labels: DataFrame) -> DataFrame:
    share = F.avg("cls")
    return labels.agg((share * share + (1 - share) * (1 - share)).alias("base_gini"), F.sum("cls").alias("n_pos"), (F.count("*") - F.sum("cls")).alias("n_neg"))


def gini_threshold(scores: DataFrame, base: DataFrame) -> DataFrame:
    """Terms at least as pure as all documents, and at least as often positive; none negative passes."""
    pure = F.col("gini") >= F.col("base_gini")
    positive = (F.col("num_neg") == 0) | (F.col("num_pos") / F.nullif(F.col("num_neg"), F.lit(0)) >= F.col("n_pos") / F.col("n_neg"))
    return scores.join(F.broadcast(base)).filter(pure & positive).select(*scores.columns)


def mean_nonzero(weights: DataFrame, on: Column) -> DataFrame:
    """(term, mean_w) over the rows where `on` holds and the weight isn't 0."""
    return weights.filter(on & (F.col("w") > 0)).groupBy("term").agg(F.avg("w").alias("mean_w"))


def abc_sets(a: DataFrame, b: DataFrame) -> DataFrame:
    """(term, part, rank): C holds the terms of both rankings; A and B keep the first size(C) of their other terms."""
    c = a.select("term").join(b.select("term"), "term", "left_semi")
    size = c.agg(F.count("*").alias("size"))

    def rest(ranking: DataFrame, name: str) -> DataFrame:
        left = ranking.join(c, "term", "left_anti").withColumn("rank", F.row_number().over(W.orderBy("rank")))
        return left.join(F.broadcast(size)).filter(F.col("rank") <= F.col("size")).select("term", F.lit(name).alias("part"), "rank")

    shared = c.withColumn("rank", F.row_number().over(W.orderBy("term"))).select("term", F.lit("C").alias("part"), "rank")
    return rest(a, "A").unionByName(rest(b, "B")).unionByName(shared)


def substituted(weights: DataFrame, means: DataFrame, chosen: DataFrame) -> DataFrame:
    """weights (doc_id, term, w) with the weight of each chosen term (term, appears) set in every document: its mean in
    means (term, mean_w) if it is to appear, else none. Documents are those that weights has."""
    docs = weights.select("doc_id").distinct()
    put = chosen.filter("appears").join(means, "term").select("term", F.col("mean_w").alias("w"))
    other = weights.join(F.broadcast(chosen.select("term")), "term", "left_anti").select("doc_id", "term", "w")
    return other.unionByName(docs.withColumn("_puts", F.lit(1)).join(F.broadcast(put.withColumn("_puts", F.lit(1))), "_puts").select("doc_id", "term", "w"))


def removed(weights: DataFrame, chosen: DataFrame) -> DataFrame:
    """weights without the chosen terms."""
    return weights.join(F.broadcast(chosen.select("term")), "term", "left_anti")


def class_changed(rows: DataFrame, cls: str) -> DataFrame:
    """rows, all of one class: a test set whose labels are overwritten."""
    return rows.withColumn("class", F.lit(cls))


def encoded_labels(rows: DataFrame, col: str) -> DataFrame:
    """rows with `code`: the place of the label among the sorted labels, from 0."""
    classes = rows.select(col).distinct().withColumn("code", F.row_number().over(W.orderBy(col)) - 1)
    return rows.join(F.broadcast(classes), col)
