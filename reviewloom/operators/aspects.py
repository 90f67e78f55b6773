"""Aspect mining over token tables: noun unigrams, associated bigrams, chained trigrams."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .annotate import NOUNS
from .shared import kept_apart, met, written

#: Tags and relations that a noun's neighbour in a bigram doesn't have.
COMMON_TAGS = ("DT", "IN", "CC", "VBZ", "NEG", "RB")


def lemma_counts(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("lemma").agg(F.count("*").alias("cnt"))


def governed(tokens: DataFrame) -> DataFrame:
    """(lemma, child, doc_id, word, tag, negated): each noun's dependents. An adjective after a copula depends on the copula
    and also on the copula's subject: "the room is spacious" counts for room. Tokens without a governor have no row, since
    nothing is left to be exploded; a filter on heads before would derive them twice."""
    governors = F.array(
        F.when(F.col("head_tag").isin(*NOUNS), F.col("head_lemma")),
        F.when(F.col("dep") == "acomp", F.col("subj_lemma")),
    )
    return tokens.select(F.explode(F.array_compact(governors)).alias("lemma"), F.col("dep").alias("child"), "doc_id", "word", "tag", "negated")


def unigrams(tokens: DataFrame, min_pct: float = 0.001, a_pct: float = 0.0, among: DataFrame | None = None) -> DataFrame:
    """(lemma, n_occ, n_sents, n_reviews, a_share): nouns in at least min_pct of all sentences, of whose dependents at
    least a_pct are adjectives; a noun without dependents stays, with a null share. Only those of among (lemma) count,
    if it is given.

    Tokens are read once: each is counted for its own noun, for the nouns that it depends on, and, where it is its
    sentence's first, for the sentences, under no lemma. Tokens of documents that were dealt out by doc_id meet in their
    place. The sums, a row a lemma, are written."""
    role = lambda lemma, own, adj: F.struct(lemma.alias("lemma"), own.alias("own"), adj.alias("adj"))
    yes, no = F.lit(True), F.lit(False)
    adjective = F.col("dep").isin("amod", "acomp")
    roles = F.array(
        F.when(F.col("tok_idx") == 0, role(F.lit(None).cast("string"), yes, no)),
        F.when(F.col("tag").isin(*NOUNS), role(F.col("lemma"), yes, no)),
        F.when(F.col("head_tag").isin(*NOUNS), role(F.col("head_lemma"), no, adjective)),
        F.when((F.col("dep") == "acomp") & F.col("subj_lemma").isNotNull(), role(F.col("subj_lemma"), no, adjective)),
    )
    rows = tokens.select("doc_id", "sent_idx", F.explode(F.array_compact(roles)).alias("r")).select("doc_id", "sent_idx", "r.*")
    per_sentence = rows.groupBy("lemma", "doc_id", "sent_idx").agg(F.count_if("own").alias("occ"), F.count_if(~F.col("own")).alias("deps"), F.count_if("adj").alias("adjs"))
    per_review = per_sentence.groupBy("lemma", "doc_id").agg(F.count_if(F.col("occ") > 0).alias("sents"), *[F.sum(c).alias(c) for c in ("occ", "deps", "adjs")])
    sums = per_review.groupBy("lemma").agg(F.sum("occ").alias("n_occ"), F.sum("sents").alias("n_sents"), F.count_if(F.col("sents") > 0).alias("n_reviews"), F.sum("deps").alias("deps"), F.sum("adjs").alias("adjs"))
    table = written(sums, "unigrams")
    total = table.filter("lemma is null").select(F.col("n_sents").alias("n_sent"))
    nouns = table.filter("lemma is not null and n_occ > 0")
    if among is not None:
        nouns = nouns.join(among.select("lemma"), "lemma", "left_semi")
    return (
        nouns.withColumn("a_share", F.when(F.col("deps") > 0, F.col("adjs") / F.col("deps")))
        .join(F.broadcast(total))
        .filter(F.col("n_sents") >= min_pct * F.col("n_sent"))
        .filter(F.col("a_share").isNull() | (F.col("a_share") >= a_pct))
        .select("lemma", "n_occ", "n_sents", "n_reviews", "a_share")
    )


def noun_neighbours(tokens: DataFrame, reach: int = 1, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, sent_idx, w1, w2, forward, noun_idx, distance): each noun with each neighbour up to reach places away;
    w1 < w2, forward where w1 stands first. Direct neighbours stand in a token's own row; farther ones are looked up in
    a window. keep are more columns of the noun."""
    one = lambda step, other, tag: F.struct(F.lit(step).alias("step"), other.alias("other"), tag.alias("tag"))
    if reach == 1:
        near, beside = tokens, [one(-1, F.col("prev_lemma"), F.col("prev_tag")), one(1, F.col("next_lemma"), F.col("next_tag"))]
    else:
        sentence = W.partitionBy("doc_id", "sent_idx").orderBy("tok_idx")
        beside = [one(i * way, f("lemma", i).over(sentence), f("tag", i).over(sentence)) for i in range(1, reach + 1) for way, f in ((-1, F.lag), (1, F.lead))]
        near, beside = tokens.withColumn("_near", F.array(*beside)), None
    nouns = near.filter(F.col("tag").isin(*NOUNS)).select("doc_id", "sent_idx", "lemma", F.col("tok_idx").alias("noun_idx"), *keep, F.explode(F.array(*beside) if beside else F.col("_near")).alias("_n"))
    pairs = nouns.filter(F.col("_n.other").isNotNull() & ~F.col("_n.tag").isin(*COMMON_TAGS) & (F.col("lemma") != F.col("_n.other")))
    other, w1 = F.col("_n.other"), F.least("lemma", "_n.other")
    first = F.when(F.col("_n.step") < 0, other).otherwise(F.col("lemma"))
    return pairs.select("doc_id", "sent_idx", w1.alias("w1"), F.greatest("lemma", "_n.other").alias("w2"), (first == w1).alias("forward"), "noun_idx", F.abs("_n.step").alias("distance"), *keep)


def pair_sentences(near: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(w1, w2, doc_id, sent_idx, votes, fwd, far, tok_idx): each pair of neighbours in each sentence, and the place of its
    first noun there, with the least of keep's columns. Needs no exchange where tokens were dealt out by doc_id."""
    return near.groupBy("w1", "w2", "doc_id", "sent_idx").agg(
        F.count("*").alias("votes"), F.sum(F.col("forward").cast("int")).alias("fwd"), F.sum("distance").alias("far"), F.min("noun_idx").alias("tok_idx"), *[F.min(c).alias(c) for c in keep]
    )


def supported(per_sentence: DataFrame, min_sents: int = 2, max_avg_distance: float = 2.0) -> DataFrame:
    """(w1, w2, n_sents, n_votes, fwd, avg_distance, n_reviews): pairs in at least min_sents sentences, on average less than
    max_avg_distance places apart, with w1 < w2."""
    per_review = per_sentence.groupBy("w1", "w2", "doc_id").agg(F.count("*").alias("n_sents"), *[F.sum(c).alias(c) for c in ("votes", "fwd", "far")])
    pair = per_review.groupBy("w1", "w2").agg(F.sum("n_sents").alias("n_sents"), F.sum("votes").alias("n_votes"), F.sum("fwd").alias("fwd"), F.sum("far").alias("far"), F.count("*").alias("n_reviews"))
    apart = pair.withColumn("avg_distance", F.round(F.col("far") / F.col("n_votes"), 2)).drop("far")
    return apart.filter((F.col("n_sents") >= min_sents) & (F.col("avg_distance") < max_avg_distance))


def oriented() -> tuple[Column, Column]:
    """w1 and w2 of a supported pair in the order of most of its occurrences."""
    back = (F.col("n_votes") - F.col("fwd")) > F.col("fwd")
    return F.when(back, F.col("w2")).otherwise(F.col("w1")).alias("w1"), F.when(back, F.col("w1")).otherwise(F.col("w2")).alias("w2")


def bigrams(
    tokens: DataFrame, min_sents: int = 2, min_score: float = 0.0, among: DataFrame | None = None, near: DataFrame | None = None, max_avg_distance: float = 2.0
) -> DataFrame:
    """(w1, w2, n_sents, n_votes, avg_distance, score, n_reviews): pairs in at least min_sents sentences, on average less than
    max_avg_distance places apart, oriented by the votes of their occurrences; score is sentences over the product of
    the lemmas' counts. Both words are of among (lemma), if it is given. near are the tokens' neighbours, where they are
    at hand."""
    near = noun_neighbours(tokens) if near is None else near
    for w in ("w1", "w2") if among is not None else ():
        near = near.join(among.select(F.col("lemma").alias(w)), w, "left_semi")
    counts = lemma_counts(tokens)
    scored = (
        supported(pair_sentences(near), min_sents, max_avg_distance)
        .join(counts.select(F.col("lemma").alias("w1"), F.col("cnt").alias("c1")), "w1")
        .join(counts.select(F.col("lemma").alias("w2"), F.col("cnt").alias("c2")), "w2")
        .withColumn("score", F.col("n_sents") / (F.col("c1") * F.col("c2")))
        .filter(F.col("score") >= min_score)
    )
    return scored.select(*oriented(), "n_sents", "n_votes", "avg_distance", "score", "n_reviews")


def bigram_places(found: DataFrame, near: DataFrame, parts: int | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(w1, w2, n_reviews, doc_id, sent_idx, tok_idx): the sentences of each bigram found, with the place of its first noun
    there, kept apart by doc_id. found is a written table (w1, w2, n_sents, n_reviews). Where near's documents were dealt
    out by doc_id to so many parts, only neighbours that may be a less frequent bigram leave their place and return."""
    keyed = found.select(F.least("w1", "w2").alias("k1"), F.greatest("w1", "w2").alias("k2"), "w1", "w2", "n_reviews", "n_sents")
    own = near.select(F.col("w1").alias("k1"), F.col("w2").alias("k2"), "doc_id", "sent_idx", "noun_idx", *keep)

    def placed(rows: DataFrame) -> DataFrame:
        # neighbours are brought together after those that are no bigram have left
        return rows.groupBy("w1", "w2", "n_reviews", "doc_id", "sent_idx").agg(F.min("noun_idx").alias("tok_idx"), *[F.min(c).alias(c) for c in keep])

    return kept_apart("bigram-places", parts, "doc_id", *[x and placed(x) for x in met(own, keyed, ["k1", "k2"], "n_sents")])


def _chains(places: DataFrame, by: list[str], first: tuple[str, ...], second: tuple[str, ...]) -> DataFrame:
    """Bigrams of equal `by` chained by a word: (w1, w2, w3), `by`, the columns first of the one, second of the other. Both
    are gathered by the word that they share, so that places kept apart by doc_id need no exchange."""
    end = lambda own, other, cols, ends: F.struct(F.col(own).alias("w2"), F.when(F.lit(ends), F.struct(F.col(other).alias("w"), *cols)).alias("a"), F.when(F.lit(not ends), F.struct(F.col(other).alias("w"), *cols)).alias("b"))
    cols = list(dict.fromkeys(first + second))
    ends = places.select(*by, F.explode(F.array(end("w2", "w1", cols, True), end("w1", "w2", cols, False))).alias("e")).select(*by, "e.*")
    shared = ends.groupBy(*by, "w2").agg(F.collect_list("a").alias("a"), F.collect_list("b").alias("b")).filter((F.size("a") > 0) & (F.size("b") > 0))
    pairs = shared.select(*by, "w2", F.explode("a").alias("a"), "b").select(*by, "w2", "a", F.explode("b").alias("b"))
    return pairs.select(F.col("a.w").alias("w1"), "w2", F.col("b.w").alias("w3"), *by, *[F.col(f"a.{c}").alias(f"{c}_a") for c in first], *[F.col(f"b.{c}").alias(f"{c}_b") for c in second])


def trigrams(places: DataFrame, min_overlap: float = 0.09) -> DataFrame:
    """(w1, w2, w3, n_common): bigrams chained by a word, both of which min_overlap of the reviews of the rarer one hold;
    places are the bigrams' (bigram_places), n_common the reviews that hold both."""
    reviews = places.groupBy("w1", "w2", "doc_id").agg(F.first("n_reviews").alias("n"))
    chained = _chains(reviews, ["doc_id"], ("n",), ("n",)).withColumn("least", F.least("n_a", "n_b"))
    common = chained.groupBy("w1", "w2", "w3").agg(F.count("*").alias("n_common"), F.first("least").alias("least"))
    return common.filter(F.col("n_common") / F.col("least") >= min_overlap).select("w1", "w2", "w3", "n_common")


def trigram_places(chained: DataFrame, places: DataFrame, parts: int | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(w1, w2, w3, doc_id, sent_idx, tok_idx): the sentences of a trigram's first bigram that are also its second's, with
    the first one's place, kept apart by doc_id as places are. A trigram can have none. chained is a written table."""
    both = _chains(places, ["doc_id", "sent_idx"], ("tok_idx", *keep), ()).select("w1", "w2", "w3", "doc_id", "sent_idx", F.col("tok_idx_a").alias("tok_idx"), *[F.col(f"{c}_a").alias(c) for c in keep])
    return kept_apart("trigram-places", parts, "doc_id", *[x and x.select(both.columns) for x in met(both, chained, ["w1", "w2", "w3"], "n_common")])


def aspect_rows(tokens: DataFrame, places: DataFrame, of_trigrams: DataFrame, keep: tuple[str, ...] = ()) -> list[DataFrame]:
    """(lemma, doc_id, sent_idx, tok_idx) thrice, of nouns, bigrams and trigrams: the sentences of each aspect, its words
    joined by blanks, and the first place there, with keep's columns. No aspect is in two of them. Where tokens and
    places lie by document, so do the rows: what groups one of the three by review needs no exchange."""
    nouns = tokens.filter(F.col("tag").isin(*NOUNS)).groupBy("lemma", "doc_id", "sent_idx").agg(F.min("tok_idx").alias("tok_idx"), *[F.min(c).alias(c) for c in keep])
    named = lambda df, *words: df.select(F.concat_ws(" ", *words).alias("lemma"), "doc_id", "sent_idx", "tok_idx", *keep)
    return [nouns, named(places, "w1", "w2"), named(of_trigrams, "w1", "w2", "w3")]


def occurrences(tokens: DataFrame, places: DataFrame, of_trigrams: DataFrame) -> DataFrame:
    """All aspect_rows as one table."""
    return reduce(DataFrame.unionByName, aspect_rows(tokens, places, of_trigrams))


def rare(tokens: DataFrame, most_log_share: float = -7.5, excluded: DataFrame | None = None) -> DataFrame:
    """(lemma): lemmas whose natural log of their share of all tokens is below most_log_share, without those that
    excluded (lemma) lists as no aspects."""
    return rare_of(written(lemma_counts(tokens), "lemma-counts"), most_log_share, excluded).select("lemma")


def rare_of(counts: DataFrame, most_log_share: float = -7.5, excluded: DataFrame | None = None) -> DataFrame:
    """The rows of a written table of all lemmas and their counts (lemma, cnt, more) that rare would name."""
    total = counts.agg(F.sum("cnt").alias("n_all"))
    kept = counts.join(F.broadcast(total)).filter(F.log(F.col("cnt") / F.col("n_all")) < most_log_share).select(*counts.columns)
    return kept if excluded is None else kept.join(F.broadcast(excluded), "lemma", "left_anti")


def lemma_sums(rows: DataFrame) -> DataFrame:
    """(lemma, cnt, n_occ, n_sents, n_reviews) of lemma_rows: all tokens of each lemma, those that are nouns, and the
    sentences and reviews of these. Rows that share a doc_id are one review; those without are none, but have sentences.
    Rows of documents that were dealt out by doc_id are read once and leave their place as sums."""
    per_sentence = rows.groupBy("lemma", "doc_id", "sent_idx").agg(F.count("*").alias("cnt"), F.count_if("noun").alias("occ"))
    per_review = per_sentence.groupBy("lemma", "doc_id").agg(F.sum("cnt").alias("cnt"), F.sum("occ").alias("occ"), F.count_if(F.col("occ") > 0).alias("sents"))
    reviews = F.count_if((F.col("sents") > 0) & F.col("doc_id").isNotNull()).alias("n_reviews")
    return per_review.groupBy("lemma").agg(F.sum("cnt").alias("cnt"), F.sum("occ").alias("n_occ"), F.sum("sents").alias("n_sents"), reviews)
