"""Words of Han text by a dictionary: the most probable path through the lattice of its words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import if_few, written

_RUN = "[\\p{IsHan}]+|[\\p{L}\\p{N}_&&[^\\p{IsHan}]]+"


def _best(places: Column) -> Column:
    """Lengths of the words along the best path; places are arrays of (n, score), one for each character.

    From the last place backwards, each place keeps the best sum to the end and the length of the word it begins with;
    of equal sums the longer word's. Then the lengths are followed from the first place on.
    """
    start = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("n")))

    def back(done: Column, words: Column) -> Column:
        # done holds the places behind this one, the nearest first
        each = F.transform(words, lambda w: F.struct((w["score"] + F.get(done, w["n"] - 1)["score"]).alias("score"), w["n"].alias("n")))
        return F.concat(F.array(F.array_max(each)), done)

    kept = F.aggregate(F.reverse(places), start.cast("array<struct<score:double,n:int>>"), back)

    def walk(state: Column, x: Column) -> Column:
        wait = state["wait"] > 0
        return F.struct(F.when(wait, state["wait"] - 1).otherwise(x["n"] - 1).alias("wait"), F.when(wait, state["ns"]).otherwise(F.concat(state["ns"], F.array(x["n"]))).alias("ns"))

    begin = F.struct(F.lit(0).alias("wait"), F.array().cast("array<int>").alias("ns"))
    return F.aggregate(F.slice(kept, F.lit(1), F.size(kept) - 1), begin, walk)["ns"]


def segmented(runs: DataFrame, dictionary: DataFrame, longest: int) -> DataFrame:
    """(text, words) of distinct runs of Han characters (text)."""
    total = dictionary.agg(F.sum("freq").cast("double").alias("_total"))
    weighted = dictionary.groupBy("word").agg(F.sum("freq").alias("freq")).join(F.broadcast(total)).select(F.col("word").alias("sub"), F.log(F.col("freq") / F.col("_total")).alias("score"))
    places = runs.select("text", F.explode(F.sequence(F.lit(1), F.length("text"))).alias("at"))
    lengths = F.sequence(F.lit(1), F.least(F.lit(longest), F.length("text") - F.col("at") + 1))
    subs = places.select("text", "at", F.explode(lengths).alias("n")).withColumn("sub", F.substring("text", F.col("at"), F.col("n")))
    edges = subs.join(if_few(weighted), "sub", "left").filter("n = 1 or score is not null").join(F.broadcast(total))
    at = edges.groupBy("text", "at").agg(F.collect_list(F.struct(F.col("n").cast("int").alias("n"), F.coalesce("score", -F.log("_total")).alias("score"))).alias("words"), F.max("n").alias("most"))
    order = W.partitionBy("text").orderBy("at")
    reach = F.max(F.col("at") + F.col("most")).over(order.rowsBetween(W.unboundedPreceding, -1))
    pieces = at.withColumn("_new", (F.coalesce(reach, F.lit(0)) <= F.col("at")).cast("int")).withColumn("piece", F.sum("_new").over(order))
    whole = pieces.groupBy("text", "piece").agg(F.array_sort(F.collect_list(F.struct("at", "words"))).alias("ps"))
    cut = whole.select("text", "piece", F.get("ps", 0)["at"].alias("at"), _best(F.transform("ps", lambda p: p["words"])).alias("ns"))
    begin = F.struct(F.col("at").alias("end"), F.array().cast("array<struct<from:int,n:int>>").alias("all"))
    ends = F.aggregate("ns", begin, lambda s, n: F.struct((s["end"] + n).alias("end"), F.concat(s["all"], F.array(F.struct(s["end"].alias("from"), n.alias("n")))).alias("all")))["all"]
    found = cut.select("text", "piece", F.transform(ends, lambda e: F.substring("text", e["from"], e["n"])).alias("words"))
    parts = found.groupBy("text").agg(F.array_sort(F.collect_list(F.struct("piece", "words"))).alias("parts"))
    return parts.select("text", F.flatten(F.transform("parts", lambda p: p["words"])).alias("words"))


def han_words(docs: DataFrame, dictionary: DataFrame, longest: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, words): the words of each text in order; dictionary is (word, freq), longest its longest word's length.

    Runs of other letters and digits are words by themselves; marks and blanks are none. In a run of Han characters,
    words that the dictionary has, and each single character, weigh ln(freq / sum of freq), freq 1 where it lacks a
    character; the run is cut so that the sum is greatest. A run is first cut where no word of the dictionary crosses,
    as any path must pass there, so that a piece is no longer than a chain of overlapping words. Each run is cut once,
    however many texts hold it, and only runs of Han characters leave their texts. A null text has no words; id_col is
    each document's own.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    runs = F.regexp_extract_all(F.col("text"), F.lit(_RUN), F.lit(0))
    han = texts.select("doc_id", F.posexplode(F.transform(runs, lambda r: F.when(r.rlike("^[\\p{IsHan}]"), r))).alias("run", "text")).filter("text is not null")
    known = written(segmented(han.select("text").distinct(), dictionary, longest), "han-runs")
    own = han.join(if_few(known), "text").groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("run", "words"))).alias("cut"))
    words = F.flatten(F.transform(runs, lambda r, i: F.coalesce(F.try_element_at("cut", i), F.array(r))))
    return texts.join(own, "doc_id", "left").select("doc_id", F.coalesce(words, F.array().cast("array<string>")).alias("words"))
