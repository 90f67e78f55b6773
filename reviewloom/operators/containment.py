"""Strings that hold a word, by an index of short substrings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of the indexed substrings; shorter words are looked up whole.
GRAM = 3


def _grams(x: Column, n: int) -> Column:
    """Distinct substrings of n characters."""
    places = F.sequence(F.lit(1), F.length(x) - n + 1)
    return F.when(F.length(x) >= n, F.array_distinct(F.transform(places, lambda i: F.substring(x, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def contained(words: DataFrame, strings: DataFrame, word_col: str = "word", string_col: str = "string") -> DataFrame:
    """(word, string): each word with each string that it is a part of; an empty word has none.

    Strings are indexed by their substrings of one to three characters. A word must hold each of its own there, so it
    is looked up by the one that the fewest strings hold, and what that gives is compared. The join is by equal
    substrings; a common one that is some word's rarest is split by adaptive execution.
    """
    own = words.select(F.col(word_col).alias("word")).filter("word <> ''").distinct()
    texts = strings.select(F.col(string_col).alias("string")).distinct()
    index = texts.select("string", F.explode(F.concat(*[_grams(F.col("string"), n) for n in range(1, GRAM + 1)])).alias("gram"))
    frequency = index.groupBy("gram").agg(F.count("*").alias("n"))
    short = F.length("word") < GRAM
    keys = own.select("word", F.explode(F.when(short, F.array("word")).otherwise(_grams(F.col("word"), GRAM))).alias("gram"))
    known = keys.join(frequency, "gram", "left").groupBy("word").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("gram"))
    return known.join(index, "gram").filter(F.contains("string", F.col("word"))).select("word", "string")
