"""Lemmas by word class: irregular forms, else endings taken off until a dictionary has the word."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written

# Endings and what stands for them, by word class, in the order in which they are tried.
DETACHED = {
    "n": (("s", ""), ("ses", "s"), ("ves", "f"), ("xes", "x"), ("zes", "z"), ("ches", "ch"), ("shes", "sh"), ("men", "man"), ("ies", "y")),
    "v": (("s", ""), ("ies", "y"), ("es", "e"), ("es", ""), ("ed", "e"), ("ed", ""), ("ing", "e"), ("ing", "")),
    "a": (("er", ""), ("est", ""), ("er", "e"), ("est", "e")),
    "r": (),
}
# Some irregular forms with their class and lemma.
IRREGULAR = (
    ("am", "v", "be"), ("are", "v", "be"), ("is", "v", "be"), ("was", "v", "be"), ("were", "v", "be"), ("been", "v", "be"), ("has", "v", "have"), ("had", "v", "have"), ("did", "v", "do"), ("done", "v", "do"),
    ("went", "v", "go"), ("gone", "v", "go"), ("made", "v", "make"), ("said", "v", "say"), ("took", "v", "take"), ("bought", "v", "buy"), ("children", "n", "child"), ("feet", "n", "foot"), ("teeth", "n", "tooth"),
    ("mice", "n", "mouse"), ("men", "n", "man"), ("women", "n", "woman"), ("better", "a", "good"), ("best", "a", "good"), ("worse", "a", "bad"), ("worst", "a", "bad"), ("best", "r", "well"), ("better", "r", "well"),
)


def _shortened(forms: DataFrame) -> DataFrame:
    """forms (word, cls, form, path) with each ending that a form has taken off; path gains the rule's number."""
    form = F.col("form")
    one = lambda i, old, new: F.when(form.endswith(old), F.struct(F.concat(F.left(form, F.length(form) - len(old)), F.lit(new)).alias("form"), F.concat("path", F.lit(str(i))).alias("path")))
    found = F.lit(None).cast("array<struct<form:string,path:string>>")
    for cls, rules in DETACHED.items():
        if rules:
            found = F.when(F.col("cls") == cls, F.array_compact(F.array(*[one(i, old, new) for i, (old, new) in enumerate(rules)]))).otherwise(found)
    return forms.select("word", "cls", F.explode(found).alias("f")).select("word", "cls", "f.form", "f.path")


def _best(forms: DataFrame, has: DataFrame) -> DataFrame:
    """(word, cls, lemma): the shortest form that the dictionary has, of equally long ones the first."""
    known = forms.join(has, ["form", "cls"], "left_semi")
    return known.groupBy("word", "cls").agg(F.min_by("form", F.struct(F.length("form").alias("n"), "path")).alias("lemma"))


def lemmatized(words: DataFrame, dictionary: DataFrame, irregular: DataFrame | None = None) -> DataFrame:
    """(word, cls, lemma) for each pair of words (word, cls), cls being n, v, a or r.

    Where irregular (word, cls, lemma) has the word, its lemmas there and the word itself are candidates, else the word
    and what one ending less gives; while the dictionary (word, cls) has none of a word's candidates, another ending is
    taken off. The shortest that it has is the lemma, of equally long ones the first; a word without any, or of another
    class, stays as it is. Each round is a join over the words that are left; few are after the first.
    """
    pairs = written(words.select("word", "cls").distinct(), "lemma-words")
    has = written(dictionary.select(F.col("word").alias("form"), "cls").distinct(), "lemma-dictionary")
    regular = pairs.filter(F.col("word").isNotNull() & F.col("cls").isin(*DETACHED))
    itself = lambda df: df.select("word", "cls", F.col("word").alias("form"), F.lit("").alias("path"))
    done = []
    if irregular is not None:
        odd = irregular.groupBy("word", "cls").agg(F.sort_array(F.collect_set("lemma")).alias("lemmas"))
        known = regular.join(odd, ["word", "cls"]).select("word", "cls", F.posexplode("lemmas").alias("i", "form")).select("word", "cls", "form", F.lpad(F.col("i").cast("string"), 3, "0").alias("path"))
        done.append(written(_best(itself(regular.join(odd, ["word", "cls"], "left_semi")).unionByName(known), has), "lemma-round"))
        regular = regular.join(odd, ["word", "cls"], "left_anti")
    forms = _shortened(itself(regular))
    done.append(written(_best(itself(regular).unionByName(forms), has), "lemma-round"))
    while True:
        forms = written(_shortened(forms.join(done[-1], ["word", "cls"], "left_anti")), "lemma-forms")
        if forms.isEmpty():
            break
        done.append(written(_best(forms, has), "lemma-round"))
    best = done[0]
    for d in done[1:]:
        best = best.unionByName(d)
    return pairs.join(best, ["word", "cls"], "left").select("word", "cls", F.coalesce("lemma", "word").alias("lemma"))


def lemma_tokens(tokens: DataFrame, lemmas: DataFrame, default: str | None = None) -> DataFrame:
    """tokens (word, cls, ...) with lemma_pos, as lemma_cls, from lemmas (word, cls, lemma). A token without a class is
    left out, or counts as of the class `default`."""
    known = tokens.filter("cls is not null") if default is None else tokens.withColumn("cls", F.coalesce("cls", F.lit(default)))
    return known.join(lemmas, ["word", "cls"]).withColumn("lemma_pos", F.concat_ws("_", "lemma", "cls")).drop("lemma")
