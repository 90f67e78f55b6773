"""Toxicity: boosted trees over dense features, with isotonic calibration."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import compact, texts, written
from .quality import labelled_sample

#: Most labelled rows to fit on; the rows with the smallest hash of doc_id are taken.
SAMPLE_ROWS = 20_000
#: Most words, and most word beginnings, in the lexicon learned from the sample.
LEXICON_TERMS = 2000
_STEMS = (4, 5, 6)
_TREES, _DEPTH = 30, 3
_MEMO_WORDS = 100_000

#: Insults and pronouns of address in the corpus's languages, a start for the learned lexicon.
INSULTS = (
    "idiot idiots moron morons stupid dumb loser losers pathetic worthless scum trash disgusting clown imbecile jerk "
    "idiote imbécile crétin abruti connard salaud débile ordure minable idioten trottel dummkopf arschloch abschaum "
    "widerlich dreckig versager estúpido estúpida imbécil basura asqueroso payaso inútil patético"
).split()
SECOND_PERSON = (
    "you your yours yourself youre u ur tu toi te ton ta tes vous votre vos du dich dir dein deine deinen ihr euch euer "
    "sie ihnen usted ustedes ti vosotros vuestro tú"
).split()
_LEET = str.maketrans("0134578@$!|*", "oieastbasiii")
_EDGE = re.compile(r"^[^\w@$]+|[^\w@$]+$")
_HIT, _STEM, _SEED, _PERSON, _CAPS, _MASKED, _UNMASKED, _SINGLE = (1 << i for i in range(8))
FEATURES = 16


class Features:
    """of(text): the dense features of a whole text under a lexicon of words and word beginnings."""

    def __init__(self, words: frozenset[str], stems: frozenset[str]):
        self.words, self.stems = words, stems
        self.seeds, self.persons = frozenset(INSULTS), frozenset(SECOND_PERSON)
        self._memo: dict[str, int] = {}

    def _flags(self, token: str) -> int:
        word = _EDGE.sub("", token)
        low = word.lower()
        flags = _HIT * (low in self.words) | _SEED * (low in self.seeds) | _PERSON * (low in self.persons)
        flags |= _STEM * any(low[:n] in self.stems for n in _STEMS if len(low) >= n)
        flags |= _CAPS * (len(word) > 1 and word.isupper()) | _SINGLE * (len(word) == 1 and word.isalpha())
        if low and not low.isalpha() and any(c.isalpha() for c in low):
            plain = low.translate(_LEET)
            bare = re.sub(r"[\W_]+", "", low)
            flags |= _MASKED * (plain.isalpha() or bare.isalpha())
            flags |= _UNMASKED * bool({plain, bare} & (self.words | self.seeds))
        return flags

    def of(self, text: str) -> list[float]:
        tokens = text.split()
        n = max(1, len(tokens))
        memo = self._memo
        if len(memo) > _MEMO_WORDS:
            memo.clear()
        for t in set(tokens).difference(memo):
            memo[t] = self._flags(t)
        f = np.fromiter(map(memo.__getitem__, tokens), np.uint8, len(tokens))
        share = lambda bit: float(np.count_nonzero(f & bit)) / n
        hits = np.flatnonzero(f & (_HIT | _SEED | _UNMASKED))
        persons = np.flatnonzero(f & _PERSON)
        at = np.searchsorted(persons, hits)
        gap = np.full(len(hits), 1 << 30)
        if len(persons):
            gap = np.minimum(np.abs(persons[np.minimum(at, len(persons) - 1)] - hits), np.abs(persons[np.maximum(at - 1, 0)] - hits))
        dense = int((np.searchsorted(hits, hits + 25) - np.arange(len(hits))).max(initial=0))
        singles = np.flatnonzero(f & _SINGLE)
        chars = max(1, len(text))
        return [
            math.log1p(len(tokens)),
            share(_HIT),
            math.log1p(len(hits)),
            share(_STEM),
            math.log1p(float(np.count_nonzero(f & _STEM))),
            share(_SEED | _UNMASKED),
            float(dense),
            float(np.count_nonzero(gap <= 5)) / n,
            share(_PERSON),
            share(_CAPS),
            text.count("!") / chars,
            text.count("?") / chars,
            sum(text.count(c) for c in "#$%&*@") / chars,
            share(_MASKED),
            share(_UNMASKED),
            float(np.count_nonzero(np.diff(singles) == 1)) / n,
        ]


def learned_lexicon(sample: DataFrame) -> tuple[frozenset[str], frozenset[str]]:
    """Words, and beginnings of words, that toxic sample documents have clearly more often: at most LEXICON_TERMS of either."""
    n1, n0 = sample.select(F.coalesce(F.sum("y"), F.lit(0)), F.count("*") - F.coalesce(F.sum("y"), F.lit(0))).first()
    if not n1 or not n0:
        return frozenset(), frozenset()
    words = F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"))
    word = sample.select("y", F.explode(words).alias("w")).filter("length(w) between 2 and 30")
    counts = word.groupBy("w").agg(F.sum("y").alias("c1"), F.sum(1 - F.col("y")).alias("c0"))
    smooth = lambda c, n: (F.col(c) + 0.5) / (n + 1.0)
    z = (F.log(smooth("c1", n1)) - F.log(smooth("c0", n0))) / F.sqrt(1 / (F.col("c1") + 0.5) + 1 / (F.col("c0") + 0.5))
    best = lambda df: [r["w"] for r in df.filter("c1 >= 4").withColumn("z", z).filter("z > 3.5").orderBy(F.desc("z"), "w").limit(LEXICON_TERMS).collect()]
    stem = sample.select("y", F.explode(F.array_distinct(F.flatten(F.transform(words, lambda w: F.array(*[F.when(F.length(w) >= n, F.substring(w, 1, n)) for n in _STEMS])))) ).alias("w"))
    stems = stem.filter("w is not null").groupBy("w").agg(F.sum("y").alias("c1"), F.sum(1 - F.col("y")).alias("c0"))
    return frozenset(best(counts)), frozenset(best(stems))


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    label_col: str = "toxic",
    use: str = "true",
    sample_rows: int = SAMPLE_ROWS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, score): the likelihood, 0 to 1, that a whole text has label 1.

    On at most sample_rows labelled rows for which the SQL condition `use` on doc_id holds, three parts are
    learned: a lexicon from half of them, boosted trees over the dense features from the other half but a fifth,
    and an isotonic calibration from that fifth. Every row is then featured where it is read. Only texts are features.

    Null and empty texts get the score of a text without words; with no labelled rows of both classes every score
    is the share of label 1 (0.0 without any); repeated rows get a row each; an empty table gives no rows; other
    input columns are ignored.
    """
    sample = written(labelled_sample(docs, labels, label_col, sample_rows, id_col, text_col, use), "toxicity-sample")
    share, kinds = sample.select(F.avg("y"), F.countDistinct("y")).first()
    part = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(10))
    src = texts(docs, id_col, text_col)
    fit_on = sample.filter(part >= 5)
    if kinds < 2 or fit_on.select("y").distinct().count() < 2:
        return src.select("doc_id", F.lit(float(share or 0.0)).alias("score"))
    words, stems = learned_lexicon(sample.filter(part < 5))

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        feats = Features(words, stems)  # goes with the task, and its memo with it
        for b in batches:
            text = b.column(b.schema.get_field_index("text"))
            kept = [c for n, c in zip(b.schema.names, b.columns, strict=True) if n != "text"]
            names = [n for n in b.schema.names if n != "text"]
            found = np.array([feats.of(t.as_py()) for t in text], np.float64).reshape(-1, FEATURES)
            column = pa.ListArray.from_arrays(pa.array(np.arange(0, found.size + 1, FEATURES, dtype=np.int32)), pa.array(found.ravel()))
            yield pa.RecordBatch.from_arrays([*kept, column], names=[*names, "f"])

    vector = array_to_vector("f").alias("features")
    known = compact(fit_on.select("doc_id", "y", "text").mapInArrow(featured, "doc_id long, y int, f array<double>"), "toxicity-features")
    trees = GBTClassifier(labelCol="y", maxIter=_TREES, maxDepth=_DEPTH, stepSize=0.2, seed=7, featuresCol="features", minInstancesPerNode=5)
    for_trees = known.filter(part < 9) if known.filter(part < 9).select("y").distinct().count() == 2 else known
    model = trees.fit(for_trees.select(F.col("y").cast("double").alias("y"), vector))
    raw = lambda df: model.transform(df).withColumn("p", vector_to_array("probability")[1])
    for_steps = known.filter(part == 9) if known.filter(part == 9).select("y").distinct().count() == 2 else known
    steps = IsotonicRegression(labelCol="y", featuresCol="p", predictionCol="calibrated").fit(
        raw(for_steps.select(F.col("y").cast("double").alias("y"), vector)).select("y", "p")
    )
    rows = src.mapInArrow(featured, "doc_id long, f array<double>")
    calibrated = steps.transform(raw(rows.select("doc_id", vector)).select("doc_id", "p"))
    # the trees' own order is kept within a step of the calibration
    return calibrated.select("doc_id", (0.98 * F.col("calibrated") + 0.02 * F.col("p")).alias("score"))
