"""Quality classifier: naive Bayes support vectors."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts
from .words import mixed, shape_hashes, word_hashes

#: Features are hashed to so many columns, so the model has a fixed size.
COLUMNS = 1 << 18
#: Most labelled rows to fit on; the rows with the smallest hash of doc_id are taken.
SAMPLE_ROWS = 20_000
_EPOCHS, _C = 8, 1.0


def indicators(text: str) -> np.ndarray:
    """Sorted distinct columns of a text's n-grams: words (1, 2), word shapes (1 to 3), and runs of one word."""
    words, shapes = word_hashes(text), shape_hashes(text)
    same = words[1:] == words[:-1]
    kinds = [words, words[:-1] * np.uint64(3) + words[1:], shapes + np.uint64(1)]
    kinds += [shapes[:-1] * np.uint64(5) + shapes[1:], shapes[:-2] * np.uint64(7) + shapes[1:-1] * np.uint64(11) + shapes[2:]]
    kinds += [same[:1].astype(np.uint64) + np.uint64(17), (same[1:] & same[:-1]).astype(np.uint64) + np.uint64(29)]
    found = [np.unique(mixed(k + np.uint64(i << 40)) % np.uint64(COLUMNS)) for i, k in enumerate(kinds)]
    return np.unique(np.concatenate(found)).astype(np.uint32)


def fit(rows: list[np.ndarray], y: np.ndarray, calibrate: np.ndarray, seed: int = 7) -> np.ndarray:
    """Weights by column, then bias and the two calibration numbers.

    Log-count ratios scale the indicators; a hinge-loss SVM is fitted by dual coordinate descent on the rows that
    aren't for calibration, and a logistic curve over its margins on those that are.
    """
    train = np.flatnonzero(~calibrate)
    counts = np.ones((2, COLUMNS))
    for i in train:
        counts[y[i], rows[i]] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    norm = np.array([max(1e-9, float(np.sqrt((ratio[r] ** 2).sum()))) for r in rows])
    sign = np.where(y == 1, 1.0, -1.0)
    most = _C * np.where(y == 1, 1.0, max(1.0, (y[train] == 1).sum() / max(1, (y[train] == 0).sum())))
    w, bias, alpha = np.zeros(COLUMNS), 0.0, np.zeros(len(rows))
    rng = np.random.default_rng(seed)
    for _ in range(_EPOCHS):
        for i in rng.permutation(train):
            r = rows[i]
            x = ratio[r] / norm[i]
            slack = sign[i] * (w[r] @ x + bias) - 1
            new = min(max(alpha[i] - slack / 2.0, 0.0), most[i])  # a row's squared length is 1, and 1 for the bias
            if new != alpha[i]:
                step = (new - alpha[i]) * sign[i]
                w[r] += step * x
                bias += step
                alpha[i] = new
    held = np.flatnonzero(calibrate) if calibrate.any() else train
    margin = np.array([w[rows[i]] @ ratio[rows[i]] / norm[i] + bias for i in held])
    a, b = 1.0, 0.0
    target = np.where(y[held] == 1, 1 - 1 / (2 + (y[held] == 1).sum()), 1 / (2 + (y[held] == 0).sum()))
    for _ in range(50):  # Newton steps of the logistic fit
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g = np.array([((p - target) * margin).sum() + 1e-3 * (a - 1), (p - target).sum() + 1e-3 * b])
        h = p * (1 - p) + 1e-9
        hess = np.array([[(h * margin**2).sum() + 1e-3, (h * margin).sum()], [(h * margin).sum(), h.sum() + 1e-3]])
        d = np.linalg.solve(hess, g)
        a, b = a - d[0], b - d[1]
    return np.r_[w, ratio, bias, a, b]


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, rows: int, id_col: str, text_col: str, use: str) -> DataFrame:
    """(doc_id, text, y): at most `rows` labelled documents, those with the smallest hash of doc_id, where `use` holds."""
    known = (
        labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y"))
        .filter("y in (0, 1) and doc_id is not null")
        .filter(use)
        .orderBy(F.xxhash64("doc_id"), "doc_id", "y")
        .limit(rows)
    )
    return texts(docs, id_col, text_col).join(F.broadcast(known), "doc_id")


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    label_col: str = "quality",
    use: str = "true",
    sample_rows: int = SAMPLE_ROWS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, score): the likelihood, 0 to 1, that a whole text has label 1.

    Fitted on at most sample_rows labelled rows for which the SQL condition `use` on doc_id holds; a fifth of them
    calibrates. The sample is fitted in one task, its model of fixed size is broadcast, and every row is scored
    where it is read. Only texts are features.

    Null and empty texts get the score of a text without n-grams; with no labelled rows of both classes every
    score is the share of label 1 (0.5 without any); repeated rows get a row each; an empty table gives no rows;
    other input columns are ignored.
    """
    sample = labelled_sample(docs, labels, label_col, sample_rows, id_col, text_col, use)

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [indicators(t.as_py()).tobytes() for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(found, pa.binary())], names=["doc_id", "y", "columns"])

    def fitted(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "y", "columns"])
        y = pdf["y"].to_numpy()
        if len(set(y)) < 2:
            return pd.DataFrame({"share": [float(y.mean())], "model": [b""]})
        rows = [np.frombuffer(c, np.uint32) for c in pdf["columns"]]
        out = io.BytesIO()
        np.save(out, fit(rows, y, pdf["doc_id"].to_numpy() % 5 == 0).astype(np.float32))
        return pd.DataFrame({"share": [float(y.mean())], "model": [out.getvalue()]})

    features = sample.select("doc_id", "text", "y").mapInArrow(featured, "doc_id long, y int, columns binary").withColumn("one", F.lit("all"))
    got = features.groupBy("one").applyInPandas(fitted, "share double, model binary").collect()
    share, model = (got[0]["share"], bytes(got[0]["model"])) if got else (0.5, b"")
    held = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if held.value:
            m = np.load(io.BytesIO(held.value))
            w, ratio, (bias, a, b0) = m[:COLUMNS], m[COLUMNS : 2 * COLUMNS], m[2 * COLUMNS :]
            wr, r2 = w * ratio, ratio**2
        for b in batches:
            if held.value:
                rows = [indicators(t.as_py()) for t in b.column(1)]
                margin = np.array([wr[r].sum() / max(1e-9, np.sqrt(r2[r].sum())) + bias for r in rows], np.float64)
                score = 1 / (1 + np.exp(-np.clip(a * margin + b0, -30, 30)))
            else:
                score = np.full(b.num_rows, share)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score, pa.float64())], names=["doc_id", "score"])

    return texts(docs, id_col, text_col).mapInArrow(scored, "doc_id long, score double")
