"""Linear support vector machines over prefixes of ranked terms, by stratified cross-validation: all models at once.

A model is one ranking, number of terms and fold. The weights of all models of a ranking are the columns of one matrix,
in whose rows the terms stand in rank order; a model of k terms has zeros below row k. A step is one job: tasks multiply
blocks of documents with the matrices and sum losses and gradients, which are added up by slices of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .places import placed
from .shared import written

#: Width of the part of the hinge that is rounded off, so that it has a gradient everywhere.
ROUNDED = 0.1
#: Steps and gradients that L-BFGS remembers of each model.
HISTORY = 5
#: Documents a block; slices of a gradient.
_BLOCK, _SLICES = 512, 8
#: Groups of models of similar depth that are multiplied at a time; tasks a core that sum a step.
_GROUPS, _TASKS = 8, 2
#: Rows of the table of ranked terms that is broadcast.
MOST_TERMS = 1_000_000


def folds(labels: DataFrame, k: int) -> DataFrame:
    """labels (doc_id, cls) with fold: each class dealt out evenly in the order of a hash."""
    dealt = placed(labels, [F.md5(F.col("doc_id").cast("string")), F.col("doc_id")], ["cls"])
    return dealt.withColumn("fold", (F.col("place") % k).cast("int")).drop("place")


def prefix_rows(weights: DataFrame, rankings: list[DataFrame], labels: DataFrame, most: int) -> DataFrame:
    """labels (doc_id, cls, fold) with `terms`: for each ranking its first `most` terms in the document, as (place from
    0, weight) in rank order; none where the document has none of them."""
    if len(rankings) * most > MOST_TERMS:
        raise ValueError(f"at most {MOST_TERMS} ranked terms")
    ranked = rankings[0].select("term", F.lit(0).alias("ranking"), "rank")
    for i, r in enumerate(rankings[1:], 1):
        ranked = ranked.unionByName(r.select("term", F.lit(i).alias("ranking"), "rank"))
    first = ranked.filter(F.col("rank") <= most).select("term", "ranking", (F.col("rank") - 1).cast("int").alias("i"))
    held = weights.join(F.broadcast(first), "term").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ranking", "i", "w"))).alias("all"))
    own = lambda n: F.transform(F.filter("all", lambda x: x["ranking"] == n), lambda x: F.struct(x["i"].alias("i"), x["w"].alias("w")))
    none = F.array().cast("array<struct<i:int,w:double>>")
    terms = F.array(*[F.coalesce(own(n), none) for n in range(len(rankings))])
    return labels.join(held, "doc_id", "left").select("doc_id", F.col("cls").cast("int").alias("cls"), "fold", terms.alias("terms"))


def _blocks(rows: DataFrame, n_rankings: int) -> DataFrame:
    """(n, cls, fold, starts, places, values): blocks of documents as sparse rows, one ranking after the other."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, _BLOCK):
                part = b.slice(at, _BLOCK)
                lists = part.column("terms").flatten()  # a list for each document and ranking
                pairs = lists.flatten()
                sizes = np.diff(lists.offsets.to_numpy()).reshape(-1, n_rankings)
                owner = np.tile(np.arange(n_rankings), len(sizes)).repeat(sizes.ravel())
                order = np.argsort(owner, kind="stable")
                places, values = (pairs.field(c).to_numpy(zero_copy_only=False)[order] for c in ("i", "w"))
                cells = [part.column("cls").to_numpy().astype(np.int8), part.column("fold").to_numpy().astype(np.int16), sizes.T.astype(np.int32), places.astype(np.int32), values.astype(np.float32)]
                yield pa.RecordBatch.from_pydict({"n": pa.array([part.num_rows], pa.int32()), **{name: [c.tobytes()] for name, c in zip(("cls", "fold", "sizes", "places", "vals"), cells, strict=True)}})

    return rows.select("cls", "fold", "terms").mapInArrow(pack, "n int, cls binary, fold binary, sizes binary, places binary, vals binary")


def _opened(b: pa.RecordBatch, n_rankings: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]:
    """(classes as -1 and 1, folds, a dense matrix for each ranking, its last column ones) of each block."""
    for r in b.to_pylist():
        sizes = np.frombuffer(r["sizes"], np.int32).reshape(n_rankings, r["n"])
        places, values = np.frombuffer(r["places"], np.int32), np.frombuffer(r["vals"], np.float32)
        x, at = [], 0
        for own in sizes:
            dense = np.zeros((r["n"], most + 1), np.float32)
            dense[:, most] = 1
            n = int(own.sum())
            dense[np.arange(r["n"]).repeat(own), places[at : at + n]] = values[at : at + n]
            at += n
            x.append(dense)
        yield np.where(np.frombuffer(r["cls"], np.int8) == 1, 1.0, -1.0).astype(np.float32), np.frombuffer(r["fold"], np.int16), x


def hinge(margin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """max(0, 1 - margin), rounded off over the last ROUNDED before 1, and its derivative."""
    short = 1 - margin
    near = np.clip(short / ROUNDED, 0, 1)
    return np.where(short > ROUNDED, short - ROUNDED / 2, near * near * (ROUNDED / 2)), -near


def _grouped(depths: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """Columns of models of similar depth, and the largest depth of each group."""
    return [(cols, int(depths[cols].max())) for cols in np.array_split(np.argsort(depths, kind="stable"), _GROUPS) if len(cols)]


def summed(blocks: DataFrame, models: list[np.ndarray], held_out: list[np.ndarray], depths: list[np.ndarray] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """(losses, gradients) of each ranking's models over the documents that are not in a model's held-out fold: one job.

    models are matrices of (terms + 1) rows, the last one the intercepts. Each task sends one sum of each slice of rows,
    and those are added up by slice. A sum is as large for few documents as for many, so there are as many tasks as cores
    can take, however many parts the documents have. depths are the terms that each model has, if not all: rows from
    there on are not multiplied, and gradients there may be zero.
    """
    spark, most = blocks.sparkSession, models[0].shape[0] - 1
    shapes = [(m.shape[0] + 1, m.shape[1]) for m in models]
    groups = [_grouped(np.full(m.shape[1], most) if depths is None else depths[i]) for i, m in enumerate(models)]
    sent = spark.sparkContext.broadcast(([m.astype(np.float32) for m in models], held_out))
    cut = lambda rows: np.linspace(0, rows, _SLICES + 1).astype(int)
    schema = "ranking int, slice int, sums binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, out_of = sent.value
        total = [np.zeros(s) for s in shapes]
        for b in batches:
            for y, fold, xs in _opened(b, len(weights), most):
                for own, x, w, out, alike in zip(total, xs, weights, out_of, groups, strict=True):
                    for cols, deep in alike:
                        terms = x[:, :deep]
                        loss, slope = hinge(y[:, None] * (terms @ w[:deep, cols] + w[-1, cols]))
                        train = fold[:, None] != out[None, cols]
                        own[-1, cols] += (loss * train).sum(axis=0, dtype=np.float64)
                        pull = slope * train * y[:, None]
                        own[:deep, cols] += terms.T @ pull
                        own[-2, cols] += pull.sum(axis=0, dtype=np.float64)
        rows = [(r, s, own[a:z].tobytes()) for r, own in enumerate(total) for s, (a, z) in enumerate(zip(cut(len(own))[:-1], cut(len(own))[1:], strict=True))]
        ranking, part, sums = zip(*rows, strict=True)
        yield pa.RecordBatch.from_pydict({"ranking": pa.array(ranking, pa.int32()), "slice": pa.array(part, pa.int32()), "sums": pa.array(sums, pa.binary())})

    def add(group: pa.Table) -> pa.Table:
        sums = sum(np.frombuffer(x) for x in group.column("sums").to_pylist())
        return group.slice(0, 1).set_column(2, "sums", pa.array([sums.tobytes()], pa.binary()))

    found = {(r["ranking"], r["slice"]): np.frombuffer(r["sums"]) for r in blocks.coalesce(_TASKS * spark.sparkContext.defaultParallelism).mapInArrow(run, schema).groupBy("ranking", "slice").applyInArrow(add, schema).collect()}
    sent.destroy()
    whole = [np.concatenate([found.get((i, s), np.zeros(0)) for s in range(_SLICES)]).reshape(shape) if found else np.zeros(shape) for i, shape in enumerate(shapes)]
    return [(m[-1], m[:-1]) for m in whole]


class _Descent:
    """L-BFGS over the columns of a matrix, each with its own step; all move with one evaluation."""

    def __init__(self, free: np.ndarray, c: float, tolerance: float):
        self.free, self.c, self.tolerance = free, c, tolerance
        self.w = np.zeros(free.shape)
        self.trial, self.value, self.slope, self.way = self.w, None, None, None
        self.step, self.open = np.ones(free.shape[1]), np.ones(free.shape[1], bool)
        self.past: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.scale = np.ones(free.shape[1])

    def objective(self, losses: np.ndarray, gradients: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Half the squared weights, without the intercept, and C times the losses, with its gradient."""
        ridge = self.trial.copy()
        ridge[-1] = 0
        return (ridge**2).sum(axis=0) / 2 + self.c * losses, (ridge + self.c * gradients) * self.free

    def _direction(self) -> np.ndarray:
        q, kept = self.slope.copy(), []
        for s, y, rho in reversed(self.past):
            a = rho * (s * q).sum(axis=0)
            q -= a * y
            kept.append(a)
        q *= self.scale
        for (s, y, rho), a in zip(self.past, reversed(kept), strict=True):
            q += s * (a - rho * (y * q).sum(axis=0))
        downhill = (q * self.slope).sum(axis=0) > 0
        return -np.where(downhill, q, self.slope)

    def moved(self, losses: np.ndarray, gradients: np.ndarray) -> None:
        """Takes the trial where it lowers the objective enough, else halves its step."""
        value, slope = self.objective(losses, gradients)
        if self.value is None:
            self.value, self.slope, self.start = value, slope, np.linalg.norm(slope, axis=0)
            self.step = 1 / np.maximum(1, self.start)
            self.way = -slope
        else:
            fine = self.open & (value <= self.value + 1e-4 * self.step * (self.slope * self.way).sum(axis=0))
            s, y = np.where(fine, self.trial - self.w, 0), np.where(fine, slope - self.slope, 0)
            sy = (s * y).sum(axis=0)
            curved = sy > 1e-12
            self.past = [*self.past, (s, y, np.where(curved, 1 / np.where(curved, sy, 1), 0))][-HISTORY:]
            self.scale = np.where(curved, sy / np.where(curved, (y * y).sum(axis=0), 1), self.scale)
            self.w, self.value, self.slope = np.where(fine, self.trial, self.w), np.where(fine, value, self.value), np.where(fine, slope, self.slope)
            self.way = np.where(fine, self._direction(), self.way)
            self.step = np.where(fine, 1, self.step / 2)
        self.open &= (np.linalg.norm(self.slope, axis=0) > self.tolerance * np.maximum(1, self.start)) & (self.step > 1e-6)
        self.trial = np.where(self.open, self.w + self.step * self.way, self.w)


def fitted(sums: Callable[[list[np.ndarray], list[np.ndarray]], list[tuple[np.ndarray, np.ndarray]]], free: list[np.ndarray], held_out: list[np.ndarray], c: float, max_iter: int, tolerance: float) -> list[np.ndarray]:
    """The matrices that minimise each model's objective; sums(matrices, held_out) gives losses and gradients. Models
    that have settled are left out of the next evaluations."""
    found = [_Descent(f, c, tolerance) for f in free]
    for _ in range(max_iter):
        which = [np.flatnonzero(d.open) for d in found]
        if not any(len(w) for w in which):
            break
        got = sums([d.trial[:, w] for d, w in zip(found, which, strict=True)], [h[w] for h, w in zip(held_out, which, strict=True)])
        for d, w, (losses, gradients) in zip(found, which, got, strict=True):
            whole, slopes = np.zeros(d.w.shape[1]), np.zeros(d.w.shape)
            whole[w], slopes[:, w] = losses, gradients
            d.moved(whole, slopes)
    return [d.w for d in found]


def _margins(spark: SparkSession, blocks: DataFrame, models: list[np.ndarray], held_out: list[np.ndarray], ks: list[int]) -> DataFrame:
    """(ranking, k, fold, cls, margin): each document under the models that were fitted without its fold."""
    most = models[0].shape[0] - 1
    sent = spark.sparkContext.broadcast(([m.astype(np.float32) for m in models], held_out))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, out_of = sent.value
        for b in batches:
            for y, fold, xs in _opened(b, len(weights), most):
                for i, (x, w, out) in enumerate(zip(xs, weights, out_of, strict=True)):
                    at, model = np.nonzero(fold[:, None] == out[None, :])
                    margin = (x @ w)[at, model].astype(np.float64)
                    yield pa.RecordBatch.from_pydict({
                        "ranking": pa.array(np.full(len(at), i, np.int32)), "k": pa.array(np.array(ks, np.int32)[model % len(ks)]), "fold": pa.array(out[model].astype(np.int32)),
                        "cls": pa.array((y[at] > 0).astype(np.int32)), "margin": pa.array(margin),
                    })

    return written(blocks.mapInArrow(run, "ranking int, k int, fold int, cls int, margin double"), "model-margins")


def fold_scores(margins: DataFrame) -> DataFrame:
    """(ranking, k, fold, accuracy, balanced_accuracy, roc_auc) of rows (ranking, k, fold, cls, margin): a margin above 0
    says class 1. roc_auc is null where a fold has one class only; balanced_accuracy is then that class's.

    Documents of equal margins are counted together; the negatives below a margin are those of the ranges of margins
    before its own and those before it in its range.
    """
    model = ["ranking", "k", "fold"]
    hit = ((F.col("margin") > 0).cast("int") == F.col("cls")).cast("double")
    plain = margins.groupBy(*model).agg(F.avg(hit).alias("accuracy"), F.avg(F.when(F.col("cls") == 1, hit)).alias("_p"), F.avg(F.when(F.col("cls") == 0, hit)).alias("_n"))
    counts = margins.groupBy(*model, "margin").agg(F.sum("cls").alias("pos"), F.count_if(F.col("cls") == 0).alias("neg"))
    ranged = counts.withColumn("range", F.floor(F.greatest(F.least(F.col("margin"), F.lit(64.0)), F.lit(-64.0)) * 256).cast("int"))
    sizes = ranged.groupBy(*model, "range").agg(F.sum("neg").alias("n"))
    earlier = F.coalesce(F.sum("n").over(W.partitionBy(*model).orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    own = F.coalesce(F.sum("neg").over(W.partitionBy(*model, "range").orderBy("margin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    below = ranged.withColumn("own", own).join(sizes.withColumn("earlier", earlier).drop("n"), [*model, "range"])
    wins = F.sum(F.col("pos") * (F.col("earlier") + F.col("own") + F.col("neg") / 2))
    auc = below.groupBy(*model).agg((wins / F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0))).alias("roc_auc"))
    balanced = F.coalesce((F.col("_p") + F.col("_n")) / 2, "_p", "_n")
    return plain.join(auc, model).select(*model, "accuracy", balanced.alias("balanced_accuracy"), "roc_auc")


def cross_validated(
    weights: DataFrame, rankings: dict[str, DataFrame], labels: DataFrame, ks: list[int], n_folds: int = 10, c: float = 1.0, max_iter: int = 100, tolerance: float = 1e-3
) -> DataFrame:
    """(ranking, k, accuracy, balanced_accuracy, roc_auc): means over the folds for each ranking and number of terms.

    weights are (doc_id, term, w), each ranking (term, rank), labels (doc_id, cls) with cls 1 or 0. Each model minimises
    half its squared weights plus c times its hinge losses, the intercept free, as the usual machine does, but for the
    hinge's rounded edge (ROUNDED). Models stop at a gradient of tolerance times their first one, or after max_iter
    evaluations. The driver holds the weights of all models and HISTORY earlier steps: their number is bounded by ks,
    folds and rankings. A document that has none of the terms is scored by the intercept.
    """
    spark, most, names = labels.sparkSession, max(ks), list(rankings)
    dealt = written(folds(labels, n_folds), "model-folds")
    rows = written(prefix_rows(weights, list(rankings.values()), dealt, most), "model-rows")
    blocks = _blocks(rows, len(names)).persist()
    held_out = [np.repeat(np.arange(n_folds), len(ks))] * len(names)  # a fold's models stand side by side, in the order of ks
    mask = np.tile(np.array(ks), n_folds)[None, :] > np.arange(most + 1)[:, None]
    mask[-1] = True
    told = [np.stack([h, np.tile(np.array(ks), n_folds)], axis=1) for h in held_out]  # fold and depth of each model
    models = fitted(lambda m, h: summed(blocks, m, [x[:, 0] for x in h], [x[:, 1] for x in h]), [mask.astype(float)] * len(names), told, c, max_iter, tolerance)
    margins = _margins(spark, blocks, models, held_out, ks)
    blocks.unpersist()
    means = fold_scores(margins).groupBy("ranking", "k").agg(*[F.avg(x).alias(x) for x in ("accuracy", "balanced_accuracy", "roc_auc")])
    named = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("ranking") + 1)
    return means.withColumn("ranking", named)
