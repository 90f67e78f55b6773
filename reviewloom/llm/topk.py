"""Exact top-k inner products by multi-resolution segment statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import written

SCALE = 1024
BLOCK_QUERIES = 256
#: Bytes of the vectors in a chunk, four to a component.
CHUNK_BYTES = 1 << 19
#: Segments a vector at each resolution, coarse to fine.
RESOLUTIONS = (1, 4, 16)
#: A task compares about this many blocks of queries with as many chunks as this.
TILE_BLOCKS, TILE_CHUNKS = 16, 32
#: The floor of a query that has too few neighbours to know one.
_NONE = np.iinfo(np.int64).min
_CHUNK = "dim int, chunk long, ids binary, x binary, stats binary, asked array<long>, floors array<long>"


def _segments(x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Means and deviations of n segments, both times the root of the segment's length."""
    edges = np.linspace(0, x.shape[1], min(n, x.shape[1]) + 1).astype(int)[:-1]
    width = np.diff(np.r_[edges, x.shape[1]])
    mean = np.add.reduceat(x, edges, axis=1) / width
    spread = np.add.reduceat((x - np.repeat(mean, width, axis=1)) ** 2, edges, axis=1)
    return mean * np.sqrt(width), np.sqrt(spread)


def _exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products; in floating point only where every partial sum is exact."""
    most = q.shape[1] * float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0))
    if most < 2.0**53:
        return (q.astype(np.float64) @ x.T.astype(np.float64)).astype(np.int64)
    return np.einsum("qd,xd->qx", q, x)


class _Best:
    """The k best candidates so far of each query of a block, ties to the smaller identifier. floors are scores that
    k candidates of a query are known to reach."""

    def __init__(self, query_ids: np.ndarray, q: np.ndarray, floors: np.ndarray, k: int):
        self.query_ids, self.q, self.k = query_ids, q, k
        self.at = [_segments(q.astype(np.float64), n) for n in RESOLUTIONS]
        self.least = floors.copy()
        self.ids = [np.array([], np.int64) for _ in query_ids]
        self.scores = [np.array([], np.int64) for _ in query_ids]

    def add(self, i: int, ids: np.ndarray, scores: np.ndarray) -> None:
        ids, scores = np.r_[self.ids[i], ids], np.r_[self.scores[i], scores]
        best = np.lexsort((ids, -scores))[: self.k]
        self.ids[i], self.scores[i] = ids[best], scores[best]
        if len(best) == self.k:
            self.least[i] = max(self.least[i], scores[best[-1]])

    def search(self, ids: np.ndarray, x: np.ndarray) -> None:
        xf = x.astype(np.float64)
        alive = ids[None, :] != self.query_ids[:, None]
        for (qm, qs), n in zip(self.at, RESOLUTIONS, strict=True):
            xm, xs = _segments(xf, n)
            # Cauchy-Schwarz in each segment: no inner product is above this
            bound = qm @ xm.T + qs @ xs.T
            bound += 1e-9 * (1 + np.abs(qm) @ np.abs(xm).T + qs @ xs.T)
            alive &= bound >= self.least[:, None]
        asking, wanted = np.flatnonzero(alive.any(axis=1)), np.flatnonzero(alive.any(axis=0))
        if len(wanted):
            scores = _exact(self.q[asking], x[wanted])
            good = alive[np.ix_(asking, wanted)] & (scores >= self.least[asking, None])
            for i, at, own in zip(asking, good, scores, strict=True):
                if at.any():
                    self.add(i, ids[wanted[at]], own[at])


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the signs of the sums of a vector's sixteenths, as text: vectors that are alike are near in this order."""
    for b in batches:
        dims = b.column(1).to_numpy()
        for d in np.unique(dims).tolist():
            same = b.filter(pa.array(dims == d))
            x = same.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, d).astype(np.float64)
            signs = np.where(_segments(x, max(RESOLUTIONS))[0] > 0, b"1", b"0")
            near = [row.tobytes().decode() for row in signs]
            yield pa.RecordBatch.from_arrays([*same.columns, pa.array(near, pa.string())], [*same.schema.names, "near"])


def _pieces(batches: Iterator[pa.RecordBatch], rows: int, most: int) -> Iterator[tuple[int, int, pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(dim, number, rows, ids, vectors): the batches cut into pieces of one length of vector, of at most `rows` rows
    and `most` bytes of vectors; numbers differ over all tasks."""
    number = TaskContext.get().partitionId() << 32
    for b in batches:
        dims = b.column(1).to_numpy()
        for d in np.unique(dims).tolist():
            same = b.filter(pa.array(dims == d))
            step = max(1, min(rows, most // (4 * d)))
            for at in range(0, same.num_rows, step):
                piece = same.slice(at, step)
                yield d, number, piece, piece.column(0).to_numpy(zero_copy_only=False), piece.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
                number += 1


def _packed(x: np.ndarray) -> bytes:
    """Vectors as 32-bit integers where they fit."""
    return (x.astype(np.int32) if np.abs(x).max(initial=0) < 2**31 else x).tobytes()


def _unpacked(ids: bytes, x: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(ids, np.int64)
    return ids, np.frombuffer(x, np.int32 if len(x) == 4 * dim * len(ids) else np.int64).astype(np.int64).reshape(-1, dim)


def _row(dim: int, number: int, ids: np.ndarray, x: np.ndarray, stats: bytes, asked: list, floors: list) -> pa.RecordBatch:
    columns = {"dim": pa.array([dim], pa.int32()), "chunk": pa.array([number], pa.int64()), "ids": [ids.tobytes()], "x": [_packed(x)], "stats": [stats]}
    return pa.RecordBatch.from_pydict(columns | {c: pa.array([v], pa.list_(pa.int64())) for c, v in (("asked", asked), ("floors", floors))})


def _chunks(k: int, every: int, most: int):
    """Cuts candidates into chunks with, at each resolution, the least and greatest means and the greatest deviations
    of their segments, and, for the queries among them, the k-th best score within the chunk."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, number, _, ids, x in _pieces(batches, most, most):
            levels = [_segments(x.astype(np.float64), n) for n in RESOLUTIONS]
            stats = np.concatenate([np.r_[m.min(axis=0), m.max(axis=0), s.max(axis=0)] for m, s in levels])
            asked = np.flatnonzero(ids % every == 0)
            scores = np.where(ids[None, :] == ids[asked, None], _NONE, _exact(x[asked], x))
            floors = np.partition(scores, -k, axis=1)[:, -k] if len(ids) >= k else np.full(len(asked), _NONE)
            yield _row(dim, number, ids, x, stats.tobytes(), ids[asked].tolist(), floors.tolist())

    return cut


def _blocks(most: int):
    """Cuts queries with their floors into blocks."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, number, piece, ids, x in _pieces(batches, BLOCK_QUERIES, most):
            yield _row(dim, number, ids, x, b"", [], piece.column(3).to_pylist())

    return cut


def _bounded(blocks: pd.DataFrame, chunks: pd.DataFrame) -> pd.DataFrame:
    """(dim, gb, gc, chunk, blocks): for each chunk of a tile, the blocks with a query whose floor is not above the
    bound over all of the chunk, at any resolution."""
    kept: dict[int, list[int]] = {}
    stats = np.array([np.frombuffer(s) for s in chunks["stats"]]) if len(chunks) else None
    for b in blocks.itertuples() if len(chunks) else ():
        _, q = _unpacked(b.ids, b.x, b.dim)
        floors, alive, at = np.asarray(b.floors)[:, None], np.ones((len(q), len(chunks)), bool), 0
        for n in RESOLUTIONS:
            qm, qs = _segments(q.astype(np.float64), n)
            low, high, spread = np.split(stats[:, at : (at := at + 3 * qm.shape[1])], 3, axis=1)
            bound = np.maximum(qm, 0) @ high.T + np.minimum(qm, 0) @ low.T + qs @ spread.T
            bound += 1e-9 * (1 + np.abs(qm) @ np.maximum(np.abs(low), np.abs(high)).T + qs @ spread.T)
            alive &= bound >= floors
        for c in chunks["chunk"].to_numpy()[alive.any(axis=0)].tolist():
            kept.setdefault(c, []).append(b.block)
    tile = [chunks[c].iloc[0] if len(chunks) else 0 for c in ("dim", "gb", "gc")]
    return pd.DataFrame([(*tile, c, b) for c, b in kept.items()], columns=["dim", "gb", "gc", "chunk", "blocks"])


def top_k(
    vectors: DataFrame,
    k: int = 10,
    every: int = 100,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    chunk_bytes: int = CHUNK_BYTES,
    tile_blocks: int = TILE_BLOCKS,
    tile_chunks: int = TILE_CHUNKS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by `every`, its k best among all other rows.

    Components count as floor(1024 * x); the score is the integer inner product, ties go to the smaller id.
    Vectors are sorted so that like ones are near and cut into chunks, queries into blocks of at most 256. A query's
    floor is its k-th best score within its own chunk. The ranges of a chunk's segment means and its greatest
    deviations, at 1, then 4, then 16 segments, bound every score in it from above (so they bound the distance from
    below); only chunks that reach the floor of some query of a block are sent to it, about 16 blocks and 32 chunks
    to a task. There each vector's own means and deviations are held against the same floors, which rise on the way,
    and exact scores are computed for the survivors only. A k-row list for each query and task is then merged.

    Rows with a null id or vector, or null or non-finite components, take no part; vectors of different lengths are not
    compared; several rows with one id are never each other's candidates, are candidates of other queries each,
    and are one query, with the largest of their vectors. An empty table gives no rows; components are below 2**26
    in size after scaling; other columns are ignored.
    """
    vec = F.col(vector_col).cast("array<double>")
    clean = vectors.select(F.col(id_col).cast("long").alias("vec_id"), vec.alias("v")).filter(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    )
    whole = clean.select("vec_id", F.size("v").alias("dim"), F.transform("v", lambda x: F.floor(x * SCALE).cast("long")).alias("v")).filter("dim > 0")

    def near(rows: DataFrame) -> DataFrame:
        # by place of reading too, so that repeated rows don't all go to one task
        order = ("dim", "near", "vec_id", "read")
        signed = rows.mapInArrow(_signed, "vec_id long, dim int, v array<long>" + ", floor long" * ("floor" in rows.columns) + ", near string")
        return signed.withColumn("read", F.spark_partition_id()).repartitionByRange(*order).sortWithinPartitions(*order)

    chunks = written(near(whole).select("vec_id", "dim", "v").mapInArrow(_chunks(k, every, chunk_bytes), _CHUNK), "topk-chunks")
    # of an id's several rows the least floor holds for whichever is the query
    floors = chunks.select(F.explode(F.arrays_zip("asked", "floors")).alias("f")).groupBy("f.asked").agg(F.min("f.floors").alias("floor"))
    asked = whole.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.max(F.struct("dim", "v")).alias("q")).select("vec_id", "q.*")
    floored = asked.join(floors, F.col("vec_id") == F.col("asked")).drop("asked")
    blocks = written(near(floored).select("vec_id", "dim", "v", "floor").mapInArrow(_blocks(chunk_bytes), _CHUNK), "topk-blocks")
    of_blocks, of_chunks = 1 + blocks.count() // tile_blocks, 1 + chunks.count() // tile_chunks

    group = lambda n: F.pmod(F.xxhash64("chunk"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asking = blocks.select("dim", group(of_blocks).alias("gb"), F.col("chunk").alias("block"), "ids", "x", "floors")
    stats = chunks.select("dim", group(of_chunks).alias("gc"), "chunk", "stats", each(of_blocks).alias("gb"))
    tile = ("dim", "gb", "gc")
    pairs = written(
        asking.withColumn("gc", each(of_chunks)).groupBy(*tile).cogroup(stats.groupBy(*tile))
        .applyInPandas(_bounded, "dim int, gb int, gc int, chunk long, blocks array<long>"),
        "topk-pairs",
    )

    def searched(blocks: pd.DataFrame, chunks: pd.DataFrame) -> pd.DataFrame:
        best = {b.block: _Best(*_unpacked(b.ids, b.x, b.dim), np.asarray(b.floors), k) for b in blocks.itertuples()}
        for c in chunks.itertuples():
            ids, x = _unpacked(c.ids, c.x, c.dim)
            for b in c.blocks:
                best[b].search(ids, x)
        rows = [(b.query_ids[i], b.ids[i], b.scores[i]) for b in best.values() for i in range(len(b.ids)) if len(b.ids[i])]
        if not rows:
            return pd.DataFrame({c: np.array([], np.int64) for c in ("query_id", "vec_id", "score")})
        ids, found, scores = zip(*rows, strict=True)
        return pd.DataFrame({"query_id": np.repeat(ids, [len(f) for f in found]), "vec_id": np.concatenate(found), "score": np.concatenate(scores)})

    sent = pairs.join(chunks.select("chunk", "ids", "x"), "chunk")
    tiles = pairs.select(*[F.col(c).alias(c) for c in tile]).distinct()
    met = tiles.join(asking, ["dim", "gb"]).select(*[F.col(c).alias(c) for c in (*tile, "block", "ids", "x", "floors")])
    found = met.groupBy(*tile).cogroup(sent.groupBy(*tile)).applyInPandas(searched, "query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
