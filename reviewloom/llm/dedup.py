"""Exact deduplication by content sort."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts, written

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_RUNS = "doc_id long, text_sha256 string, run_keep long, run_size long, edge boolean, lead boolean"


class _Run:
    """Equal neighbours: only their identifiers and one digest are held."""

    def __init__(self, text: str, key: int, first: bool):
        self.text, self.key, self.first = text, key, first
        self.ids: list[pa.Array] = []


def _runs(keep_max: bool):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        closed: list[_Run] = []  # runs under one sort hash, held until it is known whether they end the partition
        run: _Run | None = None

        def rows(held: list[_Run], last: bool) -> pa.RecordBatch:
            parts = [(pa.concat_arrays(r.ids), hashlib.sha256(r.text.encode()).hexdigest(), r.first or last) for r in held]
            n = [len(i) for i, _, _ in parts]
            lead = np.zeros(sum(n), bool)
            lead[np.cumsum([0, *n[:-1]])] = True
            keep = pa.array([(pc.max if keep_max else pc.min)(i).as_py() for i, _, _ in parts], pa.int64())
            return pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([i for i, _, _ in parts]),
                    pa.array(np.repeat(np.array([s for _, s, _ in parts], object), n), pa.string()),
                    keep.take(pa.array(np.repeat(np.arange(len(n)), n))),
                    pa.array(np.repeat(n, n)),
                    pa.array(np.repeat([e for _, _, e in parts], n)),
                    pa.array(lead),
                ],
                names=[c.split()[0] for c in _RUNS.split(", ")],
            )

        first_key = None
        for b in batches:
            if not b.num_rows:
                continue
            ids = b.column(0).take(pa.array(np.arange(b.num_rows)))  # a copy: a slice would hold its batch's texts too
            text, key = b.column(1), b.column(2).to_numpy(zero_copy_only=False)
            if first_key is None:
                first_key = key[0]
            same = np.zeros(len(ids), bool)
            same[1:] = pc.equal(text.slice(1), text.slice(0, len(ids) - 1)).to_numpy(zero_copy_only=False)
            same[0] = run is not None and run.text == text[0].as_py()
            starts = np.flatnonzero(~same)
            if len(starts) == 0 or starts[0] > 0:
                run.ids.append(ids.slice(0, starts[0] if len(starts) else len(ids)))
            done: list[_Run] = []
            for s, e in zip(starts, [*starts, len(ids)][1:], strict=True):  # no starts: the open run holds the whole batch
                if run is not None:
                    closed.append(run)
                    if closed[-1].key != key[s]:
                        done += closed
                        closed = []
                run = _Run(text[s].as_py(), key[s], key[s] == first_key)
                run.ids.append(ids.slice(s, e - s))
            if done:
                yield rows(done, False)
        if run is not None:
            yield rows([*closed, run], True)

    return scan


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """One row per document: (doc_id, keep_id, group_size, kept, text_sha256), dropped documents too.

    Texts are equal when identical after lower-casing A-Z; a null text counts as empty. keep is "min" or "max":
    which doc_id of a group stays. Sampled splitters over (first bytes, hash, doc_id) range-partition the
    normalised texts, so that splitters on the driver stay small and a group larger than a partition is split by
    doc_id; Spark's external sort places equals adjacent and a scan compares full neighbours. The runs at the
    edges of partitions, at most a few each, are then merged over partitions by digest.

    An empty table gives no rows; rows with a repeated doc_id each give a row and count in group_size, and kept
    marks each row whose doc_id is the one that stays. A null doc_id counts in group_size and stays only where its
    group has no other; keep_id is then null. Other input columns are ignored.
    """
    ascii_only = F.octet_length("text") == F.length("text")
    folded = texts(docs, id_col, text_col).select("doc_id", F.when(ascii_only, F.lower("text")).otherwise(F.translate("text", _UPPER, _LOWER)).alias("text"))
    keyed = folded.select("doc_id", "text", F.xxhash64("text").alias("h"), F.substring("text", 1, 16).alias("head"))
    ordered = keyed.repartitionByRange("head", "h", "doc_id").sortWithinPartitions("head", "h", "text", "doc_id")
    runs = written(ordered.select("doc_id", "text", "h").mapInArrow(_runs(keep == "max"), _RUNS), "dedup-runs")
    pick = F.max if keep == "max" else F.min
    # at most two sort hashes a partition: as many rows as twice the partitions
    edges = (
        runs.filter("edge and lead")
        .groupBy("text_sha256")
        .agg(pick("run_keep").alias("edge_keep"), F.sum("run_size").alias("edge_size"))
    )
    return runs.join(F.broadcast(edges), "text_sha256", "left").select(
        "doc_id",
        F.coalesce("edge_keep", "run_keep").alias("keep_id"),
        F.coalesce("edge_size", "run_size").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.coalesce("edge_keep", "run_keep")).alias("kept"),
        "text_sha256",
    )
