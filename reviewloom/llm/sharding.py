"""Byte-balanced sharding of indivisible groups by Karmarkar-Karp differencing."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import compact, texts, written

#: Items that the differencing sees: so many bundles of light groups, and at most as many heavy groups.
BUNDLES = 8192
_ROWS_PER_SLOT_BUCKET = 20_000


def difference(sizes: list[int], shards: int) -> list[int]:
    """The shard of each item: the two partial partitions with the largest spread are combined in opposite order
    until one is left; the tree of combinations is then unwound."""
    if not sizes:
        return []
    zeros = [0] * (shards - 1)
    heap = [(-s, i, [s, *zeros]) for i, s in enumerate(sizes)]  # sums descending
    heapq.heapify(heap)
    children: list[tuple[int, int, list[int]]] = []
    n = len(sizes)
    while len(heap) > 1:
        _, a, x = heapq.heappop(heap)
        _, b, y = heapq.heappop(heap)
        sums = [p + q for p, q in zip(x, reversed(y), strict=True)]
        order = sorted(range(shards), key=sums.__getitem__, reverse=True)
        sums = [sums[i] for i in order]
        heapq.heappush(heap, (sums[-1] - sums[0], n + len(children), sums))
        children.append((a, b, order))
    places = {heap[0][1]: list(range(shards))}
    out = [0] * n
    for node in range(n + len(children) - 1, -1, -1):
        place = places.pop(node)
        if node < n:
            out[node] = place[0]
            continue
        a, b, order = children[node - n]
        at = [0] * shards
        for position, unsorted in enumerate(order):
            at[unsorted] = place[position]
        places[a], places[b] = at, at[::-1]
    return out


def shard_documents(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: (doc_id, size, text_crc32, law, shard, slot, grown_shard) under the law `bytes`.

    Size is the text's UTF-8 bytes plus 1; equal texts (null counts as empty) stay in one shard. A group of over
    1/8192 of all bytes is an item of its own, so there are at most 8192 of them; lighter groups are bundled by
    digest into 8192 items. The differencing thus works in one task on at most 16,384 sums at any input size, and
    its result is small enough to broadcast. Slots are gapless from 0 in each shard, numbered in hash buckets
    whose counts give each bucket's first slot. grown_shard is null.

    An empty table gives no rows; repeated rows each get a slot; other input columns are ignored. A group of more
    than 1/shards of the bytes fills its shard alone.
    """
    spark = docs.sparkSession
    rows = written(
        texts(docs, id_col, text_col).select(
            "doc_id",
            (F.octet_length("text").cast("long") + 1).alias("size"),
            F.crc32("text").alias("text_crc32"),
            F.sha2("text", 256).alias("digest"),
        ),
        "shard-rows",
    )
    groups = rows.groupBy("digest").agg(F.sum("size").alias("bytes"))
    total, n_rows = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    light = F.concat(F.lit("b"), F.pmod(F.xxhash64("digest"), F.lit(BUNDLES)).cast("string"))
    items = (
        groups.withColumn("item", F.when(F.col("bytes") > total / BUNDLES, F.col("digest")).otherwise(light))
        .groupBy("item")
        .agg(F.sum("bytes").alias("bytes"))
    )

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bytes", "item"], ascending=[False, True])
        return pd.DataFrame({"item": pdf["item"], "shard": difference([int(b) for b in pdf["bytes"]], shards)})

    placed = compact(items.withColumn("one", F.lit("all")).groupBy("one").applyInPandas(place, "item string, shard int"), "shard-items")
    heavy = placed.filter(F.length("item") == 64).select(F.col("item").alias("digest"), F.col("shard").alias("own"))
    bundles = placed.filter(F.length("item") < 64).select("item", F.col("shard").alias("bundled"))
    put = (
        rows.join(F.broadcast(heavy), "digest", "left")
        .withColumn("item", light)
        .join(F.broadcast(bundles), "item", "left")
        .select("doc_id", "size", "text_crc32", F.coalesce("own", "bundled").alias("shard"))
        .withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(1 + n_rows // (shards * _ROWS_PER_SLOT_BUCKET))))
    )
    counts = put.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    firsts = counts.select(
        "shard",
        "bucket",
        (F.sum("n").over(W.partitionBy("shard").orderBy("bucket")) - F.col("n")).alias("first"),
    )
    slot = F.row_number().over(W.partitionBy("shard", "bucket").orderBy("doc_id")) - 1
    return put.withColumn("local", slot).join(firsts, ["shard", "bucket"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("first") + F.col("local")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
