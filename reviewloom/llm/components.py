"""Connected components of links between identifiers, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import compact, discarded


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the least of the node and its neighbours."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the least of them. Edges run from the larger end."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    tied = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def components(links: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """(id, component): the smallest identifier that each linked one reaches; one without links has no row.

    Minima are summed before rows are tied to them, so a node with many links is no group of its own in memory.
    A link with a null end is none; repeated links count once; an empty table gives no rows.
    """
    a, b = F.col(x).cast("long"), F.col(y).cast("long")
    ends = links.select(a.alias("a"), b.alias("b")).dropna()
    edges = compact(ends.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    before = None
    while True:
        large = compact(_large_star(edges), "edges-large")  # the small star reads it three times
        last, edges = edges, compact(_small_star(large), "edges")
        discarded(last, large)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    tied = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return tied.unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
