"""Places of rows in an order, without a window over all of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Ranges that the rows are dealt to, a power of two, and the rows whose keys are the splitters' sample.
RANGES, SAMPLE = 256, 4096


def _range(splitters: Column, key: Column) -> Column:
    """How many of the sorted splitters are not above the key, by halving steps."""
    steps = F.array(*[F.lit(RANGES >> i) for i in range(1, RANGES.bit_length())])
    return F.aggregate(steps, F.lit(0), lambda at, s: F.when(F.get(splitters, at + s - 1) <= key, at + s).otherwise(at))


def placed(df: DataFrame, order: Sequence[Column], groups: Sequence[str] = (), name: str = "place") -> DataFrame:
    """df with the place of each row, from 1, in its group in ascending order, nulls first.

    Splitters come from a sample of SAMPLE rows, those whose keys have the smallest hashes, so that the range of a row
    follows from the table alone, also in a task that is run again. Each range of a group is numbered by itself, from
    the sum of the counts before it. Rows with equal keys are in one range; their places among themselves are open. df
    is derived three times.
    """
    keyed = df.withColumn("_key", F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)]))
    sample = keyed.select("_key").orderBy(F.xxhash64("_key")).limit(SAMPLE).agg(F.array_sort(F.collect_list("_key")).alias("s"))
    step = F.greatest(F.lit(1), F.ceil(F.size("s") / RANGES).cast("int"))
    splitters = sample.select(F.filter("s", lambda x, i: (i + 1) % step == 0).alias("_splitters"))
    ranged = keyed.join(F.broadcast(splitters)).withColumn("_range", _range(F.col("_splitters"), F.col("_key"))).drop("_splitters")
    counts = ranged.groupBy(*groups, "_range").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy(*groups).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    kept = ["_range", *groups]
    starts = counts.select(before.alias("_before"), *[F.col(c).alias(f"_of{i}") for i, c in enumerate(kept)])
    own = F.row_number().over(W.partitionBy(*groups, "_range").orderBy("_key"))
    numbered = ranged.withColumn("_own", own)
    same = [F.col(c).eqNullSafe(F.col(f"_of{i}")) for i, c in enumerate(kept)]
    on = same[0]
    for s in same[1:]:
        on = on & s
    return numbered.join(F.broadcast(starts) if not groups else starts, on).select(*df.columns, (F.col("_before") + F.col("_own")).alias(name))
