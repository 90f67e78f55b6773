"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; in local mode, where that is unset, one of this process's own."""
    global _own_dir
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="reviewloom-tables-")
        atexit.register(shutil.rmtree, _own_dir, ignore_errors=True)
    return f"file://{_own_dir}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, so that several steps read it without deriving it again and a lost executor
    costs nothing. It stays until the folder is cleared: results that are returned may still read it."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Characters of text in one part of documents that are dealt out: its tokens, a row each, are some hundred MB.
PART_CHARACTERS = 8_000_000


def parts_of(docs: DataFrame, text_col: str = "text") -> int:
    """The number of parts to deal documents out to: as many as exchanges have, and more where texts are many or long."""
    characters = docs.agg(F.sum(F.length(text_col))).first()[0] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-characters // PART_CHARACTERS))


def kept_apart(name: str, parts: int | None, by: str, here: DataFrame, moved: DataFrame | None = None) -> DataFrame:
    """The rows of both as one table in the shared folder, bucketed by `by` into so many parts, or as many as exchanges have:
    what groups or joins its rows by `by` needs no exchange. Rows of here should be dealt out so already; moved is."""
    spark = here.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    table, path = f"{re.sub('[^a-z0-9]', '_', name)}_{uuid.uuid4().hex}", f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    here.write.bucketBy(parts, by).option("path", path).saveAsTable(table, format="parquet")
    if moved is not None:
        moved.select(*here.columns).repartition(parts, by).write.bucketBy(parts, by).mode("append").option("path", path).saveAsTable(table, format="parquet")
    return spark.table(table)


#: Rows up to which a table of a few short values a row is broadcast: about the 10 MB up to which Spark does so by itself.
BROADCAST_ROWS = 200_000


def if_few(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df, to be broadcast if it has no more than so many rows; they are counted."""
    return F.broadcast(df) if df.count() <= most else df


#: The count from which counts are taken as one; bits of a sieve for each of its rows, and the most 64-bit words it has.
_COUNTS, SIEVE_BITS, SIEVE_WORDS = 100_000, 16, 1_000_000


def split_often(table: DataFrame, count: str, most: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """The rows of table with the highest counts, at most so many, and the others, None where there are none."""
    most = BROADCAST_ROWS if most is None else most
    sizes = table.groupBy(F.least(F.col(count), F.lit(_COUNTS)).alias("c")).agg(F.count("*").alias("n")).collect()
    if sum(r["n"] for r in sizes) <= most:
        return table, None
    taken, least = 0, _COUNTS + 1
    for c, n in sorted(sizes, reverse=True):
        if (taken := taken + n) > most:
            break
        least = c
    return table.filter(F.col(count) >= least), table.filter(F.col(count) < least)


def sieved(rows: DataFrame, table: DataFrame, on: list[str], others: bool = False) -> DataFrame:
    """rows without most of those whose columns `on` are not in table: each of its rows sets a bit that its hash names, and
    the words of bits are broadcast. Some rows that are not in table stay. With others, all rows stay, and _maybe tells
    which may be in table."""
    words = min(SIEVE_WORDS, max(1, table.count() * SIEVE_BITS // 64))
    place = lambda: F.pmod(F.xxhash64(*on), F.lit(words * 64))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("_at") % 64).cast("int"))
    bits = table.select(place().alias("_at")).groupBy((F.col("_at") / 64).cast("long").alias("_word")).agg(F.bit_or(bit).alias("_bits"))
    own = rows.withColumn("_at", place()).withColumn("_word", (F.col("_at") / 64).cast("long"))
    told = own.join(F.broadcast(bits), "_word", "left" if others else "inner").withColumn("_maybe", F.coalesce(F.col("_bits").bitwiseAND(bit) != 0, F.lit(False))).drop("_at", "_word", "_bits")
    return told if others else told.filter("_maybe").drop("_maybe")


def met(rows: DataFrame, table: DataFrame, on: list[str], count: str, most: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """rows joined with a written table by the columns `on`, in two parts: with the keys of the highest counts, which are
    broadcast, so that rows stay where they are; and with the others, for which rows are exchanged, without most of
    those that meet nothing. The second is None where all are broadcast."""
    often, seldom = split_often(table, count, most)
    here = rows.join(F.broadcast(often.drop(count)), on)
    return here, None if seldom is None else sieved(rows, seldom, on).join(seldom.drop(count), on)
