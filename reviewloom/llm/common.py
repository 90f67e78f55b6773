"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts are long, so that a batch of rows is to be smaller than Spark's own defaults: setting, default, value here.
BATCHES = (
    ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "4m"),  # on its way to a Python worker
    ("spark.sql.parquet.columnarReaderBatchSize", "4096", "512"),  # rows read at a time
)
#: Rows up to which a table of few numbers a row is broadcast; above, it is joined.
BROADCAST_ROWS = 1_000_000
#: Rows a file of a compact table.
_FILE_ROWS = 500_000
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
        _own_dir = tempfile.mkdtemp(prefix="reviewloom-")
        atexit.register(shutil.rmtree, _own_dir, ignore_errors=True)
    return f"file://{_own_dir}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: cuts lineage, fixes row order per file and survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def held(df: DataFrame) -> DataFrame:
    """df, kept on the executors' disks until it is unpersisted. What a lost executor held is made again, so this is
    for what depends on written tables only, over few steps."""
    return df.persist(StorageLevel.DISK_ONLY)


def compact(df: DataFrame, name: str) -> DataFrame:
    """As written, for tables of little a row: rows are made by all tasks and then written to as few files as hold
    them, since a file for each of many tasks costs more than its rows."""
    kept = held(df)
    files = 1 + kept.count() // _FILE_ROWS
    table = written(kept.coalesce(files), name)
    kept.unpersist()
    return table


def discarded(*tables: DataFrame) -> None:
    """Deletes tables that `written` made, once no later step reads them."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def few(table: DataFrame) -> DataFrame:
    """A written table of some numbers a row, to be broadcast if it has few enough."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text): only the two columns an operator reads; a null text is an empty one.

    Where the session has Spark's defaults, batches of rows are as small as BATCHES says from here on.
    """
    conf = docs.sparkSession.conf
    for name, default, value in BATCHES:
        if conf.get(name) == default:
            conf.set(name, value)
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )


def fresh(df: DataFrame, name: str) -> str:
    """name, or name with underscores before it until df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
