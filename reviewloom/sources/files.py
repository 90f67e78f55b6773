"""Readers and writers of the review formats: CSV, JSON, word lists, rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip
from ..operators.places import placed
from ..operators.rowstats import Interval, interval_name


def read_csv(spark: SparkSession, path: str, schema: str | None = None, keep_empty: bool = False) -> DataFrame:
    """A CSV with a header; values may hold line ends and doubled quotes. keep_empty: empty texts aren't null."""
    reader = spark.read.options(header=True, multiLine=True, quote='"', escape='"')
    df = (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)
    return df.na.fill("") if keep_empty else df


def read_reviews_csv(spark: SparkSession, path: str, content: str, score: str, threshold: float) -> DataFrame:
    """Reviews with posneg: 1 where the score reaches the threshold, else 0; only .csv paths are taken."""
    if not path.endswith(".csv"):
        raise ValueError("a .csv file is needed")
    df = read_csv(spark, path, keep_empty=True)
    return df.withColumn(content, strip(F.col(content))).withColumn("posneg", (F.col(score).try_cast("double") >= threshold).cast("int"))


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """An array of objects, or one object."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def read_reviews_json(spark: SparkSession, path: str, content: str = "content", recommend: str = "will_recommend") -> DataFrame:
    """Reviews of a JSON array with posneg: 1 where the reviewer recommends (1), else 0, also where nothing is said; only
    .json paths are taken. Texts lose the white space at their ends."""
    if not path.endswith(".json"):
        raise ValueError("a .json file is needed")
    df = read_json(spark, path)
    return df.withColumn(content, strip(F.col(content))).withColumn("posneg", F.coalesce((F.col(recommend) == 1).cast("int"), F.lit(0)))


def read_tasks(spark: SparkSession, path: str, listed: str) -> DataFrame:
    """The entries that a JSON task file lists under a name, one row each, beside the file's own fields."""
    whole = read_json(spark, path)
    return whole.select(*[c for c in whole.columns if c != listed], F.inline(F.col(listed)))


def words_of_all(*lists: DataFrame) -> DataFrame:
    """(word): the words of any of the lists, each once."""
    every = lists[0].select("word")
    for other in lists[1:]:
        every = every.unionByName(other.select("word"))
    return every.distinct()


def read_lexicon_json(spark: SparkSession, path: str) -> DataFrame:
    """(token, pos, neg, obj) from one JSON object of word to three numbers."""
    whole = spark.read.text(path, wholetext=True)
    entries = whole.select(F.explode(F.from_json("value", "map<string,array<double>>")).alias("token", "t"))
    return entries.select("token", *[F.get("t", i).alias(c) for i, c in enumerate(("pos", "neg", "obj"))])


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """(word): distinct lines without white space at their ends."""
    return spark.read.text(path).select(strip(F.col("value")).alias("word")).filter("word <> ''").distinct()


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, file, block, line): the lines of text files with the file, the place of the part of the file that a task
    reads, and a number that grows within a part: together the order in which the lines stand, files by their names."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    return lines.withColumn("line", F.monotonically_increasing_id())


_FILE_ORDER = ("file", "block", "line")


def read_ranking(spark: SparkSession, path: str, k: int | None = None) -> DataFrame:
    """(word, value, rank) from lines `word: value` in the order of the file; with k only the first k of them. A line
    without a colon is none of them."""
    parts = F.split("value", ":\\s*")
    lines = numbered_lines(spark, path).filter(F.contains("value", F.lit(":")))
    df = lines.select(strip(F.get(parts, 0)).alias("word"), F.get(parts, 1).try_cast("double").alias("value"), *_FILE_ORDER)
    if k is not None:
        df = df.orderBy(*_FILE_ORDER).limit(k)
    return placed(df, [F.col(c) for c in _FILE_ORDER], name="rank").drop(*_FILE_ORDER)


def read_term_list(spark: SparkSession, path: str, k: int | None = None) -> DataFrame:
    """(term, rank) from one term a line, in the order of the file; with k only the first k. Empty lines count for
    nothing."""
    df = numbered_lines(spark, path).select(strip(F.col("value")).alias("term"), *_FILE_ORDER).filter("term <> ''")
    if k is not None:
        df = df.orderBy(*_FILE_ORDER).limit(k)
    return placed(df, [F.col(c) for c in _FILE_ORDER], name="rank").drop(*_FILE_ORDER)


def write_ranking(df: DataFrame, path: str, word: str = "term", value: str = "score") -> None:
    """Lines `word: value` in the order of value and word, over several files in that order."""
    line = F.concat(F.col(word), F.lit(": "), F.col(value).cast("string")).alias("value")
    df.orderBy(F.desc(value), word).select(line).write.mode("overwrite").text(path)


def write_words(df: DataFrame, path: str, word: str = "term") -> None:
    df.select(F.col(word).alias("value")).write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str, quote_all: bool = False, rows_per_file: int = 0) -> None:
    df.write.mode("overwrite").options(header=True, quoteAll=quote_all, escape='"', maxRecordsPerFile=rows_per_file).csv(path)


def write_csv_by(df: DataFrame, path: str, *groups: str) -> None:
    """One folder for each group."""
    df.write.mode("overwrite").partitionBy(*groups).option("header", True).csv(path)


def write_intervals(df: DataFrame, path: str, value: str, intervals: tuple[Interval, ...], others: tuple[str, ...] = ()) -> None:
    """One folder for each interval of a column's values, named after it; the other statistics' columns are left out, as
    are rows that no interval holds."""
    parts = df.withColumn("part", interval_name(F.col(value), intervals)).filter("part is not null").drop(*others)
    write_csv_by(parts, path, "part")


def write_feed(items: DataFrame, path: str, kind: str, fields: list[str], kind_col: str = "kind") -> None:
    """The items of one kind as CSV with the given fields in that order; a field that none has is an empty column."""
    have = set(items.columns)
    write_csv(items.filter(F.col(kind_col) == kind).select(*[F.col(f) if f in have else F.lit(None).cast("string").alias(f) for f in fields]), path)


def write_csv_indexed(df: DataFrame, path: str, order: list[str], index: str = "index") -> None:
    """CSV with a column of places from 0 in the given order."""
    write_csv(with_index(df, order, index), path)


def with_index(df: DataFrame, order: list[str], index: str = "index") -> DataFrame:
    """df with the place of each row, from 0, in the given order."""
    columns = [F.col(c) for c in order]
    return placed(df, columns, name=index).select((F.col(index) - 1).alias(index), *df.columns)


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object a line."""
    df.write.mode("overwrite").json(path)
