"""Relational steps of ingest: upserts, parents and children, updates by key, crawl status, nested records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .places import placed


def updated_text(rows: DataFrame, changes: DataFrame, key: str, col: str) -> DataFrame:
    """rows with col replaced where changes (key, col) has the key; the greatest text counts if there are several."""
    one = changes.groupBy(key).agg(F.max(col).alias("_new"))
    return rows.join(one, key, "left").select(*[F.coalesce("_new", c).alias(c) if c == col else F.col(c) for c in rows.columns])


def upserted(stored: DataFrame, batch: DataFrame, key: str, touched: str) -> DataFrame:
    """stored with new keys of batch added, and only `touched` taken from batch for keys that are there already."""
    seen = batch.select(F.col(key), F.col(touched).alias("_touched"))
    kept = stored.join(seen, key, "left").select(*[F.coalesce("_touched", c).alias(c) if c == touched else F.col(c) for c in stored.columns])
    return kept.unionByName(batch.join(stored.select(key), key, "left_anti").select(*stored.columns))


def upserted_two_levels(parents: DataFrame, batch: DataFrame, name: str, child_key: list[str]) -> tuple[DataFrame, DataFrame]:
    """Parents with a surrogate id after the stored ones, and the batch's children under them, one for each key."""
    last = parents.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last"))
    new = batch.select(name).distinct().join(parents.select(name), name, "left_anti")
    numbered = placed(new, [F.col(name)], name="n").join(F.broadcast(last)).select((F.col("last") + F.col("n")).alias("id"), name)
    every = parents.select("id", name).unionByName(numbered)
    children = batch.join(every, name).dropDuplicates(["id", *child_key])
    return every, children


def crawl_status(events: DataFrame, key: str, at: list[str]) -> DataFrame:
    """(key, status): the last status of each link, but success once is success."""
    last = F.max_by("status", F.struct(*at))
    return events.groupBy(key).agg(F.when(F.max((F.col("status") == "succ").cast("int")) == 1, "succ").otherwise(last).alias("status"))


def unseen(requests: DataFrame, status: DataFrame, key: str) -> DataFrame:
    return requests.join(status.filter("status = 'succ'"), key, "left_anti")


def inverted_text(index: DataFrame, key: str, places: str) -> DataFrame:
    """(key, text) from a map of word to places: words in the order of their places, gaps as empty words, lower case."""
    words = index.select(key, F.explode(places).alias("word", "at")).select(key, "word", F.explode("at").alias("i"))
    grouped = words.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("i", "word"))).alias("m"), F.max("i").alias("last"))
    text = F.array_join(F.transform(F.sequence(F.lit(0), F.col("last")), lambda i: F.coalesce(F.element_at("m", i), F.lit(""))), " ")
    return grouped.select(key, F.lower(text).alias("text"))


def flattened(df: DataFrame, missing: int | None = None) -> DataFrame:
    """df with the fields of its structs, at any depth, as columns outer_inner; integers equal to missing are null."""
    from pyspark.sql import types as T

    def leaves(fields: list[T.StructField], path: list[str]) -> list:
        out = []
        for f in fields:
            at = [*path, f.name]
            if isinstance(f.dataType, T.StructType):
                out += leaves(f.dataType.fields, at)
                continue
            value = F.col(".".join(f"`{p}`" for p in at))
            if missing is not None and isinstance(f.dataType, T.IntegralType):
                value = F.nullif(value, F.lit(missing).cast(f.dataType))
            out.append(value.alias("_".join(at)))
        return out

    return df.select(*leaves(df.schema.fields, []))


def response_rows(responses: DataFrame, body: str, schema: str, path: str) -> DataFrame:
    """A row for each element of the array at `path` of saved JSON responses, its fields as columns after the others."""
    kept = [c for c in responses.columns if c != body]
    parsed = responses.withColumn("_body", F.from_json(body, schema))
    return parsed.select(*kept, F.inline(F.col(f"_body.{path}")))


def until_empty(pages: DataFrame, source: str, offset: str, rows: str) -> DataFrame:
    """Pages of each source before its first empty one, where a loop over offsets ends."""
    ends = pages.filter(F.size(rows) == 0).groupBy(source).agg(F.min(offset).alias("_end"))
    return pages.join(ends, source, "left").filter(F.col("_end").isNull() | (F.col(offset) < F.col("_end"))).drop("_end")


def parsed_or_bad(rows: DataFrame, body: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose JSON text the schema fits, with its fields, and the others as they are, for a file beside the good ones."""
    parsed = rows.withColumn("_parsed", F.from_json(body, f"{schema}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}))
    bad = F.col("_parsed").isNull() | F.col("_parsed._corrupt").isNotNull()
    fields = [c for c in rows.columns if c != body]
    return parsed.filter(~bad).select(*fields, "_parsed.*").drop("_corrupt"), parsed.filter(bad).select(*rows.columns)
