"""Each query with SQL gives DuckDB's rows on the smallest tables."""

import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from reviewloom.plans import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v if v is None or isinstance(v, (bool, int, str)) else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.sql(SQL[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    rows = [tuple(plain(r[c]) for c in cols) for r in got.collect()]
    at = [want.columns.index(c) for c in cols]
    assert sorted(map(repr, rows)) == sorted(repr(tuple(plain(r[i]) for i in at)) for r in want.fetchall())


def test_rare_unigrams_of_repeated_and_absent_ids(spark, tmp_path):
    """Rows of one doc_id are one review, rows without are none; no token is made twice."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    path = f"{tmp_path}/documents.parquet"
    docs.union(docs.limit(5)).union(docs.limit(5).withColumn("doc_id", F.lit(None).cast("long"))).write.parquet(path)
    got = QUERIES["rare_unigrams"](spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    want = con.sql(SQL["rare_unigrams"]).fetchall()
    assert sorted(tuple(r) for r in got.collect()) == sorted(want) and want
    assert "Generate" not in got._jdf.queryExecution().executedPlan().toString()


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
