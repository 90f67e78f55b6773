"""A stream of link events with keyed state: sticky success, forced events, time-out."""

from datetime import datetime, timedelta

import pytest

from reviewloom.streaming.crawl import link_status

BEGIN = datetime(2024, 1, 1)


@pytest.fixture
def state_store(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(name, before)


def test_links_over_batches(spark, tmp_path, state_store):
    schema = "url string, status string, ts timestamp, forced boolean"
    batches = [
        [("a", "pend", 0, False), ("b", "succ", 0, False), ("c", "pend", 0, False), ("d", "pend", 1, False)],
        [("a", "succ", 10, False), ("b", "fail", 10, False), ("c", "pend", 20, False)],
        [("a", "fail", 30, False), ("b", "succ", 30, False), ("e", "pend", 130, False)],  # d is late by now, c isn't
        [("a", "pend", 140, True), ("e", "succ", 141, False), ("d", "succ", 142, False), ("z", "pend", 400, False)],  # c's and a's time ends
        [("e", "fail", 401, False)],
    ]
    changes = []

    def gather(batch, number):
        changes.append(sorted((r.url, r.status, int((r.at - BEGIN).total_seconds())) for r in batch.collect()))

    for i, rows in enumerate(batches):
        made = [(u, s, BEGIN + timedelta(seconds=t), f) for u, s, t, f in rows]
        spark.createDataFrame(made, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*")
        query = link_status(stream, 100).writeStream.foreachBatch(gather).outputMode("update").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        query.awaitTermination()
    told = [c for c in changes if c]
    assert told[0] == [("a", "pend", 0), ("b", "pend", 0), ("c", "pend", 0), ("d", "pend", 1)]  # the first event is a pending one
    assert told[1] == [("a", "succ", 10), ("b", "fail", 10), ("c", "pend", 20)]
    flat = [x for c in told[2:] for x in c]
    assert [x for x in flat if x[0] == "a"] == [("a", "pend", 140), ("a", "fail", 240)]  # success stays until it is forced
    assert [x for x in flat if x[0] == "b"] == [("b", "succ", 30)]
    assert [x for x in flat if x[0] == "c"] == [("c", "fail", 120)]
    assert [x for x in flat if x[0] == "d"] == [("d", "fail", 101), ("d", "succ", 142)]
    assert [x for x in flat if x[0] == "e"] == [("e", "pend", 130), ("e", "succ", 141)]
