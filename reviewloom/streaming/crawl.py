"""A streaming twin of the crawl-status upsert: an extension, since the batch form is what reviews need."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.records import crawl_status


def status_stream(events: DataFrame, path: str, checkpoint: str, key: str = "url", at: tuple[str, ...] = ("ts", "event_id")) -> StreamingQuery:
    """Keeps a status table under path/v=<batch> from a stream of (key, status, *at); success once is success.

    Each batch merges its own last statuses with the table before it and writes the next version; a batch that is
    run again writes the same version again.
    """
    spark = events.sparkSession

    def merge(batch: DataFrame, number: int) -> None:
        rows = batch.select(key, "status", *at)
        before = read_status(spark, path, number - 1)
        if before is not None:
            rows = rows.unionByName(before.select(*rows.columns))
        last = rows.groupBy(key).agg(F.max(F.struct(*at)).alias("_at")).select(key, "_at.*")
        crawl_status(rows, key, list(at)).join(last, key).write.mode("overwrite").parquet(f"{path}/v={number}")

    return events.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_status(spark: SparkSession, path: str, version: int) -> DataFrame | None:
    """The table's version, or None before the first one."""
    return None if version < 0 else spark.read.parquet(f"{path}/v={version}")


def first_seen(events: DataFrame, key: str, ts: str, delay: str) -> DataFrame:
    """The first event of each key within the watermark's delay."""
    return events.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


# What a link's status can be.
PENDING, SUCCESS, FAILED = "pend", "succ", "fail"


class LinkStatus(StatefulProcessor):
    """The status of one link: its first event makes it pending, whatever that says; later ones set it, unless it has
    succeeded and they aren't forced. A timer ends what stays pending for `patience` seconds of event time: it has then
    failed, until another event says otherwise."""

    def __init__(self, patience: int):
        self.patience = patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("status", "status string, at timestamp, timer long")

    def _set(self, key: str, status: str, at: pd.Timestamp, timer: int | None) -> pd.DataFrame:
        self.state.update((status, at.to_pydatetime(), timer))
        return pd.DataFrame({"url": [key], "status": [status], "at": [at]})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        (url,) = key
        events = pd.concat(list(rows)).sort_values(["ts", "status", "forced"])
        held = self.state.get() if self.state.exists() else None
        before = held
        for e in events.itertuples():
            if held is None:
                held = (PENDING, e.ts, None)
            elif held[0] != SUCCESS or e.forced:
                held = (e.status, e.ts, held[2])
        status, at, timer = held
        if timer is not None and (status != PENDING or before is None or before[1] != at):
            self.handle.deleteTimer(timer)
            timer = None
        if status == PENDING and timer is None:
            timer = int(pd.Timestamp(at).timestamp() * 1000) + 1000 * self.patience
            self.handle.registerTimer(timer)
        changed = self._set(url, status, pd.Timestamp(at), timer)
        if before is None or (before[0], pd.Timestamp(before[1])) != (status, pd.Timestamp(at)):
            yield changed

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        status, _, timer = self.state.get()
        if status == PENDING and timer == expiredTimerInfo.getExpiryTimeInMs():
            yield self._set(key[0], FAILED, pd.Timestamp(timer, unit="ms"), None)

    def close(self) -> None:
        pass


def link_status(events: DataFrame, patience: int, delay: str = "0 seconds") -> DataFrame:
    """(url, status, at): each change of a link's status, from a stream of (url, status, ts, forced); see LinkStatus.

    Links are kept by key in the state store, so a batch touches only the links that it has events of, or whose time is
    up. at is the time of the event that set the status, or when patience ended. delay is the watermark's.
    """
    rows = events.select("url", "status", "ts", "forced").withWatermark("ts", delay)
    return rows.groupBy("url").transformWithStateInPandas(LinkStatus(patience), "url string, status string, at timestamp", "Update", "EventTime")
