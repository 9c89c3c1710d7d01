"""Streams with state and timers: files that are still being written, sessions in several parts, stages that stall.

Each is a stateful processor for one key (a path, a session, a stage). Its state is in the state store of the query, so it survives a restart from the
checkpoint and a lost executor. They need the RocksDB state store: `with_state_store(spark)` sets it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_state_store(spark: SparkSession) -> SparkSession:
    """The session, with the state store that these processors need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)
    return spark


def _rearm(handle, at: int) -> None:
    for old in list(handle.listTimers()):
        handle.deleteTimer(old)
    handle.registerTimer(at)


class _Settled(StatefulProcessor):
    def __init__(self, wait_ms: int):
        self.wait = wait_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "modified long, bytes long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now, old = timerValues.getCurrentProcessingTimeInMs(), self.seen.get() if self.seen.exists() else None
        for part in rows:
            for r in part.sort_values("modified").itertuples(index=False):
                if old is None or (int(r.modified), int(r.bytes)) != tuple(old):
                    old = (int(r.modified), int(r.bytes))
                    self.seen.update(old)
                    # a file that has been left alone for long enough already goes at the next chance
                    _rearm(self.handle, max(now + 1, old[0] + self.wait))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.seen.exists():
            modified, size = self.seen.get()
            yield pd.DataFrame({"path": [key[0]], "modified": [modified], "bytes": [size]})


def settled_files(listing: DataFrame, seconds: float = 5.0) -> DataFrame:
    """path, modified, bytes of each file once it hasn't changed for `seconds`; again if it changes later.

    listing: a stream of looks at a folder (path, modified in ms, bytes); rows that say what is known already change nothing.
    """
    asked = listing.select("path", F.col("modified").cast("long").alias("modified"), F.col("bytes").cast("long").alias("bytes")).where("path is not null and modified is not null")
    return asked.fillna(0, ["bytes"]).groupBy("path").transformWithStateInPandas(_Settled(round(1000 * seconds)), "path string, modified long, bytes long", "Append", "ProcessingTime")


class _Parts(StatefulProcessor):
    def init(self, handle) -> None:
        self.parts = handle.getMapState("parts", "part int", "path string")
        self.done = handle.getValueState("done", "done boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        session, total = key
        for part in rows:
            for r in part.sort_values("path").itertuples(index=False):
                if 1 <= r.part <= total and not self.parts.containsKey((int(r.part),)):
                    self.parts.updateValue((int(r.part),), (r.path,))
        have = {k[0]: v[0] for k, v in self.parts.iterator()}
        if len(have) == total and not self.done.exists():
            self.done.update((True,))
            yield pd.DataFrame({"session": [session], "total": [total], "paths": [[have[i] for i in sorted(have)]]})


def released_sessions(files: DataFrame) -> DataFrame:
    """session, total, paths (in order of parts) of each session once all its parts have come; the first path of a part counts.

    files: a stream of path, session, part, total. Each session is given once, however often its files come up again; sets of another total are sessions of their own.
    """
    known = files.select(F.col("session").cast("string").alias("session"), F.col("total").cast("int").alias("total"), F.col("part").cast("int").alias("part"), "path").where("session is not null and part is not null and total > 0 and path is not null")
    return known.groupBy("session", "total").transformWithStateInPandas(_Parts(), "session string, total int, paths array<string>", "Append", "None")


class _Stages(StatefulProcessor):
    def __init__(self, wait_ms: int, most_bytes: int):
        self.wait, self.most = wait_ms, most_bytes

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "status string, rss long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now, rss, status, told = timerValues.getCurrentProcessingTimeInMs(), 0, None, []
        if self.last.exists():
            status, rss = self.last.get()
        for part in rows:
            for r in part.sort_values("timestamp").itertuples(index=False):
                used = 0 if pd.isna(r.rss_bytes) else int(r.rss_bytes)
                # large, and no smaller than the most so far
                if used >= self.most and used >= rss:
                    told.append(used)
                rss, status = max(rss, used), r.status
        self.last.update((status, rss))
        if status in ("completed", "failed"):
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
        else:
            _rearm(self.handle, now + self.wait)
        if told:
            yield pd.DataFrame({"stage": [key[0]], "alarm": ["memory"], "status": [status], "rss_bytes": [max(told)]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        status, rss = self.last.get() if self.last.exists() else (None, 0)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.wait)  # and again after as long a silence
        yield pd.DataFrame({"stage": [key[0]], "alarm": ["stall"], "status": [status], "rss_bytes": [rss]})


def stream_alarms(metrics: DataFrame, stall_seconds: float, most_bytes: int) -> DataFrame:
    """stage, alarm, status, rss_bytes: `stall` when an open stage says nothing for that long (and each time again), `memory` when a record is that large and not falling.

    metrics: a stream of the stage log (timestamp, stage, status, rss_bytes). A stage is open until it is completed or failed.
    """
    known = metrics.select("stage", "timestamp", F.col("status").cast("string").alias("status"), F.col("rss_bytes").cast("long").alias("rss_bytes")).where("stage is not null")
    return known.groupBy("stage").transformWithStateInPandas(_Stages(round(1000 * stall_seconds), most_bytes), "stage string, alarm string, status string, rss_bytes long", "Append", "ProcessingTime")
