"""Progress and metrics of stages: counted while a stage is written, logged where the alarms read them, told to a callback."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from parlance.sources.writers import log_metrics

Told = Callable[[str, dict], None]


class Progress:
    """Stages of one run. log: the folder of the stage log; told(stage, facts) is called at the start and the end of each."""

    def __init__(self, spark: SparkSession, log: str, told: Told | None = None, session: str | None = None):
        self.spark, self.log, self.told, self.session = spark, log, told, session

    def say(self, stage: str, status: str, **facts) -> None:
        log_metrics(self.spark, self.log, stage, status, self.session, facts.get("seconds"), facts.get("rows"))
        if self.told:
            self.told(stage, {"status": status, **facts})

    def write(self, df: DataFrame, path: str, stage: str, **counted: Column) -> dict:
        """Write df to path as Parquet; returns its number of rows and the counted aggregates, taken in the same job."""
        seen, began = Observation(f"{stage}-{time.monotonic_ns()}"), time.monotonic()
        self.say(stage, "started")
        try:
            df.observe(seen, F.count("*").alias("rows"), *[c.alias(name) for name, c in counted.items()]).write.mode("overwrite").parquet(path)
        except Exception as e:
            self.say(stage, "failed", seconds=time.monotonic() - began, error=str(e)[:200])
            raise
        facts = dict(seen.get)
        self.say(stage, "completed", seconds=time.monotonic() - began, **facts)
        return facts

    def run(self, stage: str, work: Callable[[], object]) -> object:
        """work() as a stage that returns no table."""
        began = time.monotonic()
        self.say(stage, "started")
        try:
            out = work()
        except Exception as e:
            self.say(stage, "failed", seconds=time.monotonic() - began, error=str(e)[:200])
            raise
        self.say(stage, "completed", seconds=time.monotonic() - began)
        return out


class StreamProgress(StreamingQueryListener):
    """Each micro-batch's rows and seconds, per query, to told(name, facts): add it with spark.streams.addListener()."""

    def __init__(self, told: Told):
        self.told = told
        self.names: dict[str, str] = {}

    def onQueryStarted(self, event) -> None:
        self.names[str(event.id)] = event.name or str(event.id)
        self.told(self.names[str(event.id)], {"status": "started"})

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.told(p.name or str(p.id), {"status": "running", "batch": p.batchId, "rows": p.numInputRows, "seconds": p.batchDuration / 1000})

    def onQueryIdle(self, event) -> None:
        self.told(self.names.get(str(event.id), str(event.id)), {"status": "idle"})

    def onQueryTerminated(self, event) -> None:
        self.told(self.names.get(str(event.id), str(event.id)), {"status": "failed" if event.exception else "completed"})
