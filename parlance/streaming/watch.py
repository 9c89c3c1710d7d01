"""Watching a folder: new segment files as a stream, with the batch operators applied to each micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from parlance.sources.readers import SEGMENT
from parlance.tables import materialize

METRIC = "timestamp timestamp, stage string, status string, session string, elapsed_seconds double, rss_bytes long"


def new_segments(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """Rows of segment files as they arrive, without lines that aren't JSON; the source remembers the files it has given."""
    s = spark.readStream.schema(f"{SEGMENT}, _bad string").option("columnNameOfCorruptRecord", "_bad").option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", "true").json(folder)
    return s.withColumn("path", F.input_file_name()).where("_bad is null").drop("_bad")


def process(stream: DataFrame, work: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, available_now: bool = False, seconds: int = 10) -> StreamingQuery:
    """work on every micro-batch, appended to out. A batch that is tried again writes under the same batch number, so results come once."""

    def one(batch: DataFrame, number: int) -> None:
        work(batch).withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(out)

    writer = stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=f"{seconds} seconds")).start()


def pending(inputs: DataFrame, status: DataFrame, backfill: bool = False) -> DataFrame:
    """inputs (path, has_transcript) with what is to be done: transcribe, postprocess or skip, by the status table (path, state)."""
    s = inputs.join(status.select("path", "state"), "path", "left")
    task = F.when(F.col("state") == "completed", "skip").when(F.col("has_transcript"), F.when(F.lit(backfill) | F.col("state").isNotNull(), "postprocess").otherwise("skip")).otherwise("transcribe")
    return s.select("path", task.alias("task"))


def stable(files: DataFrame, now, seconds: float = 5.0) -> tuple[DataFrame, DataFrame]:
    """(files old enough to read, files to look at again) by modificationTime."""
    ready = F.unix_micros("modificationTime") / 1e6 <= F.unix_micros(F.lit(now).cast("timestamp")) / 1e6 - seconds
    return files.where(ready), files.where(~ready)


def complete_sessions(parts: DataFrame) -> DataFrame:
    """Sessions all of whose parts are there; works on a stream too (update or complete mode)."""
    return parts.groupBy("session").agg(F.collect_set("part").alias("parts"), F.max("total").alias("total")).where(F.size("parts") == F.col("total")).select("session")


def turn_counts(stream: DataFrame, late: str = "10 minutes", window: str = "5 minutes", slide: str = "1 minute") -> DataFrame:
    """Events and mean value by sliding window and type, with a watermark; event time in ts."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", window, slide), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean_value"))


def user_sessions(stream: DataFrame, gap: str = "2 hours", late: str = "10 minutes") -> DataFrame:
    """Runs of events of one user with gaps under `gap`."""
    return stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))


def stage_alarms(metrics: DataFrame, most_seconds: float, most_bytes: int) -> DataFrame:
    """Stage events that ran too long or grew too large."""
    why = F.when(F.col("elapsed_seconds") > most_seconds, "stall").when(F.col("rss_bytes") > most_bytes, "memory")
    return metrics.withColumn("alarm", why).where("alarm is not null")


def watch_step(spark: SparkSession, files: DataFrame, status: str, transcripts: DataFrame, transcribe: Callable[[DataFrame], None], postprocess: Callable[[DataFrame], None], now, seconds: float = 5.0, backfill: bool = False) -> DataFrame:
    """One look at a watched folder: files that are old enough are routed by the status table, worked on and marked; returns path and task.

    files: path, modificationTime. Files too young keep their state and come up again next time, as do those whose work fails: they are marked as failed, and the error is raised once all
    kinds of work have had their turn. Call it from foreachBatch with the batch's listing, or on a schedule.
    """
    from parlance.operators.discovery import already_done, candidate_media
    from parlance.sources.writers import set_state, states

    ready, _ = stable(candidate_media(files), now, seconds)
    known = already_done(ready.select("path"), transcripts).select("path", F.lit(True).alias("has_transcript"))
    told = states(spark, status, without=("failed", "started"))  # a failure leaves what a file had before
    tasks = pending(ready.select("path").join(known, "path", "left").fillna(False, ["has_transcript"]), told, backfill)
    tasks = materialize(tasks, "tasks")  # fixed before work changes the status
    failed: list[Exception] = []
    for task, work in (("transcribe", transcribe), ("postprocess", postprocess)):
        some = tasks.where(F.col("task") == task)
        if not some.isEmpty():
            try:
                work(some.select("path"))
            except Exception as e:
                set_state(spark, status, some, "failed")
                failed.append(e)
            else:
                set_state(spark, status, some, "transcribed" if task == "transcribe" else "completed")
    if failed:
        raise failed[0]
    return tasks


def archive_step(spark: SparkSession, files: DataFrame, status: str, root: str, most_failures: int = 3) -> DataFrame:
    """path, target, outcome: completed inputs and what belongs to them go to root/processed, those that failed too often to root/quarantine; names that are taken are left.

    files: a listing of root, the two folders included. A step that is cut short is finished by the next: what is gone already isn't there to be moved.
    """
    from parlance.operators.discovery import bundle_moves, failing, moved
    from parlance.sources.writers import states

    there = files.select("path").distinct()
    inside = lambda name: there.where(F.col("path").startswith(f"{root.rstrip('/')}/{name}/"))
    open_ = there.join(inside("processed"), "path", "left_anti").join(inside("quarantine"), "path", "left_anti")
    done = states(spark, status).where("state = 'completed'").select("path").join(open_, "path", "left_semi")
    history = spark.read.schema("path string, state string, at timestamp").parquet(status)
    bad = failing(history, most_failures).select("path").join(open_, "path", "left_semi")
    plans = [bundle_moves(some, open_, inside(name), f"{root.rstrip('/')}/{name}") for some, name in ((done, "processed"), (bad, "quarantine"))]
    plan = materialize(plans[0].unionByName(plans[1]), "moves")  # the moves are fixed before the first file moves
    return materialize(moved(plan), "moved")
