"""Writers: subtitles, transcripts, data sets and their manifests."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions.text import clock, srt_clock
from parlance.tables import delete, replace


def srt_blocks(segments: DataFrame) -> DataFrame:
    """file, idx, block: numbered by time before blank texts go, so numbers can skip."""
    w = Window.partitionBy("file").orderBy("start", "end")
    s = segments.withColumn("idx", F.row_number().over(w)).where("trim(coalesce(text, '')) <> ''")
    block = F.concat_ws("\n", F.col("idx").cast("string"), F.concat(srt_clock(F.col("start")), F.lit(" --> "), srt_clock(F.col("end"))), F.concat(F.lit(""), F.trim("text")), F.lit(""))
    return s.select("file", "idx", block.alias("block"))


def write_srt(segments: DataFrame, path: str) -> None:
    """One folder per file, blocks in order."""
    rows = srt_blocks(segments).repartition("file").sortWithinPartitions("file", "idx").select("file", "block")
    replace(segments.sparkSession, path, lambda folder: rows.write.partitionBy("file").text(folder))


def transcript_lines(segments: DataFrame) -> DataFrame:
    line = F.concat(F.lit("["), clock(F.col("start")), F.lit("] "), F.coalesce("speaker", F.lit("unknown")), F.lit(": "), F.trim("text"))
    return segments.where("trim(coalesce(text, '')) <> ''").select("file", "start", line.alias("line"))


def write_transcript(segments: DataFrame, path: str) -> None:
    rows = transcript_lines(segments).repartition("file").sortWithinPartitions("file", "start").select("file", F.col("line").alias("value"))
    replace(segments.sparkSession, path, lambda folder: rows.write.partitionBy("file").text(folder))


def write_jsonl(segments: DataFrame, path: str) -> None:
    rows = segments.repartition("file").sortWithinPartitions("file", "start")
    replace(segments.sparkSession, path, lambda folder: rows.write.partitionBy("file").json(folder))


def write_dataset(dataset: DataFrame, path: str) -> None:
    """The data set in place of what path holds; it may be made from that."""
    replace(dataset.sparkSession, path, lambda folder: dataset.write.parquet(folder))


def stable_id(value: object) -> str:
    """Content id of JSON-like configuration: keys sorted, compact."""
    return hashlib.blake2b(json.dumps(value, sort_keys=True, separators=(",", ":")).encode(), digest_size=16).hexdigest()


def write_manifest(spark, path: str, stage: str, signature: dict) -> None:
    """A stage's signature as one small JSON table beside its output."""
    spark.createDataFrame([(stage, stable_id(signature), json.dumps(signature, sort_keys=True))], "stage string, id string, signature string").coalesce(1).write.mode("overwrite").json(path)


def reusable(spark, manifest: str, signature: dict) -> bool:
    """Whether a manifest there has this signature."""
    try:
        rows = spark.read.schema("stage string, id string, signature string").json(manifest).select("id").take(1)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return False
        raise
    return bool(rows) and rows[0][0] == stable_id(signature)


def diarization_json(turns: DataFrame) -> DataFrame:
    """session, json: the turns of each file of a session as one object, in order of time. turns: session, file, start, end, speaker."""
    by_file = turns.groupBy("session", "file").agg(F.array_sort(F.collect_list(F.struct("start", "end", "speaker"))).alias("turns"))
    return by_file.groupBy("session").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("file", "turns")))).alias("m")).select("session", F.to_json("m").alias("json"))


def save_outputs(segments: DataFrame, path: str, turns: DataFrame | None = None, exclusive: DataFrame | None = None) -> None:
    """All outputs of transcribed segments (file, start, end, speaker, text) below path: text, subtitles, JSON lines and, where given, both kinds of turns."""
    write_transcript(segments, f"{path}/txt")
    write_srt(segments, f"{path}/srt")
    write_jsonl(segments, f"{path}/jsonl")
    for name, table in (("diarization", turns), ("exclusive_diarization", exclusive)):
        if table is not None:
            rows = diarization_json(table).select("session", F.col("json").alias("value"))
            replace(segments.sparkSession, f"{path}/{name}", lambda folder, rows=rows: rows.write.partitionBy("session").text(folder))


def match_report(candidates: DataFrame, matches: DataFrame) -> DataFrame:
    """session, json: what the bank said of each segment, for people to read. candidates: session, seg_idx, rank, speaker, score; matches: session, seg_idx, speaker, matched."""
    c = candidates.groupBy("session", "seg_idx").agg(F.array_sort(F.collect_list(F.struct("rank", "speaker", "score"))).alias("candidates"))
    rows = c.join(matches.where("matched").select("session", "seg_idx", F.col("speaker").alias("match")), ["session", "seg_idx"], "left")
    return rows.groupBy("session").agg(F.to_json(F.array_sort(F.collect_list(F.struct("seg_idx", "match", "candidates")))).alias("json"))


def log_metrics(spark, path: str, stage: str, status: str, session: str | None = None, elapsed_seconds: float | None = None, rows: int | None = None) -> None:
    """One more line in the stage log that streaming.watch.stage_alarms reads: memory, CPU seconds and bytes of the driver's process too."""
    import resource

    used = resource.getrusage(resource.RUSAGE_SELF)
    cells = (stage, status, session, elapsed_seconds, used.ru_maxrss * 1024, used.ru_utime + used.ru_stime, used.ru_inblock * 512, used.ru_oublock * 512, rows)
    row = spark.createDataFrame([cells], "stage string, status string, session string, elapsed_seconds double, rss_bytes long, cpu_seconds double, read_bytes long, write_bytes long, rows long")
    row.select(F.current_timestamp().alias("timestamp"), "*").coalesce(1).write.mode("append").json(path)


def set_state(spark, path: str, inputs: DataFrame, state: str) -> None:
    """Append the state of inputs (path) to the status table; the latest counts."""
    inputs.select("path", F.lit(state).alias("state"), F.current_timestamp().alias("at")).write.mode("append").parquet(path)


def states(spark, path: str, without: tuple[str, ...] = ()) -> DataFrame:
    """path, state: the latest state of each input, but for those named; none where nothing was written yet."""
    try:
        rows = spark.read.schema("path string, state string, at timestamp").parquet(path)
        rows.isEmpty()
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        rows = spark.createDataFrame([], "path string, state string, at timestamp")
    rows = rows.where(~F.col("state").isin(*without)) if without else rows
    return rows.groupBy("path").agg(F.max_by("state", "at").alias("state"))


def cached_stage(spark, folder: str, stage: str, signature: dict, build, fresh: bool = False) -> DataFrame:
    """The stage's table in folder if it was made with this signature (and fresh isn't asked for); else build() takes its place, its manifest last.

    build() may read the table that is there.
    """
    table, manifest = f"{folder}/{stage}/data", f"{folder}/{stage}/manifest"
    if fresh or not reusable(spark, manifest, signature):
        delete(spark, manifest)  # from here on there is no stage that could be taken for an older one
        replace(spark, table, lambda path: build().write.parquet(path))
        write_manifest(spark, manifest, stage, signature)
    return spark.read.parquet(table)
