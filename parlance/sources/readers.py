"""Readers of segments, words, transcripts and data sets. Paths go to Spark unchanged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parlance.functions.text import stem, transcript_line, word_count

WORD = "struct<start:double,end:double,word:string,score:double,speaker:string,speaker_raw:string>"
SEGMENT = f"file string, start double, end double, speaker string, speaker_raw string, text string, words array<{WORD}>"
#: Fixed sound file suffixes.
AUDIO = ("wav", "mp3", "ogg", "flac", "m4a")


def _segments(df: DataFrame, file) -> DataFrame:
    zero = F.lit(0.0)
    return df.select(F.coalesce("file", file).alias("file"), F.coalesce("start", zero).alias("start"), F.coalesce("end", zero).alias("end"), "speaker", F.coalesce("speaker_raw", "speaker").alias("speaker_raw"), "text", "words")


def read_segments_jsonl(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """One segment a line. Lines that aren't JSON are left out, or an error if strict; file defaults to the stem of the path."""
    if strict:
        df = spark.read.schema(SEGMENT).option("mode", "FAILFAST").json(path)
    else:
        df = spark.read.schema(f"{SEGMENT}, _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path).where("_bad is null").drop("_bad")
    return _segments(df, stem(F.input_file_name()))


def read_segments_json(spark: SparkSession, path: str) -> DataFrame:
    """A whole file: {file: [segment, ...]} or a bare list; values that aren't lists are left out."""
    element = f"struct<{', '.join(x.replace(' ', ':', 1) for x in SEGMENT.replace(f'words array<{WORD}>', f'words:array<{WORD}>').split(', ') if not x.startswith('words'))}, words:array<{WORD}>>"
    whole = spark.read.text(path, wholetext=True).select(F.trim("value").alias("v"), F.input_file_name().alias("f"))
    bare = whole.where("v like '[%'").select("f", F.lit(None).cast("string").alias("name"), F.from_json("v", f"array<{element}>").alias("s"))
    keyed = whole.where("v like '{%'").select("f", F.explode(F.from_json("v", "map<string,string>")).alias("name", "x")).where("trim(x) like '[%'").select("f", "name", F.from_json("x", f"array<{element}>").alias("s"))
    rows = bare.unionByName(keyed).select("f", "name", F.inline("s"))
    return _segments(rows, F.coalesce("name", stem(F.col("f"))))


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    if path.endswith(".jsonl"):
        return read_segments_jsonl(spark, path)
    if path.endswith(".json"):
        return read_segments_json(spark, path)
    raise ValueError(f"neither .json nor .jsonl: {path}")


def read_timed_transcript(spark: SparkSession, path: str) -> DataFrame:
    """file, speaker, start, end, text of timed lines. A line ends where the next begins, if later; else after 0.35 s a word, 1 to 15 s."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "line"))
    rows = whole.withColumn("p", transcript_line(F.trim("line"))).where("p is not null").select("file", "line_no", "p.*")
    after = F.lead("start").over(Window.partitionBy("file").orderBy("line_no"))
    guess = F.col("start") + F.greatest(F.lit(1.0), F.least(F.lit(15.0), 0.35 * word_count(F.col("text"))))
    return rows.withColumn("end", F.when(after > F.col("start"), after).otherwise(guess)).select("file", "line_no", "speaker", "start", "end", "text")


def words_of(segments: DataFrame) -> DataFrame:
    """Timed words of nested segments, with the segment's speaker where theirs is missing; untimed, blank and unlabelled ones go."""
    w = segments.select("file", F.col("speaker").alias("own"), F.explode("words").alias("w"))
    w = w.select("file", F.coalesce("w.speaker", "own").alias("speaker"), "w.start", "w.end", F.trim("w.word").alias("text"))
    return w.where("start is not null and end is not null and text <> '' and speaker <> ''")


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    """A training set; columns that older files lack get their defaults, sentinels become null."""
    df = spark.read.option("mergeSchema", "true").parquet(path)
    for name, default in (("domain", "mixed"), ("source", "mixed_raw"), ("session", "unknown")):
        df = df.withColumn(name, F.coalesce(F.col(name), F.lit(default)) if name in df.columns else F.lit(default))
    for name in ("duration", "dominant_share", "top1_power", "top2_power"):
        df = df.withColumn(name, F.when(~F.isnan(name), F.col(name)) if name in df.columns else F.lit(None).cast("double"))
    return df.withColumn("active_speakers", F.when(F.col("active_speakers") >= 0, F.col("active_speakers")) if "active_speakers" in df.columns else F.lit(None).cast("int"))


def audio_files(spark: SparkSession, path: str) -> DataFrame:
    """path, length, modificationTime, content of sound files below path."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(AUDIO) + "}").load(path)


def zip_members(spark: SparkSession, path: str) -> DataFrame:
    """archive, member, content of the sound files in archives; members that would leave the archive's folder are an error."""

    def members(batches):
        import io
        import posixpath
        import zipfile

        import pandas as pd

        for b in batches:
            for name, data in zip(b["path"], b["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    for m in z.namelist():
                        if m.startswith("/") or posixpath.normpath(m).startswith(".."):
                            raise ValueError(f"{m} leaves {name}")
                        if m.rsplit(".", 1)[-1].lower() in AUDIO:
                            yield pd.DataFrame({"archive": [name], "member": [m], "content": [z.read(m)]})

    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("path", "content")
    return found.mapInPandas(members, "archive string, member string, content binary")


def missing_parts(files: DataFrame) -> DataFrame:
    """session, part for every part k of n that isn't there. files: session, part, total."""
    wanted = files.groupBy("session").agg(F.max("total").alias("total")).select("session", F.explode(F.sequence(F.lit(1), F.col("total"))).alias("part"))
    return wanted.join(files.select("session", "part"), ["session", "part"], "left_anti")


def missing(e: Exception) -> bool:
    """Whether a read failed because nothing is there."""
    return "PATH_NOT_FOUND" in str(e)


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a given schema: a line that isn't JSON is an error, a path with nothing there is an empty table."""
    try:
        df = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
        df.isEmpty()
        return df
    except Exception as e:
        if missing(e):
            return spark.createDataFrame([], schema)
        raise


MAPPING = "ord int, key string, value string"


def read_mapping(spark: SparkSession, path: str) -> DataFrame:
    """ord, key, value of one JSON or YAML object of strings, in the file's order; an empty file has none, one that can't be read is an error. Configuration: one file, read as a whole."""
    if path.lower().endswith((".yaml", ".yml")):
        return _read_yaml(spark, path)
    text = spark.read.text(path, wholetext=True).select(F.trim("value").alias("v")).where("v <> ''")
    items = F.filter(F.regexp_extract_all("v", F.lit(r'"((?:[^"\\]|\\.)*)"\s*:'), F.lit(1)), lambda k: k != "")
    return text.select(F.from_json("v", "map<string,string>").alias("m"), F.posexplode(items).alias("ord", "key")).select("ord", "key", F.col("m")[F.col("key")].alias("value")).where("value is not null")


def _read_yaml(spark: SparkSession, path: str) -> DataFrame:
    try:
        import yaml
    except ImportError as e:
        raise ImportError("mappings in YAML need the yaml package; JSON ones don't") from e
    text = "".join(r[0] for r in spark.read.text(path, wholetext=True).limit(1).collect())
    try:
        found = yaml.safe_load(text) or {}
    except yaml.YAMLError as e:
        raise ValueError(f"{path} can't be read as YAML: {e}") from e
    if not isinstance(found, dict):
        raise ValueError(f"{path} holds no mapping")
    rows = [(i, str(k), str(v)) for i, (k, v) in enumerate(found.items()) if v is not None and not isinstance(v, (dict, list))]
    return spark.createDataFrame(rows, MAPPING)


def canonical(records: DataFrame, aliases: dict[str, str] | None = None, mapping: DataFrame | None = None) -> DataFrame:
    """records with speaker set by the aliases (any case), else by the mapping, else left; speaker_raw keeps the first name."""
    known = {k.strip().lower(): v for k, v in (aliases or {}).items()}
    name = F.lower(F.trim("speaker"))
    alias = F.create_map(*[F.lit(x) for kv in sorted(known.items()) for x in kv])[name] if known else F.lit(None).cast("string")
    raw = F.coalesce("speaker_raw", "speaker") if "speaker_raw" in records.columns else F.col("speaker")
    rows = records.withColumns({"_alias": alias, "speaker_raw": raw})
    mapped = with_mapping(rows, mapping) if mapping is not None else rows
    return mapped.withColumn("speaker", F.coalesce("_alias", "speaker")).drop("_alias")


def read_labelled_records(spark: SparkSession, path: str, aliases: dict[str, str] | None = None, mapping: DataFrame | None = None) -> DataFrame:
    """file, start, end, speaker, speaker_raw, text of labelled lines: JSON lines by the suffix .jsonl (a line that isn't JSON is an error), timed text otherwise; speakers made canonical()."""
    if path.lower().endswith(".jsonl"):
        rows = read_segments_jsonl(spark, path, strict=True).drop("words")
    else:
        rows = read_timed_transcript(spark, path).select("file", "start", "end", "speaker", F.col("speaker").alias("speaker_raw"), "text")
    return canonical(rows, aliases, mapping)


def _listed(text: Column) -> Column:
    """The items of a JSON array, or of an object's array `segments`, as texts; empty for an object without; null for anything else."""
    inner = F.get_json_object(text, "$.segments")
    items = lambda x: F.from_json(x, "array<string>")
    return F.when(F.ltrim(text).startswith("["), items(text)).when(F.ltrim(text).startswith("{"), F.when(F.ltrim(inner).startswith("["), items(inner)).otherwise(F.array().cast("array<string>")))


def normalised_payloads(entries: DataFrame) -> DataFrame:
    """file, segments (array of objects as JSON text) of payloads in any known shape; entries of another shape go, as do segments that are no objects.

    entries: value, one JSON text each: [file, segments] or {file: segments}, where segments is an array or an object with an array of that name.
    """
    pair, keyed = F.from_json("value", "array<string>"), F.from_json("value", "map<string,string>")
    is_pair = F.ltrim("value").startswith("[") & (F.size(pair) == 2)
    is_keyed = F.ltrim("value").startswith("{") & (F.size(keyed) == 1)
    rows = entries.select(F.when(is_pair, pair[0]).when(is_keyed, F.map_keys(keyed)[0]).alias("file"), F.when(is_pair, pair[1]).when(is_keyed, F.map_values(keyed)[0]).alias("body"))
    rows = rows.where("file is not null").select("file", _listed(F.col("body")).alias("items")).where("items is not null")
    return rows.select("file", F.filter("items", lambda x: F.ltrim(x).startswith("{")).alias("segments"))


def payload_segments(entries: DataFrame) -> DataFrame:
    """The segments of normalised_payloads(), as the readers give them."""
    element = f"struct<{', '.join(x.replace(' ', ':', 1) for x in SEGMENT.replace(f'words array<{WORD}>', '').rstrip(', ').split(', '))}, words:array<{WORD}>>"
    rows = normalised_payloads(entries).select(F.col("file").alias("name"), F.explode("segments").alias("x")).select("name", F.from_json("x", element).alias("s")).select("name", "s.*")
    return _segments(rows, F.col("name"))


def normalised_turns(payload: DataFrame, kept: DataFrame) -> DataFrame:
    """file, turns (array of JSON objects) of the kept files that have any. payload: value, one JSON object of files; kept: file."""
    rows = payload.select(F.explode(F.from_json("value", "map<string,string>")).alias("file", "body")).select("file", _listed(F.col("body")).alias("items"))
    turns = rows.select("file", F.filter("items", lambda x: F.ltrim(x).startswith("{")).alias("turns")).where(F.size("turns") > 0)
    return turns.join(kept.select("file").distinct(), "file", "left_semi")


def with_mapping(segments: DataFrame, mapping: DataFrame) -> DataFrame:
    """segments with canonical speakers; what the mapping doesn't know stays as it was, in speaker_raw too."""
    from parlance.operators.names import resolved_labels

    names = segments.select(F.coalesce("speaker", F.lit("")).alias("name")).distinct()
    known = resolved_labels(names.withColumn("id", F.col("name")), "id", "name", mapping).select(F.col("id").alias("_name"), "label")
    out = segments.join(known, F.coalesce("speaker", F.lit("")) == F.col("_name"), "left")
    return out.select(*[F.col("label").alias(c) if c == "speaker" else F.coalesce("speaker_raw", "speaker").alias(c) if c == "speaker_raw" else F.col(c) for c in segments.columns])


def gather_inputs(spark: SparkSession, path: str) -> DataFrame:
    """file, content: the sound files of a folder, of archives in it, of one archive, or one sound file; in order of name they are the tracks of a session."""
    if path.lower().endswith(".zip"):
        return zip_members(spark, path).select(F.col("member").alias("file"), "content")
    if path.rsplit(".", 1)[-1].lower() in AUDIO:
        return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content")
    return audio_files(spark, path).select(F.col("path").alias("file"), "content").unionByName(zip_members(spark, path).select(F.concat_ws("!", "archive", "member").alias("file"), "content"))
