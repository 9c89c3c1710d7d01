"""Finding inputs in a listing of files: what to read, which transcript belongs to it, what is done already. A listing has a column path."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions.text import SESSION, path_parts, session_keys, session_number, stem, watch_name
from parlance.sources.readers import AUDIO
from parlance.tables import materialize

#: Fixed folders that are never watched.
IGNORED = ("processed", "quarantine", ".cache", "outputs")
#: Fixed points of a transcript's likeness to a source, and the least that is accepted.
POINTS = {"jsonl": 40.0, "txt": 20.0, "same stem": 200.0, "same parent": 120.0, "session": 100.0, "parent session": 60.0, "name holds it": 30.0, "parent holds it": 20.0}
PENALTIES = {"copy of": 40.0, "overview": 30.0, "test": 20.0, "(1)": 15.0}
LEAST = 80.0
#: Characters of a name's beginning by which files that hold it are found, and the number of such beginnings that all tasks are told.
HEAD = 4
BROADCAST_HEADS = 100_000


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def glob_pattern(glob: str) -> str:
    """The regular expression of a glob that is matched from the right, part by part; * and ? stay within a part."""
    parts = ["".join("[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c) for c in p) for p in glob.strip("/").split("/")]
    return ("^" if glob.startswith("/") else "(^|/)") + "/".join(parts) + "$"


def candidate_media(files: DataFrame, exclude: list[str] | None = None) -> DataFrame:
    """Archives and sound files outside ignored folders that no glob excludes."""
    folders = F.slice(F.split("path", "/"), F.lit(1), F.size(F.split("path", "/")) - 1)
    keep = ~F.arrays_overlap(folders, F.array(*map(F.lit, IGNORED))) & suffix(F.col("path")).isin("zip", *AUDIO)
    for glob in exclude or []:
        keep = keep & ~F.col("path").rlike(glob_pattern(glob))
    return files.where(keep)


def session_sources(files: DataFrame, root: str) -> DataFrame:
    """source, kind of the archives named like a session below root, and of its folders named so that hold sound; root itself where there are none."""
    below = files.where(F.col("path").startswith(root.rstrip("/") + "/"))
    rest = F.substring("path", len(root.rstrip("/")) + 2, 1 << 30)
    archives = below.where((suffix(F.col("path")) == "zip") & stem(F.col("path")).rlike(SESSION)).select(F.col("path").alias("source"), F.lit("archive").alias("kind"))
    child = F.split(rest, "/")[0]
    sound = below.where(suffix(F.col("path")).isin(*AUDIO))
    folders = sound.where((F.size(F.split(rest, "/")) > 1) & child.rlike(SESSION)).select(F.concat(F.lit(root.rstrip("/") + "/"), child).alias("source"), F.lit("folder").alias("kind"))
    found = archives.unionByName(folders).distinct()
    if not found.isEmpty():
        return found
    return sound.limit(1).select(F.lit(root).alias("source"), F.lit("root").alias("kind"))


def _points(path: Column, number: Column) -> Column:
    """Points of a transcript at path for its kind and the session's number, without those for names; null if it is neither .jsonl nor .txt."""
    own, name, parent, _ = (F.lower(x) for x in path_parts(path))
    points = F.when(suffix(path) == "jsonl", POINTS["jsonl"]).when(suffix(path) == "txt", POINTS["txt"])
    points = points + _add(session_number(own) == number, "session") + _add(session_number(parent) == number, "parent session")
    for word, lost in PENALTIES.items():
        points = points - F.when(F.contains(name, F.lit(word)), lost).otherwise(0.0)
    return points


def _add(cond: Column, key: str) -> Column:
    return F.when(F.coalesce(cond, F.lit(False)), POINTS[key]).otherwise(0.0)


def _number(wanted: Column) -> Column:
    return F.when(wanted.rlike("(?i)session"), session_number(wanted))


def likeness(path: Column, wanted: Column) -> Column:
    """Points of a transcript at path for a source whose stem is wanted; null if it is neither .jsonl nor .txt."""
    own, name, parent, _ = (F.lower(x) for x in path_parts(path))
    names = _variants(wanted)
    points = _points(path, _number(wanted)) + _add(F.array_contains(names, own), "same stem") + _add(F.array_contains(names, parent), "same parent")
    held = lambda where: F.size(F.filter(names, lambda n: (n != "") & F.contains(where, n)))
    return points + held(name) * POINTS["name holds it"] + held(parent) * POINTS["parent holds it"]


def _variants(wanted: Column) -> Column:
    return F.array_distinct(F.array(*[F.lower(x) for x in (wanted, F.regexp_replace(wanted, "_", " "), F.regexp_replace(wanted, " ", "_"))]))


def transcript_of(sources: DataFrame, files: DataFrame) -> DataFrame:
    """source, transcript, points: the likeliest transcript of each source (the first path on ties), if it has enough points.

    A file has enough points only if it shares the session's number with the source, or if its name or its folder's holds one of the source's names. Of the files that only share
    the number, the one with the most points serves every source of that number. Files that hold a name are joined on the whole name: a file gives the parts of its two
    names that begin like some source's name and are as long. So a source meets one file, and those that hold its name.
    """
    s = materialize(sources.select("source", stem(F.col("source")).alias("wanted")), "sources")
    wanted = s.select("wanted").where("wanted is not null").distinct()
    texts = materialize(files.where(suffix(F.col("path")).isin("jsonl", "txt")).select("path").distinct(), "transcripts")
    own, name, parent, _ = path_parts(F.col("path"))
    shared = texts.select("path", F.explode(F.array_distinct(F.array(session_number(F.lower(own)), session_number(F.lower(parent))))).alias("number")).where("number is not null")
    shared = shared.groupBy("number").agg(F.min_by("path", F.struct(-_points(F.col("path"), F.col("number")), "path")).alias("path"))
    by_number = wanted.select("wanted", _number(F.col("wanted")).alias("number")).join(shared, "number").select("wanted", "path")
    names = wanted.select("wanted", F.explode(_variants(F.col("wanted"))).alias("key")).where("key <> ''")
    names = materialize(names.select("*", F.length("key").alias("n")), "names")
    # how names begin; where there are too many such beginnings, only how long names are
    begin = lambda size: names.select(F.left("key", F.lit(size)).alias("head"), "n").distinct()
    heads, size = begin(HEAD), HEAD
    if heads.count() > BROADCAST_HEADS:
        heads, size = begin(0), 0
    sizes = F.array(*[F.lit(r[0]) for r in heads.select(F.length("head")).distinct().collect()] or [F.lit(0)])  # HEAD + 1 values at most
    places = texts.select("path", F.explode(F.array_distinct(F.array(F.lower(name), F.lower(parent)))).alias("x")).where("x <> ''")
    places = places.select("path", "x", F.explode(F.sequence(F.lit(1), F.length("x"))).alias("i")).select("*", F.explode(sizes).alias("size")) if size else places.select("path", "x", F.explode(F.sequence(F.lit(1), F.length("x"))).alias("i"), F.lit(0).alias("size"))
    parts = places.withColumn("head", F.substr("x", F.col("i"), F.col("size"))).join(F.broadcast(heads), "head").where("n <= length(x) - i + 1")
    parts = parts.select("path", F.substr("x", F.col("i"), F.col("n")).alias("key"))
    # parts are many more than Spark expects of them, so they are never to be broadcast
    pairs = by_number.unionByName(names.join(parts.hint("merge"), "key").select("wanted", "path"))
    scored = pairs.withColumn("points", likeness(F.col("path"), F.col("wanted"))).where(F.col("points") >= LEAST)
    best = scored.groupBy("wanted").agg(F.min_by(F.struct("path", "points"), F.struct(-F.col("points"), "path")).alias("b"))
    return s.select("source", "wanted").distinct().join(best, "wanted").select("source", F.col("b.path").alias("transcript"), F.col("b.points").alias("points"))


def segment_artifacts(audio: DataFrame, files: DataFrame, prefer: str = "auto") -> DataFrame:
    """path, artifact: the first that exists of a sound file's segment files, in fixed order."""
    base = stem(F.col("path"))
    kinds = [(".jsonl", ("auto", "session_jsonl")), (".diarization.json", ("auto", "diarization_json")), (".json", ("auto", "diarization_json"))]
    names = F.array(*[F.concat(F.lit(".outputs/"), base, F.lit("/"), base, F.lit(k)) for k, where in kinds if prefer in where])
    wanted = audio.select("path", F.posexplode(names).alias("place", "artifact"))
    there = wanted.join(files.select(F.col("path").alias("artifact")).distinct(), "artifact", "left_semi")
    return there.groupBy("path").agg(F.min_by("artifact", "place").alias("artifact"))


def segments_of_audio(segments: DataFrame, audio: DataFrame) -> DataFrame:
    """segments (file, ...) with the sound file they belong to: by name, else by stem."""
    name = F.regexp_replace("file", "^.*/", "")
    a = audio.select(F.col("path").alias("audio"), F.explode(F.array_distinct(F.array(F.regexp_replace("path", "^.*/", ""), stem(F.col("path"))))).alias("name"))
    s = segments.withColumn("name", F.explode(F.array_distinct(F.array(name, stem(name)))))
    return s.where("name <> ''").join(a, "name").drop("name").distinct()


def already_done(inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """path, done: inputs with the first output that carries one of their session keys or, where they have none, their name."""
    keyed = lambda df, name: df.select(F.col("path").alias(name), session_keys(F.col("path")).alias("keys"), watch_name(stem(F.col("path"))).alias("plain"))
    i, o = keyed(inputs.distinct(), "path"), keyed(outputs.distinct(), "done")
    by_key = i.select("path", F.explode("keys").alias("key")).join(o.select("done", F.explode("keys").alias("key")), "key").select("path", "done")
    by_name = i.where(F.size("keys") == 0).join(o.select("done", "plain"), "plain").select("path", "done")
    return by_key.unionByName(by_name).groupBy("path").agg(F.min("done").alias("done"))


def archive_moves(inputs: DataFrame, archived: DataFrame, folder: str) -> DataFrame:
    """path, target: where processed inputs go. A taken name gets the next free number: 'x', 'x__2', 'x__3', ...; inputs of one name are numbered among themselves."""
    from parlance.operators.lines import Line

    name, kind = stem(F.col("path")), F.regexp_extract("path", r"(\.[^./]+)$", 1)
    taken = archived.select(F.regexp_extract(stem(F.col("path")), r"^(.*?)(?:__(\d+))?$", 1).alias("name"), F.coalesce(F.nullif(F.regexp_extract(stem(F.col("path")), r"^(.*?)(?:__(\d+))?$", 2), F.lit("")).cast("int"), F.lit(1)).alias("number"))
    i = materialize(inputs.select("path", name.alias("name"), kind.alias("kind")).distinct().withColumn("at", F.row_number().over(Window.partitionBy("name").orderBy("path"))), "inputs")
    # the n-th taken number (from 0) less n is how many places lie before it, so the number of a place is that place and the taken ones of at most as much
    used = taken.where("number > 0").distinct().withColumn("at", F.col("number") - F.row_number().over(Window.partitionBy("name").orderBy("number")) + 1)
    none = F.lit(None).cast("string")
    both = used.join(i.select("name").distinct(), "name", "left_semi").select("name", none.alias("path"), none.alias("kind"), F.col("at").cast("long").alias("at"), F.lit(0).alias("_input")).unionByName(i.withColumns({"at": F.col("at").cast("long"), "_input": F.lit(1)}))
    line = Line(both, ["name"], ["at", "_input", "path"])
    i = line.done(line.running(line.rows, "before", 1 - F.col("_input"), "sum")).where("_input = 1").withColumn("number", F.col("at") + F.col("before"))
    end = F.when(F.col("number") == 1, "").otherwise(F.concat(F.lit("__"), F.col("number").cast("string")))
    return i.select("path", F.concat(F.lit(folder.rstrip("/") + "/"), "name", end, "kind").alias("target"))


def file_identity(files: DataFrame) -> DataFrame:
    """path, id: by path, length and time; by content too where it was read (binaryFile)."""
    own = [F.col(c).cast("string") for c in ("path", "length", "modificationTime")]
    content = [F.sha2("content", 256)] if "content" in files.columns else []
    return files.select("path", F.sha2(F.concat_ws("|", *own, *content), 256).alias("id"))


def folder_identity(files: DataFrame, depth: int) -> DataFrame:
    """folder, files, id of the folders `depth` parts deep, by the identities of all files below; the order of the listing doesn't matter."""
    own = file_identity(files)
    folder = F.array_join(F.slice(F.split("path", "/"), 1, depth), "/")
    below = own.where(F.size(F.split("path", "/")) > depth).select(folder.alias("folder"), "path", "id")
    # sums of hashes, added up before they meet: a folder of a third of all files is no single task's
    part = lambda seed: F.bit_xor(F.xxhash64(F.lit(seed), "path", "id"))
    by = below.groupBy("folder").agg(F.count("*").alias("files"), part(1).alias("x"), part(2).alias("y"))
    return by.select("folder", "files", F.sha2(F.concat_ws("|", F.col("files").cast("string"), F.col("x").cast("string"), F.col("y").cast("string")), 256).alias("id"))


def bundles(inputs: DataFrame, files: DataFrame) -> DataFrame:
    """path, head: each input with itself and, for an archive, the .json of the same name beside it, if the listing has it."""
    own = inputs.select("path", F.col("path").alias("head")).distinct()
    beside = own.where(suffix(F.col("path")) == "zip").select(F.regexp_replace("path", r"\.[^./]+$", ".json").alias("path"), "head")
    return own.unionByName(beside.join(files.select("path").distinct(), "path", "left_semi"))


def bundle_moves(inputs: DataFrame, files: DataFrame, archived: DataFrame, folder: str) -> DataFrame:
    """path, target of inputs and what belongs to them: a bundle moves under one new name, the first that none of its files finds taken."""
    heads = archive_moves(inputs, archived, folder).select(F.col("path").alias("head"), F.regexp_replace("target", r"\.[^./]+$", "").alias("stem"))
    return bundles(inputs, files).join(heads, "head").select("path", F.concat("stem", F.regexp_extract("path", r"(\.[^./]+)$", 1)).alias("target"))


def failing(status: DataFrame, most: int = 3) -> DataFrame:
    """path, failures of inputs that failed `most` times or more since they last succeeded: for the quarantine. status: path, state, at."""
    good = status.where(~F.col("state").isin("failed", "started")).groupBy("path").agg(F.max("at").alias("good"))
    bad = status.where("state = 'failed'").join(good, "path", "left").where("good is null or at > good")
    return bad.groupBy("path").agg(F.count("*").alias("failures")).where(F.col("failures") >= most)


def moved(moves: DataFrame) -> DataFrame:
    """path, target, outcome of renaming every path to its target: moved, there (an earlier try did it), missing, taken (something else has that name).

    The renames are tasks' work, in any store that pyarrow knows; a task that runs again finds what is done and leaves it. Nothing is overwritten.
    """

    def run(batches):
        import pandas as pd
        from pyarrow import fs

        for b in batches:
            said = []
            for path, target in zip(b["path"], b["target"], strict=True):
                store, here = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
                there = fs.FileSystem.from_uri(target)[1] if "://" in target else target
                a, z = (i.type != fs.FileType.NotFound for i in store.get_file_info([here, there]))
                if a and not z:
                    store.create_dir(there.rsplit("/", 1)[0], recursive=True)
                    store.move(here, there)
                said.append("moved" if a and not z else "taken" if a else "there" if z else "missing")
            yield pd.DataFrame({"path": b["path"], "target": b["target"], "outcome": said})

    return moves.select("path", "target").mapInPandas(run, "path string, target string, outcome string")
