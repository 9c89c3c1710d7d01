"""Recognisers, banks and classifiers of one's own, plugged in as table functions: whatever has the method is taken.

An engine is named by `module:maker`; each task makes its own by calling it, so nothing heavy travels with the plan. A recogniser has
`transcribe(path, content) -> segments` (mappings with start, end, text, speaker and words); a bank or classifier has `score_candidates(vector) -> candidates` (mappings with speaker and score).
"""

from __future__ import annotations

import importlib
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORDS = "path string, seg_idx long, word_idx long, speaker string, word string, start double, end double, text string, seg_start double, seg_end double, error string"


@lru_cache(maxsize=8)
def engine(name: str):
    """What `module:maker` makes, once a process."""
    module, _, maker = name.partition(":")
    return getattr(importlib.import_module(module), maker)()


class Transcriber:
    """The table function: rows (path, content, engine) of one file after the other to a row a word; a segment without words is one row without a word."""

    def eval(self, row) -> Iterator[tuple]:
        no = (None,) * 9
        try:
            segments = engine(row["engine"]).transcribe(row["path"], row["content"])
            for i, s in enumerate(segments):
                head = (s.get("text"), float(s["start"]), float(s["end"]), None)
                words = s.get("words") or []
                for j, w in enumerate(words):
                    yield (row["path"], i, j, w.get("speaker") or s.get("speaker"), w.get("word"), float(w["start"]), float(w["end"]), *head)
                if not words:
                    yield (row["path"], i, None, s.get("speaker"), None, float(s["start"]), float(s["end"]), *head)
        except Exception as e:  # one file that can't be read doesn't stop the others: it is a row that says so
            yield (row["path"], *no, f"{type(e).__name__}: {e}"[:500])


def transcribed(files: DataFrame, name: str) -> DataFrame:
    """A row a word of every file (path, and content if there is any), by the engine `module:maker`; files that it fails on are rows with an error.

    The files are dealt by path, one file in one task at a time.
    """
    spark: SparkSession = files.sparkSession
    content = F.col("content") if "content" in files.columns else F.lit(None).cast("binary")
    asked = files.select("path", content.alias("content"), F.lit(name).alias("engine"))
    words = F.udtf(Transcriber, returnType=WORDS)
    spark.udtf.register("parlance_transcribe", words)
    return words(asked.asTable().partitionBy("path").orderBy("path"))


def segments_of(words: DataFrame) -> DataFrame:
    """file, start, end, speaker, speaker_raw, text, words: the rows of transcribed() as segments, as the readers give them."""
    word = F.struct("start", "end", "word", F.lit(None).cast("double").alias("score"), "speaker", F.lit(None).cast("string").alias("speaker_raw"))
    by = words.where("error is null").groupBy("path", "seg_idx").agg(
        F.first("seg_start").alias("start"), F.first("seg_end").alias("end"), F.min_by("speaker", F.coalesce("word_idx", F.lit(-1))).alias("speaker"), F.first("text").alias("text"),
        F.array_sort(F.collect_list(F.when(F.col("word").isNotNull(), F.struct("word_idx", word.alias("w"))))).alias("ws"),
    )
    return by.select(F.col("path").alias("file"), "start", "end", "speaker", F.col("speaker").alias("speaker_raw"), "text", F.transform("ws", lambda x: x["w"]).alias("words"))


def scored_by(segments: DataFrame, name: str) -> DataFrame:
    """session, seg_idx, rank, speaker, score of every segment (session, seg_idx, embedding), by the bank or classifier `module:maker`; the first name on ties."""
    kind = f"session {segments.schema['session'].dataType.simpleString()}, seg_idx long, rank long, speaker string, score double"

    def run(batches):
        import numpy as np
        import pandas as pd

        model = engine(name)
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                found = sorted(((float(c["score"]), str(c["speaker"])) for c in model.score_candidates(np.asarray(r.embedding, np.float64))), key=lambda c: (-c[0], c[1]))
                rows += [(r.session, r.seg_idx, i, speaker, score) for i, (score, speaker) in enumerate(found, 1)]
            yield pd.DataFrame(rows, columns=["session", "seg_idx", "rank", "speaker", "score"])

    return segments.where("embedding is not null").select("session", "seg_idx", "embedding").mapInPandas(run, kind)
