"""From labelled records and their tracks to a saved classifier, in one call."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.operators import bank as B
from parlance.operators import classifier as C
from parlance.operators import datasets as D
from parlance.tables import materialize


def track_dataset(records: DataFrame, stems: DataFrame, embed: Callable, least: float = 0.8, most: float = 15.0, per_speaker: int = 500, size: float = 0.0, stride: float = 0.0, pad: float = 0.0) -> DataFrame:
    """row_id, label, domain, source, session, duration, dominant_share, active_speakers, start, end, embedding of clean segments of speakers that have a track.

    records: session, seg_idx, start, end, speaker; stems: speaker, and what embed needs to find the sound (joined to the rows); embed: as operators.bank.embedded takes it. A track holds one
    speaker, so the dominant share is 1 and one speaker is active.
    """
    rows = D.clean_segments(records, stems, least, most, per_speaker, size, stride)
    index = F.col("window_index") if "window_index" in rows.columns else F.lit(0).cast("long")
    extra = [c for c in stems.columns if c != "speaker"]
    rows = rows.select("session", "seg_idx", index.alias("window_index"), "speaker", "start", "end").join(stems.dropDuplicates(["speaker"]), "speaker")
    found = B.embedded(rows, embed, least=0.0, pad=pad)
    out = found.select(
        F.xxhash64("session", "seg_idx", "window_index").alias("row_id"), F.col("speaker").alias("label"), F.lit("clean").alias("domain"), F.lit("multitrack").alias("source"), "session",
        (F.col("end") - F.col("start")).alias("duration"), F.lit(1.0).alias("dominant_share"), F.lit(1).alias("active_speakers"), "start", "end", *extra, "embedding",
    )
    return out.drop(*extra)


def train_from_tracks(records: DataFrame, stems: DataFrame, embed: Callable, path: str, holdout: DataFrame | None = None, more: DataFrame | None = None, targets: list[str] | None = None, cap: int = 500, model: str = "logreg", dataset_options: dict | None = None, **options) -> tuple[C.Classifier, DataFrame]:
    """(classifier saved at path, the data set it was fitted on): tracks, and `more` rows of the same columns, without held-out sessions, balanced over the targets where given.

    holdout: session; sessions in it are left out before anything is embedded, and the result is checked for them.
    """
    spark = records.sparkSession
    known = records if holdout is None else records.join(holdout.select("session").distinct(), "session", "left_anti")
    rows = track_dataset(known, stems, embed, **(dataset_options or {}))
    if more is not None:
        rows = D.appended(rows, more if holdout is None else more.join(holdout.select("session").distinct(), "session", "left_anti"))
    rows = materialize(rows, "dataset")
    if targets:
        rows = materialize(D.balanced(rows, targets, cap), "balanced")
    if holdout is not None:
        D.assert_disjoint(rows, holdout)
    fitted = C.train_from_dataset(rows.select(F.col("row_id").alias("entry_idx"), "label", "embedding"), spark, path, source="multitrack", model=model, **options)
    return fitted, rows
