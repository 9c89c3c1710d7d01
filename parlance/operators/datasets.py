"""Building training sets: filters with reasons, balancing, coverage, capped mining, set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.operators.sequences import sample_evenly
from parlance.tables import materialize


def dataset_rejection(speakers: list[str] | None = None, sources: list[str] | None = None, share: float | None = None, active: int | None = None, least: float | None = None, most: float | None = None) -> Column:
    """The first reason against a sample, in fixed order; null keeps it. Unknown share or activity fails; unknown duration passes."""
    out = F.lit(None).cast("string")
    checks = [
        ("speaker", speakers and ~F.col("label").isin(speakers)),
        ("source", sources and ~F.col("source").isin(sources)),
        ("dominant_share", share is not None and ~F.coalesce(F.nanvl("dominant_share", F.lit(-1.0)) >= share, F.lit(False))),
        ("active_speakers", active is not None and ~F.coalesce((F.col("active_speakers") >= 0) & (F.col("active_speakers") <= active), F.lit(False))),
        ("min_duration", least is not None and F.coalesce(F.col("duration") < least, F.lit(False))),
        ("max_duration", most is not None and F.coalesce(F.col("duration") > most, F.lit(False))),
    ]
    for name, bad in checks:
        if bad is not None and bad is not False and not isinstance(bad, list):
            out = F.coalesce(out, F.when(bad, name))
    return out


def quality_rejection(least: float = 0.8, most: float = 0.0, clipping: float = 0.005, silence: float = 0.8) -> Column:
    c = F.col
    out = F.when(~c("decode_ok"), "decode").when(~c("finite_ok"), "non_finite").when(c("duration") < least, "too_short")
    if most > 0:
        out = out.when(c("duration") > most, "too_long")
    return out.when(c("clipping_fraction") > clipping, "clipping").when(c("silence_fraction") > silence, "silence")


def purity(least: float = 0.8, most: float = 15.0, min_power: float = 1e-6, high: float = 0.8, medium: float = 0.65) -> tuple[Column, Column]:
    """(rejection, bucket) of rows with duration, top1_power, top2_power, total_power, dominant_share."""
    c = F.col
    share = c("dominant_share")
    rejection = F.when(c("duration") < least, "too_short").when(c("duration") > most, "too_long").when(c("total_power") <= 0, "no_power").when(c("top1_power") < min_power, "low_power").when(share < high, "low_share").when(c("top1_power") <= c("top2_power"), "not_dominant")
    return rejection, F.when(share >= high, "high").when(share >= medium, "medium").otherwise("low")


def coverage(dataset: DataFrame, least_sessions: int = 3, least_ratio: float = 0.5) -> DataFrame:
    """domain, label, samples, sessions, the domain's median samples, and both warnings."""
    by = dataset.groupBy("domain", "label").agg(F.count("*").alias("samples"), F.countDistinct("session").alias("sessions"))
    by = by.withColumn("median_samples", F.median("samples").over(Window.partitionBy("domain")))
    return by.withColumn("low_session_count", F.col("sessions") < least_sessions).withColumn("low_sample_count", (F.col("median_samples") > 0) & (F.col("samples") < F.col("median_samples") * least_ratio))


def breakdown(dataset: DataFrame) -> DataFrame:
    """Counts by (source, label) and (session, label) in one pass."""
    return dataset.groupingSets([["source", "label"], ["session", "label"]], "source", "session", "label").agg(F.count("*").alias("n"))


def balanced(dataset: DataFrame, targets: list[str], cap: int = 500) -> DataFrame:
    """Equal cells: per source, every target speaker gets the smallest target's count (cap at most), evenly sampled; a source that lacks a target
    is skipped; augmented cells are no larger than the speaker's raw ones."""
    rows = dataset.where(F.col("label").isin(targets))
    cells = rows.groupBy("source", "label").agg(F.count("*").alias("n"))
    w = Window.partitionBy("source")
    cells = cells.withColumn("limit", F.least(F.min("n").over(w), F.lit(max(cap, 1)))).withColumn("labels", F.count("*").over(w)).where(F.col("labels") == len(set(targets)))
    raw = rows.where("source = 'mixed_raw'").groupBy("label").agg(F.count("*").alias("raw"))
    cells = cells.join(raw, "label", "left").withColumn("limit", F.when(F.col("source") == "mixed_aug_total", F.least("limit", F.coalesce("raw", F.lit(0)))).otherwise(F.col("limit")))
    cells = materialize(cells.select("source", "label", "limit"), "cells")
    dealt = rows.join(F.broadcast(cells) if cells.count() <= 1_000_000 else cells, ["source", "label"])
    return sample_evenly(dealt, ["source", "label"], ["row_id"], F.col("limit")).drop("limit")


def top_pairs(pairs: DataFrame, seeds: list[str], k: int) -> DataFrame:
    """Seed pairs in order, then the k commonest others (k counted before seeds are taken out)."""
    # a k-row report: only its rows are numbered in one task
    ranked = pairs.orderBy(F.desc("n"), "pair").limit(k).withColumn("r", F.row_number().over(Window.orderBy(F.desc("n"), "pair")))
    seeded = pairs.sparkSession.createDataFrame([(s, i) for i, s in enumerate(dict.fromkeys(seeds))], "pair string, place int")
    return seeded.unionByName(ranked.join(seeded, "pair", "left_anti").select("pair", (F.col("r") + len(seeds)).alias("place")))


def capped(pool: DataFrame, per_pair: int, style_target: int, per_speaker: int | None, total: int) -> DataFrame:
    """pool: pair, speaker, weight, is_style, priority, row_id. Per pair and speaker style rows first, then the others; then a cap per speaker, then in all.

    Every cap is a top-k that parts of a key take before the key is ordered.
    """
    from parlance.operators.bank import top_rows

    best, key, style = [F.desc("weight"), F.col("priority"), F.col("row_id")], ["pair", "speaker"], min(style_target, per_pair)
    # those that come first and as many more as a pair may have are among the best of a key's style rows and of its others
    some = top_rows(pool, [*key, "is_style"], best, per_pair + style, "row_id").withColumn("first", F.coalesce(F.col("is_style") & (F.col("place") < style), F.lit(False))).drop("place")
    rows = some.withColumn("r", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("first"), *best))).where(F.col("r") <= per_pair)
    if per_speaker is not None:
        rows = top_rows(rows, ["speaker"], best, per_speaker, "row_id").drop("place")
    rows = rows.select(pool.columns)
    return rows.orderBy(*best).limit(total) if total > 0 else rows


def leaks(dataset: DataFrame, holdout: DataFrame) -> DataFrame:
    """Rows whose session is held out; anything here is an error of the caller."""
    return dataset.join(holdout.select("session").distinct(), "session", "left_semi")


def assert_disjoint(dataset: DataFrame, holdout: DataFrame) -> None:
    if not leaks(dataset, holdout).isEmpty():
        raise ValueError("held-out sessions in the training set")


def bank_samples(bank: DataFrame, aliases: DataFrame, most: int) -> DataFrame:
    """Entries of a bank as training samples: entry_idx, label (aliases resolved), embedding; at most `most` a label, evenly taken.

    aliases: key (lower case), value; configuration, a short list.
    """
    known = bank.join(aliases.select("key", "value"), F.lower("speaker") == F.col("key"), "left")
    rows = known.select("entry_idx", F.coalesce("value", "speaker").alias("label"), "embedding").where("label <> ''")
    return sample_evenly(rows, ["label"], ["entry_idx"], most)


def relabelled_sources(dataset: DataFrame, source: str) -> DataFrame:
    """All samples under one source."""
    return dataset.withColumn("source", F.lit(source))


def subset(dataset: DataFrame, row_ids: DataFrame) -> DataFrame:
    """The samples whose row_id is listed, each once."""
    return dataset.join(row_ids.select("row_id").distinct(), "row_id", "left_semi")


def appended(base: DataFrame, more: DataFrame | None) -> DataFrame:
    """base followed by more; base itself where there is nothing to add."""
    return base if more is None else base.unionByName(more, allowMissingColumns=True)


def clean_segments(records: DataFrame, stems: DataFrame, least: float, most: float, per_speaker: int, size: float = 0.0, stride: float = 0.0) -> DataFrame:
    """session, seg_idx, speaker, start, end of records long enough to learn from, cut at `most` seconds; speakers without a stem go.

    At most per_speaker of each, evenly taken; with a window size each is chopped further. records: session, seg_idx, start, end, speaker.
    """
    from parlance.operators.sequences import training_windows

    end = F.least("end", F.col("start") + most)
    rows = records.join(stems.select("speaker").distinct(), "speaker", "left_semi").withColumn("end", end).where((F.col("end") - F.col("start") >= least) & (F.col("end") > F.col("start")))
    rows = sample_evenly(rows.select("session", "seg_idx", "speaker", "start", "end"), ["speaker"], ["session", "seg_idx"], per_speaker)
    return rows if size <= 0 else training_windows(rows, least, most, size, stride or size)
