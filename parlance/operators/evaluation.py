"""Word-level evaluation: accuracy, confusion, pair counts, roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions.text import pair_key, valid_label


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def alignment_metrics(aligned: DataFrame, keys: list[str]) -> DataFrame:
    """aligned: actual, predicted ('<unmatched>' if none)."""
    out = aligned.groupBy(*keys).agg(F.count("*").alias("total"), F.count_if(F.col("predicted") != "<unmatched>").alias("matched"), F.count_if(F.col("predicted") == F.col("actual")).alias("correct"))
    c = F.col
    return out.select(*keys, "total", "matched", "correct", ratio(c("matched"), c("total")).alias("coverage"), ratio(c("correct"), c("total")).alias("accuracy"), ratio(c("correct"), c("matched")).alias("matched_accuracy"))


def confusion(aligned: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return aligned.groupBy(*(keys or []), "actual", "predicted").agg(F.count("*").alias("n"))


def confusion_pairs(confused: DataFrame) -> DataFrame:
    """Undirected pairs of different valid labels."""
    rows = confused.where(valid_label(F.col("actual")) & valid_label(F.col("predicted")))
    return rows.select(pair_key(F.col("actual"), F.col("predicted")).alias("pair"), "n").where("pair is not null").groupBy("pair").agg(F.sum("n").alias("n"))


def rolled_up(metrics: DataFrame) -> DataFrame:
    """metrics: session, window, accuracy, correct, total. The mean over windows, the mean of session means, and the pooled share."""
    by_session = metrics.groupBy("session").agg(F.avg("accuracy").alias("m"))
    means = by_session.agg(F.avg("m").alias("mean_of_sessions"))
    return metrics.agg(F.avg("accuracy").alias("mean_of_windows"), ratio(F.sum("correct"), F.sum("total")).alias("pooled")).crossJoin(means)  # one row each


def pair_weights(pairs: DataFrame, speakers: DataFrame, default: float = 0.5) -> DataFrame:
    """Weights of confused pairs: half for being one, half by count, a quarter by how poor both speakers are.

    pairs: pair, n; speakers: speaker, total, accuracy.
    """
    poor = speakers.where("total > 0").groupBy("speaker").agg(F.sum(F.greatest(F.lit(0.0), 1 - F.col("accuracy")) * F.col("total")).alias("poor"))
    most = pairs.agg(F.max("n").alias("most")).crossJoin(poor.agg(F.max("poor").alias("most_poor")))  # one row
    names = F.split("pair", "::")
    p = pairs.withColumns({"a": names[0], "b": names[1]}).join(poor.toDF("a", "pa"), "a", "left").join(poor.toDF("b", "pb"), "b", "left").crossJoin(F.broadcast(most))
    weak = F.when(F.col("most_poor") > 0, 0.25 * (F.coalesce("pa", F.lit(0.0)) + F.coalesce("pb", F.lit(0.0))) / (2 * F.col("most_poor"))).otherwise(0.0)
    return p.select("pair", "n", F.greatest(F.lit(default), 0.5 + 0.5 * F.col("n") / F.col("most") + weak).alias("weight"))


def summed_pair_metrics(diagnostics: DataFrame) -> DataFrame:
    """pair, metric, value summed over sessions. diagnostics: session, pair, metric, value; null counts as 0."""
    return diagnostics.groupBy("pair", "metric").agg(F.sum(F.coalesce("value", F.lit(0))).cast("long").alias("value"))


def same_windows(predicted: DataFrame, reference: DataFrame) -> DataFrame:
    """Predicted windows beside the reference of the same session and name; windows of one side only go."""
    right = reference.select("session", "window", *[F.col(c).alias(f"ref_{c}") for c in reference.columns if c not in ("session", "window")])
    return predicted.join(right, ["session", "window"])


def error_patterns(segments: DataFrame) -> DataFrame:
    """By session: segments with a reference, wrong ones, median durations of right and wrong ones, their shares up to 2 s, and sandwiches.

    segments: session, seg_idx, start, end, predicted, reference. A sandwich lies between two segments of one other predicted speaker; it is
    fixable if that speaker is the true one.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("session").orderBy("start", "end", "seg_idx")
    c = F.col
    s = segments.withColumns({"before": F.lag("predicted").over(w), "after": F.lead("predicted").over(w), "d": c("end") - c("start")}).where("nullif(reference, '') is not null")
    right = F.coalesce(c("predicted") == c("reference"), F.lit(False))
    between = F.coalesce((c("before") == c("after")) & (c("before") != c("predicted")), F.lit(False))
    only = lambda cond: F.when(cond, c("d"))
    return s.groupBy("session").agg(
        F.count("*").alias("segments"),
        F.count_if(~right).alias("wrong"),
        F.coalesce(F.median(only(right)), F.lit(0.0)).alias("right_median"),
        F.coalesce(F.median(only(~right)), F.lit(0.0)).alias("wrong_median"),
        ratio(F.count_if(right & (c("d") <= 2)), F.count_if(right)).alias("right_short"),
        ratio(F.count_if(~right & (c("d") <= 2)), F.count_if(~right)).alias("wrong_short"),
        F.count_if(between).alias("sandwiches"),
        F.count_if(between & ~right & (c("before") == c("reference"))).alias("fixable"),
        F.count_if(between & right).alias("already_right"),
    )


def evaluate(reference: DataFrame, predicted: DataFrame, window: float, tolerance: float = 0.35) -> DataFrame:
    """session, window and the alignment metrics of each: words matched in time, counted by the window in which the reference word's middle lies.

    Both: session, seg_idx, word_idx, start, end, speaker. rolled_up() and confusion_pairs() take it from here.
    """
    from parlance.operators.intervals import nearest_words

    placed = reference.withColumn("window", F.floor((F.col("start") + F.col("end")) / 2 / window))
    return alignment_metrics(nearest_words(placed, predicted, tolerance, also=["window"]), ["session", "window"])


def cut(rows: DataFrame, windows: DataFrame) -> DataFrame:
    """rows (session, start, end, ...) that lie in a window (session, name, start, end) for more than a moment, once for each, with its name in place of the session."""
    from parlance.operators.intervals import range_join, touches

    fields = [c for c in rows.columns if c != "session"]
    met = range_join(windows.select("session", "start", "end", "name"), rows, ["session"], 60.0).where(touches(F.col("r_start"), F.col("r_end"), F.col("start"), F.col("end")))
    return met.select(F.col("name").alias("session"), *[F.col(f"r_{c}").alias(c) for c in fields])


def evaluate_session(windows: DataFrame, reference: DataFrame, segments: DataFrame, words: DataFrame, vectors: DataFrame, bank: DataFrame, profile, tolerance: float = 0.35, frames: DataFrame | None = None, **options) -> dict[str, DataFrame]:
    """Each window told apart under the profile and held against the reference, with the session graph and without: tables by name.

    windows: session, name, start, end; reference and words: session, seg_idx, word_idx, start, end, speaker (words: of the segments, as recognised); segments: session, seg_idx, start, end,
    speaker_raw; vectors: session, seg_idx, embedding; frames (optional): session, stem, start, end, power of the separate tracks.
    `segments`: the final speakers; `metrics`: name, phase (pre_graph, post_graph), words and accuracy; `pairs`: confused pairs before and after; `rollup`: of all windows by phase; `purity`: how far each
    segment belongs to one track. A window is a session of its own, so speakers are told apart within it alone.
    """
    from dataclasses import replace

    from parlance.operators import attribution as R
    from parlance.operators import evidence as V
    from parlance.operators.intervals import nearest_words
    from parlance.operators.profile import apply_profile
    from parlance.tables import materialize

    parts = materialize(cut(segments, windows), "window-segments")
    mine = vectors.join(windows.select("session", "name"), "session").drop("session").withColumnRenamed("name", "session")
    mine = materialize(mine.join(parts.select("session", "seg_idx"), ["session", "seg_idx"], "left_semi"), "window-vectors")
    truth, heard = materialize(cut(reference, windows), "window-reference"), materialize(cut(words, windows), "window-words")
    phases = {"post_graph": profile} if profile.graph is None else {"pre_graph": replace(profile, graph=None), "post_graph": profile}
    metrics, confused, final = [], {}, None
    for phase, p in phases.items():
        final = materialize(apply_profile(parts, mine, bank, p, **options), phase)
        named = heard.drop("speaker").join(final.select("session", "seg_idx", "speaker"), ["session", "seg_idx"])
        aligned = materialize(nearest_words(truth, named, tolerance), "aligned")
        metrics.append(alignment_metrics(aligned, ["session"]).withColumn("phase", F.lit(phase)))
        confused[phase] = confusion_pairs(confusion(aligned))
    table = metrics[0] if len(metrics) == 1 else metrics[0].unionByName(metrics[1])
    table = materialize(table.withColumnRenamed("session", "name").join(windows.select("name", "session"), "name"), "metrics")
    rollup = table.groupBy("phase").agg(F.count("*").alias("windows"), F.avg("accuracy").alias("mean_accuracy"), F.avg("coverage").alias("mean_coverage"), ratio(F.sum("correct"), F.sum("total")).alias("pooled"))
    out = {"segments": final, "metrics": table, "pairs": R.diagnostics(confused.get("pre_graph", confused["post_graph"]), confused["post_graph"]), "rollup": rollup}
    if frames is not None:
        out["purity"] = V.stem_power(parts, cut(frames, windows))
    return out


def name_windows(windows: DataFrame) -> DataFrame:
    """windows (session, rank, start, end, ...) with name: session, number, start and end in whole seconds."""
    part = lambda c, n: F.lpad(F.floor(c).cast("long").cast("string"), n, "0")
    return windows.withColumn("name", F.concat_ws("_", F.col("session").cast("string"), F.lit("window"), part(F.col("rank"), 2), part(F.col("start"), 5), part(F.col("end"), 5)))
