"""Evidence for the session graph, experiment tables, styles and signal quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions.text import pair_key


def segment_evidence(candidates: DataFrame, segments: DataFrame, threshold: float, strong: float, margin: float) -> DataFrame:
    """Per segment: its three best candidates, margin, the pair of the two best, and whether it may seed the graph.

    candidates: session, seg_idx, rank, speaker, score; segments: session, seg_idx, start, end, overlap_heavy.
    """
    top = candidates.where("rank <= 3").groupBy("session", "seg_idx").agg(
        F.array_sort(F.collect_list(F.struct("rank", "speaker", "score"))).alias("local_candidates"),
        F.max(F.when(F.col("rank") == 1, F.col("speaker"))).alias("speaker"),
        F.max(F.when(F.col("rank") == 2, F.col("speaker"))).alias("second"),
        F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("score"),
        F.coalesce(F.max(F.when(F.col("rank") == 2, F.col("score"))), F.lit(0.0)).alias("second_score"),
    )
    both = segments.select("session", "seg_idx", (F.col("end") - F.col("start")).alias("duration"), "overlap_heavy").join(top, ["session", "seg_idx"], "left")
    gap = F.col("score") - F.col("second_score")
    seed = (F.col("duration") >= 0.75) & (F.col("score") >= max(threshold + 0.05, strong)) & (gap >= margin) & ~F.col("overlap_heavy")
    return both.select("session", "seg_idx", "duration", "local_candidates", "speaker", "score", gap.alias("margin"), pair_key(F.col("speaker"), F.col("second")).alias("pair"), F.coalesce(seed, F.lit(False)).alias("seed"))


def anchor_edges(candidates: DataFrame, floor: float, top: int = 3) -> DataFrame:
    """Edges from segments to speakers, weight (score - floor) / (1 - floor), at most 1; those at or below the floor go."""
    w = F.least(F.lit(1.0), (F.col("score") - floor) / (1 - floor))
    return candidates.where((F.col("rank") <= top) & (F.col("score") > floor)).select("session", "seg_idx", "speaker", w.alias("w"))


def style_score(values: dict[str, tuple[float, float]]) -> Column:
    """Mean of triangular scores: column -> (target, tolerance)."""
    parts = [F.greatest(F.lit(0.0), 1 - F.abs(F.col(c) - t) / tol) for c, (t, tol) in values.items()]
    return sum(parts[1:], parts[0]) / len(parts)


def style_priority(profile: Column, score: Column, wanted: str, threshold: float) -> Column:
    """0: the wanted profile; 1: a score that reaches the threshold; 2: neither."""
    return F.when(profile == wanted, 0).when(score >= threshold, 1).otherwise(2)


def signal_quality(rows: DataFrame, clip: float = 0.999, quiet: float = 1e-4) -> DataFrame:
    """label, duration, rms, peak, clipping and silence shares of (label, sample_rate, samples)."""
    n = F.size("samples")
    s = rows.withColumn("n", n)
    total = F.aggregate("samples", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    share = lambda f: F.size(F.filter("samples", f)) / F.col("n")
    return s.where("n > 0").select(
        "label",
        (F.col("n") / F.col("sample_rate")).alias("duration"),
        F.sqrt(total / F.col("n")).alias("rms"),
        F.array_max(F.transform("samples", F.abs)).cast("double").alias("peak_abs"),
        share(lambda x: F.abs(x) >= clip).alias("clipping_fraction"),
        share(lambda x: F.abs(x) <= quiet).alias("silence_fraction"),
    )


def stem_power(turns: DataFrame, frames: DataFrame, width: float = 30.0) -> DataFrame:
    """Mean power of every stem within each turn, and the turn's dominant stem and share.

    turns: session, seg_idx, start, end; frames: session, stem, start, end, power.
    """
    from parlance.operators.intervals import range_join, touches

    pairs = range_join(turns.select("session", "seg_idx", "start", "end"), frames, ["session"], width)
    pairs = pairs.where(touches(F.col("r_start"), F.col("r_end"), F.col("start"), F.col("end")))
    by = pairs.groupBy("session", "seg_idx", "r_stem").agg(F.avg("r_power").alias("power"))
    r = F.row_number().over(Window.partitionBy("session", "seg_idx").orderBy(F.desc("power"), "r_stem"))
    by = by.withColumn("r", r)
    out = by.groupBy("session", "seg_idx").agg(F.max(F.when(F.col("r") == 1, F.col("r_stem"))).alias("stem"), F.sum("power").alias("total_power"), F.max(F.when(F.col("r") == 1, F.col("power"))).alias("top1_power"), F.coalesce(F.max(F.when(F.col("r") == 2, F.col("power"))), F.lit(0.0)).alias("top2_power"))
    return out.withColumn("dominant_share", F.when(F.col("total_power") > 0, F.col("top1_power") / F.col("total_power")).otherwise(0.0))


def deltas(results: DataFrame, baseline: DataFrame) -> DataFrame:
    """name, session, metric, value, delta to the baseline's value."""
    b = baseline.select("session", "metric", F.col("value").alias("base"))
    return results.join(b, ["session", "metric"], "left").select("name", "session", "metric", "value", (F.col("value") - F.col("base")).alias("delta"))


def accepted_experiments(d: DataFrame, gain: float = 0.01, most_loss: float = 0.01) -> DataFrame:
    """Experiments ranked by mean gain; accepted if it reaches `gain` and no session loses more than most_loss."""
    by = d.groupBy("name").agg(F.avg("delta").alias("gain"), F.min("delta").alias("worst"), F.avg("value").alias("value"))
    by = by.withColumn("accepted", (F.col("gain") >= gain) & (F.col("worst") >= -most_loss))
    rank = F.row_number().over(Window.orderBy(F.desc("accepted"), F.desc("gain"), F.desc("worst"), "name"))  # one row per experiment
    return by.withColumn("rank", rank.cast("long"))


def passes(windows: DataFrame, n: int) -> DataFrame:
    """Windows replayed n times with a pass index and a seed that depends on both."""
    return windows.withColumn("pass_index", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("seed", F.xxhash64(*[F.col(c) for c in windows.columns], "pass_index"))
