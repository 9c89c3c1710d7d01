"""From candidates to speakers: fusion, label aggregation, gates, smoothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fused_candidates(classifier: DataFrame, bank: DataFrame, a: float = 0.7, b: float = 0.3) -> DataFrame:
    """Full outer by (session, seg_idx, speaker), missing scores 0; ranked by fused, classifier, bank score."""
    key = ["session", "seg_idx", "speaker"]
    both = classifier.select(*key, F.col("score").alias("c")).join(bank.select(*key, F.col("score").alias("k")), key, "full").fillna(0.0, ["c", "k"])
    both = both.withColumn("score", a * F.col("c") + b * F.col("k"))
    rank = F.row_number().over(Window.partitionBy("session", "seg_idx").orderBy(F.desc("score"), F.desc("c"), F.desc("k"), "speaker"))
    return both.select(*key, "c", "k", "score", rank.cast("long").alias("rank"))


def label_speakers(candidates: DataFrame, threshold: float, margin: float, least_segments: int, how: str = "mean", by: list[str] | None = None) -> DataFrame:
    """One row per (session, label) and, where given, the columns of by: the speaker its segments point to, if the bars are met.

    candidates: session, label, seg_idx, rank, speaker, score. A speaker's mean is over all segments with candidates, so speakers that
    few segments support are diluted. 'vote' ranks by first places, then means, and its margin is a difference of shares.
    """
    key = [*(by or []), "session", "label"]
    embedded = candidates.groupBy(*key).agg(F.countDistinct("seg_idx").alias("embedded"))
    means = candidates.groupBy(*key, "speaker").agg(F.sum("score").alias("total"), F.count("*").alias("support"), F.count_if(F.col("rank") == 1).alias("votes"), F.max("score").alias("score_max"))
    means = means.join(embedded, key).withColumn("mean", F.col("total") / F.col("embedded"))
    order = [F.desc("mean"), "speaker"] if how == "mean" else [F.desc("votes"), F.desc("mean"), "speaker"]
    metric = F.col("mean") if how == "mean" else F.col("votes") / F.col("embedded")
    means = means.withColumn("metric", metric).withColumn("r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("r <= 2")
    first = lambda c: F.max(F.when(F.col("r") == 1, F.col(c)))
    out = means.groupBy(*key).agg(first("speaker").alias("speaker"), first("mean").alias("score"), first("score_max").alias("score_max"), first("support").alias("support"), F.max("embedded").alias("embedded"), (first("metric") - F.coalesce(F.max(F.when(F.col("r") == 2, F.col("metric"))), F.lit(0.0))).alias("margin"))
    return out.withColumn("selected", (F.col("embedded") >= max(1, least_segments)) & (F.col("score") >= threshold) & (F.col("margin") >= margin))


def gates(duration: Column, threshold: Column, margin: Column) -> tuple[Column, Column]:
    """Threshold and margin raised for short segments (fixed steps)."""
    t = F.when(duration < 0.75, 0.60).when(duration < 1.25, 0.50).when(duration < 2.0, 0.35).otherwise(0.0)
    m = F.when(duration < 0.75, 0.20).when(duration < 1.25, 0.14).when(duration < 2.0, 0.08).otherwise(0.0)
    return F.greatest(threshold, t), F.greatest(margin, m)


def resolve(segments: DataFrame, segment_matches: DataFrame, label_matches: DataFrame) -> DataFrame:
    """Segment match, else label match, else unknown."""
    s = segment_matches.where("matched").select("session", "seg_idx", F.col("speaker").alias("by_segment"))
    b = label_matches.where("selected").select("session", "label", F.col("speaker").alias("by_label"))
    out = segments.join(s, ["session", "seg_idx"], "left").join(b, ["session", "label"], "left")
    return out.select("session", "seg_idx", "label", F.coalesce("by_segment", "by_label", F.lit("unknown")).alias("speaker"), F.when(F.col("by_segment").isNotNull(), "segment").when(F.col("by_label").isNotNull(), "label").otherwise("none").alias("how"))


def diagnostics(before: DataFrame, after: DataFrame) -> DataFrame:
    """pair, n before and after, delta: full outer, missing 0."""
    both = before.select("pair", F.col("n").alias("pre")).join(after.select("pair", F.col("n").alias("post")), "pair", "full").fillna(0, ["pre", "post"])
    return both.withColumn("delta", F.col("post") - F.col("pre"))


def smooth_flips(segments: DataFrame, most_run: int = 2, most_seconds: float = 2.0, gap: float = 0.75, cap: float = 0.5) -> DataFrame:
    """Short runs between two segments of one known speaker take that speaker. Left to right with effects in place, longest runs first.

    A run that is taken over makes the next `size` places unfit (there, left and inner speaker are now one) and changes nothing beyond. So the places that fit are found at once, and of
    each chain of them less than size + 1 apart the first is taken, then the next that isn't unfit, and so on: chains are short, and a session is many tasks if it is long.
    """
    from parlance.operators.lines import Line
    from parlance.tables import materialize

    c = F.col
    line = Line(segments.select("session", "seg_idx", "start", "end", "speaker", "score"), ["session"], ["start", "end", "seg_idx"], places=True)
    rows = line.rows.withColumn("smoothed", c("speaker"))
    for size in range(most_run, 0, -1):
        wide = line.beside(rows, _x=(F.struct("smoothed", "end"), 1), **{f"_{j}": (F.struct("smoothed", "start", "end", "score"), -j) for j in range(1, size + 1)})
        at = lambda j, f: (c("smoothed") if f == "smoothed" else c(f)) if j == 0 else c("_x" if j < 0 else f"_{j}")[f]
        left = at(-1, "smoothed")
        fits = (left == at(size, "smoothed")) & (left != "") & (left != "unknown")
        for j in range(-1, size):
            fits = fits & (at(j + 1, "start") - at(j, "end") <= gap)
        for j in range(size):
            fits = fits & ~at(j, "smoothed").eqNullSafe(left) & F.coalesce(F.isnan(at(j, "score")) | (at(j, "score") <= cap), F.lit(True))
        fits = fits & (sum((at(j, "end") - at(j, "start") for j in range(1, size)), at(0, "end") - at(0, "start")) <= most_seconds)
        fit = wide.withColumns({"_fits": F.coalesce(fits, F.lit(False)), "_left": left})
        fit = line.beside(fit, **{f"_f{j}": (c("_fits"), j) for j in range(1, size + 1)})
        first = c("_fits") & ~F.greatest(*[F.coalesce(c(f"_f{j}"), F.lit(False)) for j in range(1, size + 1)], F.lit(False))
        fit = line.running(fit, "_chain", F.when(first, c("_i")), "max").where("_fits")
        chains = fit.groupBy("session", "_chain").agg(F.array_sort(F.collect_list(F.struct(c("_i").cast("long").alias("i"), c("_left").alias("speaker")))).alias("all"))
        kind = "array<struct<i:bigint,speaker:string>>"
        first_of = F.expr(f"cast(array(struct({-size - 1}L, '')) as {kind})")  # before any place
        take = lambda got, x: F.when(x["i"] > F.element_at(got, -1)["i"] + size, F.concat(got, F.array(x))).otherwise(got)  # noqa: E731,B023
        taken = chains.select("session", F.explode(F.aggregate(c("all").cast(kind), first_of, take)).alias("x")).where("x.i >= 0")
        new = materialize(taken.select("session", F.explode(F.sequence(c("x.i"), c("x.i") + size - 1)).alias("_i"), c("x.speaker").alias("_new")), "smoothed")
        rows = rows.withColumn("_i", c("_i").cast("long")).join(new, ["session", "_i"], "left").withColumn("smoothed", F.coalesce("_new", "smoothed")).drop("_new")
    return rows.select("session", "seg_idx", "speaker", "smoothed")


def temporal_weight(gap: Column) -> Column:
    """Edge weight of neighbours in time (fixed decay), 0 beyond two seconds."""
    return F.when(gap <= 2.0, 0.35 * F.exp(-gap / 0.75)).otherwise(0.0)


def label_vectors(segments: DataFrame) -> DataFrame:
    """session, label, embedding: the unit mean of a label's unit vectors; labels whose vectors cancel out have none. segments: session, label, embedding."""
    from parlance.functions.vectors import mean_vectors, norm
    from parlance.operators.bank import unit_rows

    rows = unit_rows(segments.where("nullif(label, '') is not null")).select("session", "label", "v")
    return mean_vectors(rows, ["session", "label"], "v", "embedding").where(norm(F.col("embedding")) > 1e-9)


def label_fallback(labels: DataFrame, vectors: DataFrame, bank: DataFrame, threshold: float, margin: float, radius: float = 2.5) -> DataFrame:
    """session, label, speaker, source: labels that their segments settled keep that; the others are matched by their vector.

    labels: session, label, speaker, selected (one row a label, speaker null if none); those that neither settles stay, without a speaker.
    """
    from parlance.operators.bank import match

    own = labels.select("session", "label", F.when(F.col("selected"), F.col("speaker")).alias("by_segments"))
    rest = own.where("by_segments is null").join(vectors, ["session", "label"]).withColumn("seg_idx", F.xxhash64("session", "label"))
    found = match(rest.select("session", "seg_idx", "embedding"), bank, threshold, margin, radius).where("matched")
    found = rest.select("session", "label", "seg_idx").join(found.select("session", "seg_idx", F.col("speaker").alias("by_vector")), ["session", "seg_idx"]).drop("seg_idx")
    out = own.join(found, ["session", "label"], "left")
    source = F.when(F.col("by_segments").isNotNull(), "segments").when(F.col("by_vector").isNotNull(), "label_vector")
    return out.select("session", "label", F.coalesce("by_segments", "by_vector").alias("speaker"), source.alias("source"))


def duration_vote(words: DataFrame) -> DataFrame:
    """session, seg_idx, speaker: the speaker with most spoken time among a segment's words; the first by name on ties. Words without a speaker don't vote."""
    by = words.where("nullif(speaker, '') is not null").groupBy("session", "seg_idx", "speaker").agg(F.sum(F.greatest(F.col("end") - F.col("start"), F.lit(0.0))).alias("seconds"))
    return by.groupBy("session", "seg_idx").agg(F.min_by(F.struct("speaker", "seconds"), F.struct(-F.col("seconds"), "speaker")).alias("b")).select("session", "seg_idx", "b.speaker", "b.seconds")


def repair_counters(before: DataFrame, after: DataFrame) -> DataFrame:
    """session, segments in and out, unknown before and after, and segments whose speaker changed. Both: session, seg_idx, speaker."""
    known = lambda c: F.count_if(~F.lower(F.coalesce(F.trim(c), F.lit(""))).isin("", "unknown"))
    b = before.groupBy("session").agg(F.count("*").alias("segments_in"), (F.count("*") - known("speaker")).alias("unknown_in"))
    a = after.groupBy("session").agg(F.count("*").alias("segments_out"), known("speaker").alias("matched"), (F.count("*") - known("speaker")).alias("unknown_out"))
    both = before.select("session", "seg_idx", F.col("speaker").alias("old")).join(after.select("session", "seg_idx", F.col("speaker").alias("new")), ["session", "seg_idx"])
    changed = both.groupBy("session").agg(F.count_if(~F.col("old").eqNullSafe(F.col("new"))).alias("changed"))
    return b.join(a, "session", "full").join(changed, "session", "full").fillna(0, ["segments_in", "unknown_in", "segments_out", "matched", "unknown_out", "changed"])


def graph_counters(decisions: DataFrame) -> DataFrame:
    """pair, seeds, overrides, rescued, unchanged, unresolved. decisions: pair, seed, speaker (before), final, graph_label (null: the graph says nothing)."""
    unknown = lambda c: F.lower(F.coalesce(F.col(c), F.lit("unknown"))) == "unknown"
    moved = F.col("final") != F.col("speaker")
    return decisions.groupBy("pair").agg(
        F.count_if("seed").alias("seeds"),
        F.count_if(~F.col("seed") & moved).alias("overrides"),
        F.count_if(~F.col("seed") & moved & unknown("speaker")).alias("rescued"),
        F.count_if(~F.col("seed") & ~moved & F.col("graph_label").isNotNull()).alias("unchanged"),
        F.count_if(~F.col("seed") & F.col("graph_label").isNull()).alias("unresolved"),
    )


def file_labels(segments: DataFrame, labels: DataFrame) -> DataFrame:
    """segments (session, file, seg_idx, speaker, matched) renamed by their file. labels: file, label, and name by speaker in table names.

    In a session of several files a segment takes its file's label unless the bank matched it; in a session of one file only missing speakers do.
    """
    files = segments.groupBy("session").agg(F.countDistinct("file").alias("files"))
    s = segments.join(files, "session").join(labels.select("file", "label"), "file", "left")
    missing = F.nullif(F.trim("speaker"), F.lit("")).isNull()
    take = F.when(F.col("files") > 1, ~F.coalesce("matched", F.lit(False))).otherwise(missing) & F.col("label").isNotNull()
    return s.select("session", "file", "seg_idx", F.when(take, F.col("label")).otherwise(F.col("speaker")).alias("speaker"))


def relabelled_words(segments: DataFrame, speaker: Column) -> DataFrame:
    """segments with the speaker set on themselves and on all their words; the first speaker_raw of each is kept."""
    words = F.transform("words", lambda w: w.withField("speaker_raw", F.coalesce(w["speaker_raw"], w["speaker"])).withField("speaker", speaker))
    return segments.withColumns({"words": words, "speaker_raw": F.coalesce("speaker_raw", "speaker"), "speaker": speaker})
