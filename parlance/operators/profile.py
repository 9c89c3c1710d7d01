"""A session under a profile: repair, candidates of bank and classifier, labels, fallbacks, the session graph and smoothing in one call."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.operators import attribution as R
from parlance.operators import bank as B
from parlance.operators import classifier as C
from parlance.operators import graph as G
from parlance.operators import sequences as S
from parlance.tables import materialize


@dataclass(frozen=True)
class Profile:
    """How a session is told apart. fusion: `fallback` asks the bank only where the classifier isn't sure, `score_sum` adds both."""

    threshold: float = 0.4
    margin: float = 0.0
    radius: float = 2.5
    least_segments: int = 1
    aggregation: str = "mean"
    fusion: str = "fallback"
    classifier_weight: float = 0.7
    bank_weight: float = 0.3
    classifier_confidence: float = 0.0
    classifier_margin: float = 0.0
    cohort: int = 0
    graph: G.SessionGraph | None = None
    smooth: bool = True
    smoothing: dict = field(default_factory=dict)


def repaired(words: DataFrame) -> DataFrame:
    """session, seg_idx, start, end, speaker_raw, overlap_heavy, was_split: diarized words as segments, split, trimmed, merged and with short ones absorbed, numbered anew.

    words: session, seg_idx, word_idx, start, end, speaker (the raw label).
    """
    runs = S.split_on_label_or_gap(words)
    split = runs.groupBy("session", "seg_idx").agg((F.count("*") > 1).alias("was_split"))
    part = S.numbered(runs, ["session"], ["start", "end", "seg_idx", "run"]).select("session", F.col("_i").cast("long").alias("seg_idx"), F.col("seg_idx").alias("whole"), "start", "end", "speaker")
    part = materialize(part, "split")
    trimmed = S.trim_overlaps(part.drop("whole"))
    merged = S.merge_same_raw(trimmed.select("session", "seg_idx", "start", "end", F.col("speaker").alias("speaker_raw")))
    short = S.absorb_short(S.numbered(merged, ["session"], ["start", "end"]).select("session", F.col("_i").cast("long").alias("seg_idx"), "start", "end", "speaker_raw"))
    out = S.numbered(short, ["session"], ["start", "end"]).select("session", F.col("_i").cast("long").alias("seg_idx"), "start", "end", "speaker_raw")
    # a segment has the flags of the parts that begin in it
    flags = trimmed.select("session", "seg_idx", F.col("start").alias("at"), F.col("overlap_heavy").alias("heavy")).join(part.select("session", "seg_idx", F.col("whole")), ["session", "seg_idx"]).join(split.withColumnRenamed("seg_idx", "whole"), ["session", "whole"])
    from parlance.operators.intervals import range_join

    met = range_join(out, flags.select("session", F.col("at").alias("start"), F.col("at").alias("end"), "heavy", "was_split"), ["session"], 30.0).where(F.col("r_start") < F.col("end"))
    by = met.groupBy("session", "seg_idx").agg(F.max("r_heavy").alias("overlap_heavy"), F.max("r_was_split").alias("was_split"))
    return out.join(by, ["session", "seg_idx"], "left").fillna(False, ["overlap_heavy", "was_split"])


def candidates(segments: DataFrame, vectors: DataFrame, bank: DataFrame, profile: Profile, clusters: DataFrame | None = None, examples: DataFrame | None = None, classifier: C.Classifier | None = None) -> DataFrame:
    """session, label, seg_idx, rank, speaker, score, source of every segment with a vector: `segment_classifier`, `segment_fusion`, `centroid` or `prototype`; sure: the classifier settled it."""
    clusters = B.clusters_by_speaker(bank) if clusters is None else clusters
    key = ["session", "seg_idx"]
    own = [c for c in ("own", "own_cluster") if c in vectors.columns]
    asked = vectors.select(*key, "embedding", *own)
    told = materialize(B.bank_scores(asked, clusters, profile.radius, examples), "bank-candidates")
    if profile.cohort:
        scores = B.normalised_scores(asked, bank, clusters, profile.cohort, profile.radius).select(*key, "speaker", F.col("score").alias("normal"))
        told = told.drop("score", "rank").join(scores, [*key, "speaker"]).withColumnRenamed("normal", "score").withColumn("rank", _rank())
    told = told.select(*key, "rank", "speaker", "score", "source", F.lit(False).alias("sure"))
    if classifier is not None:
        named = materialize(C.score(classifier, asked), "classifier-candidates")
        if profile.fusion == "score_sum":
            has = named.select(*key).distinct()
            both = R.fused_candidates(named.select(*key, "speaker", "score"), told.join(has, key, "left_semi").select(*key, "speaker", "score"), profile.classifier_weight, profile.bank_weight)
            told = told.join(has, key, "left_anti").unionByName(both.select(*key, "rank", "speaker", "score", F.lit("segment_fusion").alias("source"), F.lit(False).alias("sure")))
        else:
            least, apart = R.gates(F.col("end") - F.col("start"), F.lit(profile.classifier_confidence), F.lit(profile.classifier_margin))
            best = B.accepted(named, 0.0, 0.0).join(segments.select(*key, "start", "end"), key)
            settled = best.where((F.col("score") >= least) & (F.col("margin") >= apart)).select(*key)
            mine = named.join(settled, key, "left_semi").select(*key, "rank", "speaker", "score", F.lit("segment_classifier").alias("source"), F.lit(True).alias("sure"))
            told = told.join(settled, key, "left_anti").unionByName(mine)
    return told.join(segments.select(*key, F.col("speaker_raw").alias("label")), key)


def _rank() -> Column:
    return F.row_number().over(B.Window.partitionBy("session", "seg_idx").orderBy(F.desc("score"), "speaker")).cast("long")


def label_gates(segments: Column, confidence: float, margin: float) -> tuple[Column, Column]:
    """Confidence and margin raised for labels of few segments (fixed steps)."""
    least = F.when(segments <= 1, 0.60).when(segments <= 2, 0.45).otherwise(0.0)
    apart = F.when(segments <= 1, 0.18).when(segments <= 2, 0.10).otherwise(0.0)
    return F.greatest(F.lit(confidence), least), F.greatest(F.lit(margin), apart)


def label_speakers(segments: DataFrame, told: DataFrame, vectors: DataFrame, bank: DataFrame, profile: Profile, classifier: C.Classifier | None = None) -> DataFrame:
    """session, label, speaker, source of every label: what its segments say, else the bank on its mean vector, else the classifier on it."""
    labelled = segments.where("nullif(speaker_raw, '') is not null").select("session", "seg_idx", F.col("speaker_raw").alias("label"))
    counts = labelled.groupBy("session", "label").agg(F.count("*").alias("segments"))
    by = R.label_speakers(told.where("nullif(label, '') is not null"), profile.threshold, profile.margin, profile.least_segments, profile.aggregation)
    every = counts.join(by.select("session", "label", "speaker", "selected"), ["session", "label"], "left").fillna(False, ["selected"])
    means = materialize(R.label_vectors(vectors.select("session", "seg_idx", "embedding").join(labelled, ["session", "seg_idx"])), "label-vectors")
    found = R.label_fallback(every, means, bank, profile.threshold, profile.margin, profile.radius)
    if classifier is None:
        return found
    rest = found.where("speaker is null").join(means, ["session", "label"]).join(counts, ["session", "label"]).withColumn("seg_idx", F.xxhash64("session", "label"))
    best = B.accepted(C.score(classifier, rest.select("session", "seg_idx", "embedding")), 0.0, 0.0).select("session", "seg_idx", F.col("speaker").alias("guess"), "score", "margin")
    least, apart = label_gates(F.col("segments"), profile.classifier_confidence, profile.classifier_margin)
    sure = rest.join(best, ["session", "seg_idx"]).where((F.col("score") >= least) & (F.col("margin") >= apart)).select("session", "label", "guess")
    out = found.join(sure, ["session", "label"], "left")
    return out.select("session", "label", F.coalesce("speaker", "guess").alias("speaker"), F.coalesce("source", F.when(F.col("guess").isNotNull(), "label_classifier")).alias("source"))


def apply_profile(segments: DataFrame, vectors: DataFrame, bank: DataFrame, profile: Profile, clusters: DataFrame | None = None, examples: DataFrame | None = None, classifier: C.Classifier | None = None) -> DataFrame:
    """session, seg_idx, label, speaker, how, score, pair, seed, overridden of every segment.

    segments: session, seg_idx, start, end, speaker_raw and, where known, overlap_heavy, was_split (repaired() makes such); vectors: session, seg_idx, embedding. how: the source of the
    segment's own match, or of its label's, `none`, `session_graph` or `smoothed`.
    """
    for flag in ("overlap_heavy", "was_split"):
        segments = segments if flag in segments.columns else segments.withColumn(flag, F.lit(False))
    segments = materialize(segments.select("session", "seg_idx", "start", "end", "speaker_raw", "overlap_heavy", "was_split"), "segments")
    told = materialize(candidates(segments, vectors, bank, profile, clusters, examples, classifier), "candidates")
    graph = profile.graph or G.SessionGraph()
    known = G.evidence(segments, told, profile.threshold, profile.margin, profile.classifier_margin, graph)
    first = told.where("rank = 1").select("session", "seg_idx", F.col("speaker").alias("top"), "source", "sure")
    known = known.join(first, ["session", "seg_idx"], "left")
    # what the classifier settled by its own bars is accepted whatever the bank's
    known = materialize(known.withColumn("local_speaker", F.when(F.coalesce("sure", F.lit(False)), F.col("top")).otherwise(F.col("local_speaker"))), "known")
    labels = label_speakers(segments, told, vectors, bank, profile, classifier).where("speaker is not null")
    named = known.withColumn("label", F.col("speaker_raw")).join(labels.select("session", "label", F.col("speaker").alias("by_label"), F.col("source").alias("label_source")), ["session", "label"], "left")
    how = F.when(F.col("local_speaker").isNotNull(), F.when(F.col("source").startswith("segment_"), F.col("source")).otherwise(F.concat(F.lit("segment_"), "source"))).when(F.col("by_label").isNotNull(), F.concat(F.lit("label_"), F.regexp_replace("label_source", "^label_", ""))).otherwise("none")
    out = named.select("session", "seg_idx", "label", F.coalesce("local_speaker", "by_label", F.lit("unknown")).alias("speaker"), how.alias("how"), "score", "pair", "seed", "start", "end")
    if profile.graph is not None:
        found = G.session_graph(known.drop("top", "source", "sure"), told, vectors.select("session", "seg_idx", "embedding"), graph)
        out = G.overridden(materialize(out, "named"), found, graph)
        out = out.withColumns({"speaker": F.col("final"), "how": F.when(F.col("overridden"), "session_graph").otherwise(F.col("how")), "score": F.when(F.col("overridden"), F.col("graph_score")).otherwise(F.col("score"))}).drop("final", "graph_label", "graph_score", "graph_margin")
    else:
        out = out.withColumn("overridden", F.lit(False))
    if profile.smooth:
        out = materialize(out, "resolved")
        smooth = R.smooth_flips(out.select("session", "seg_idx", "start", "end", "speaker", "score"), **profile.smoothing).select("session", "seg_idx", "smoothed")
        out = out.join(smooth, ["session", "seg_idx"]).withColumns({"how": F.when(F.col("smoothed") != F.col("speaker"), "smoothed").otherwise(F.col("how")), "speaker": F.col("smoothed")})
    return out.select("session", "seg_idx", "label", "speaker", "how", "score", "pair", "seed", "overridden")


def summary(applied: DataFrame) -> DataFrame:
    """session, segments, matched, unknown, seeds, overrides, and how many segments each way of naming settled."""
    c = F.col
    ways = applied.groupBy("session", "how").agg(F.count("*").alias("n")).groupBy("session").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("how", "n")))).alias("ways"))
    by = applied.groupBy("session").agg(F.count("*").alias("segments"), F.count_if(c("speaker") != "unknown").alias("matched"), F.count_if(c("speaker") == "unknown").alias("unknown"), F.count_if("seed").alias("seeds"), F.count_if("overridden").alias("overrides"))
    return by.join(ways, "session")


def embedded_profile(words: DataFrame, embed: Callable, bank: DataFrame, profile: Profile, **options) -> DataFrame:
    """apply_profile() from diarized words: repaired, then embedded anew by embed (operators.bank.embedded), as repair changes what a segment is."""
    segments = materialize(repaired(words), "repaired")
    vectors = B.embedded(segments, embed).select("session", "seg_idx", "embedding")
    return apply_profile(segments, materialize(vectors, "vectors"), bank, profile, **options)
