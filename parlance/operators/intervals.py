"""Joins on time intervals: by largest overlap, and by nearest midpoint within a tolerance.

A range condition alone would make Spark compare all pairs of a session. Both joins deal each interval into time
buckets instead, join on (session, bucket), and keep the exact predicate. A pair that shares several buckets is taken in the
first of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overlap(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(a_end, b_end) - F.greatest(a_start, b_start))


def touches(start: Column, end: Column, window_start: Column, window_end: Column) -> Column:
    """Whether an interval shares more than an edge with a window."""
    return (end > window_start) & (start < window_end)


def bucketed(df: DataFrame, start: Column, end: Column, width: float) -> DataFrame:
    """A row per time bucket that [start, end] touches."""
    return df.withColumn("bucket", F.explode(F.sequence(F.floor(start / width), F.floor(F.greatest(start, end) / width))))


def range_join(left: DataFrame, right: DataFrame, keys: list[str], width: float, pad: float = 0.0) -> DataFrame:
    """Pairs of equal keys whose intervals lie within pad of each other; both sides have start and end; right's columns get a prefix r_.

    Inner. Each pair comes once.
    """
    lft = bucketed(left, F.col("start") - pad, F.col("end") + pad, width)
    names = [c for c in right.columns if c not in keys]
    rgt = bucketed(right.select(*keys, *[F.col(c).alias(f"r_{c}") for c in names]), F.col("r_start"), F.col("r_end"), width)
    first = F.greatest(F.floor((F.col("start") - pad) / width), F.floor(F.col("r_start") / width))
    near = (F.col("r_end") >= F.col("start") - pad) & (F.col("r_start") <= F.col("end") + pad) & (F.col("bucket") == first)
    return lft.join(rgt, [*keys, "bucket"]).where(near).drop("bucket")


def label_by_overlap(words: DataFrame, turns: DataFrame, width: float = 30.0) -> DataFrame:
    """words (session, seg_idx, word_idx, start, end, ...) with turn_speaker.

    The turn of largest overlap, the first on ties; without overlap the last turn that holds the midpoint; else the turn with the
    nearest edge, the first on ties. turns: session, turn_idx, start, end, speaker.
    """
    key = ["session", "seg_idx", "word_idx"]
    mid = (F.col("start") + F.col("end")) / 2
    pairs = range_join(words, turns.select("session", "turn_idx", "start", "end", "speaker"), ["session"], width)
    pairs = pairs.withColumn("o", overlap(F.col("start"), F.col("end"), F.col("r_start"), F.col("r_end")))
    holds = (F.col("r_start") <= mid) & (mid <= F.col("r_end"))
    best = (
        pairs.where((F.col("o") > 0) | holds)
        .groupBy(*key)
        .agg(
            F.min_by("r_speaker", F.when(F.col("o") > 0, F.struct(-F.col("o"), "r_turn_idx"))).alias("by_overlap"),
            F.max_by("r_speaker", F.when((F.col("o") <= 0) & holds, F.col("r_turn_idx"))).alias("by_mid"),
        )
        .select(*key, F.coalesce("by_overlap", "by_mid").alias("found"))
    )
    labelled = words.join(best, key, "left")
    # the others: the nearest edges are the last end before and the first start after the midpoint
    from parlance.operators.lines import HOT, Line, largest

    rest = labelled.where("found is null").select(*key, mid.alias("t"))
    none = F.lit(None).cast("struct<t:double,i:long,speaker:string>")
    edge = lambda t, sign: F.struct(F.col(t).alias("t"), (sign * F.col("turn_idx")).alias("i"), "speaker")
    edges = turns.select("session", F.col("end").alias("t"), edge("end", -1).alias("before"), none.alias("after")).unionByName(turns.select("session", F.col("start").alias("t"), none.alias("before"), edge("start", 1).alias("after")))
    word = rest.withColumns({"before": none, "after": none, "_word": F.lit(1)})
    both = word.unionByName(edges.withColumns({"seg_idx": F.lit(None).cast("long"), "word_idx": F.lit(None).cast("long"), "_word": F.lit(0)})).withColumn("_back", -F.col("t"))
    most = 2 * largest(words.select("session").unionByName(turns.select("session")), ["session"])
    if most <= HOT:
        w = Window.partitionBy("session").orderBy("t")
        told = both.withColumn("b", F.max("before").over(w.rangeBetween(Window.unboundedPreceding, 0))).withColumn("a", F.min("after").over(w.rangeBetween(0, Window.unboundedFollowing)))
    else:  # at one time edges come first, so a word has them behind it in either direction
        ahead = Line(both, ["session"], ["t", "_word"], most=most)
        told = ahead.done(ahead.running(ahead.rows, "b", F.col("before"), "max"))
        back = Line(told, ["session"], ["_back", "_word"], most=most)
        told = back.done(back.running(back.rows, "a", F.col("after"), "min"))
    gap_b, gap_a = F.col("t") - F.col("b.t"), F.col("a.t") - F.col("t")
    nearest = F.when(F.col("a").isNull() | (gap_b < gap_a) | ((gap_b == gap_a) & (-F.col("b.i") <= F.col("a.i"))), F.col("b.speaker")).otherwise(F.col("a.speaker"))
    rest = told.where("_word = 1").select(*key, nearest.alias("near"))
    return labelled.join(rest, key, "left").withColumn("turn_speaker", F.coalesce("found", "near")).drop("found", "near")


def nearest_words(reference: DataFrame, predicted: DataFrame, tolerance: float = 0.35, width: float = 5.0, also: list[str] | None = None) -> DataFrame:
    """reference words with the predicted speaker: the nearest by (gap to the interval, gap of midpoints), left outer; and the columns `also` of the reference.

    Both: session, seg_idx, word_idx, start, end, speaker. Ties go to the first predicted by start and end. A reference word lies in the one bucket of its middle and meets the
    list of the predicted words that could be wanted there, which is as long as `width` seconds of a session hold words; no pairs are sorted or shuffled.
    """
    c, names = F.col, ("start", "end", "seg_idx", "word_idx", "speaker")
    ref = reference.withColumn("_t", (c("start") + c("end")) / 2).withColumn("bucket", F.floor(c("_t") / width))
    pad = tolerance + 1e-6  # more than rounding can take off; the exact bound is asked below
    said = bucketed(predicted.select("session", *names), c("start") - pad, F.greatest("start", "end") + pad, width)
    lists = said.groupBy("session", "bucket").agg(F.collect_list(F.struct(*names)).alias("_said"))
    t = c("_t")
    gap = lambda x: F.when(t.between(x["start"], x["end"]), 0.0).otherwise(F.least(F.abs(t - x["start"]), F.abs(t - x["end"])))
    near = lambda x: (x["end"] >= t - tolerance) & (x["start"] <= t + tolerance) & (gap(x) <= tolerance)
    order = lambda x: F.struct(gap(x).alias("gap"), F.abs((x["start"] + x["end"]) / 2 - t).alias("middle"), *[x[n].alias(n) for n in names])
    best = F.array_min(F.transform(F.filter("_said", near), order))
    # the lists are more than Spark expects of them, so they are never to be broadcast
    met = ref.join(lists.hint("merge"), ["session", "bucket"], "left")
    # made by a generator, so that filters on it don't work it out again
    return met.select("session", "seg_idx", "word_idx", c("speaker").alias("actual"), F.explode(F.array(F.coalesce(best["speaker"], F.lit("<unmatched>")))).alias("predicted"), *(also or []))


def dominant_speaker(segments: DataFrame, words: DataFrame, tolerance: float = 0.35, width: float = 30.0) -> DataFrame:
    """segments (session, seg_idx, start, end) with the commonest speaker of the words that overlap them or whose midpoint lies within tolerance."""
    pairs = range_join(segments.select("session", "seg_idx", "start", "end"), words.select("session", "start", "end", "speaker"), ["session"], width, tolerance)
    mid = (F.col("r_start") + F.col("r_end")) / 2
    hit = (overlap(F.col("start"), F.col("end"), F.col("r_start"), F.col("r_end")) > 0) | mid.between(F.col("start") - tolerance, F.col("end") + tolerance)
    votes = pairs.where(hit).groupBy("session", "seg_idx", "r_speaker").agg(F.count("*").alias("n"), F.min("r_start").alias("seen"))
    return votes.groupBy("session", "seg_idx").agg(F.sum("n").alias("n_words"), F.min_by("r_speaker", F.struct(-F.col("n"), "seen", "r_speaker")).alias("dominant"), F.max("n").alias("n_dominant"))
