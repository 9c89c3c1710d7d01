"""Sweeps over thresholds, margins and label sizes: every point of a grid from one pass over the segments.

A segment's speaker is its own best candidate if that meets threshold and margin, else its label's if that meets both and enough of the label's segments have candidates.
Each segment only counts in the cell of the highest threshold, margin and label size that it still meets: once for itself, once for its label, and, taken off again,
once for both. Sums over the cells from the top down then give the number taken and right at every point, whatever the number of points.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.operators.attribution import label_speakers


@dataclass(frozen=True)
class Grid:
    thresholds: tuple[float, ...]
    margins: tuple[float, ...]
    least: tuple[int, ...] = (1,)


def graded(candidates: DataFrame, truth: DataFrame, profiles: list[str]) -> DataFrame:
    """profile, own (score, margin, right) and label (score, margin, n, right) of every segment of truth under every profile.

    candidates: profile, session, label, seg_idx, rank, speaker, score; truth: session, label, seg_idx, actual.
    """
    key = ["profile", "session", "seg_idx"]
    first = lambda c, r: F.max(F.when(F.col("rank") == r, F.col(c)))
    top = candidates.where("rank <= 2").groupBy(*key).agg(first("speaker", 1).alias("speaker"), first("score", 1).alias("score"), F.coalesce(first("score", 2), F.lit(0.0)).alias("second"))
    labels = label_speakers(candidates, 0.0, 0.0, 1, by=["profile"]).select("profile", "session", "label", F.col("speaker").alias("l_speaker"), F.col("score").alias("l_score"), F.col("margin").alias("l_margin"), F.col("embedded").alias("l_n"))
    every = truth.select(F.explode(F.array(*map(F.lit, profiles))).alias("profile"), "session", "label", "seg_idx", "actual")
    rows = every.join(top, key, "left").join(labels, ["profile", "session", "label"], "left")
    right = lambda c: F.coalesce(F.col(c) == F.col("actual"), F.lit(False)).cast("int")
    own = F.struct("score", (F.col("score") - F.col("second")).alias("margin"), right("speaker").alias("right"))
    label = F.struct(F.col("l_score").alias("score"), F.col("l_margin").alias("margin"), F.col("l_n").alias("n"), right("l_speaker").alias("right"))
    return rows.select(*key, own.alias("own"), label.alias("label"))


def _met(value: Column, bars: tuple) -> Column:
    """How many of the bars, in ascending order, the value meets."""
    return sum((F.coalesce(value >= F.lit(b), F.lit(False)).cast("int") for b in sorted(bars)), F.lit(0))


def grid_scores(rows: DataFrame, grid: Grid) -> DataFrame:
    """profile, threshold, margin, least, segments, taken, right, coverage, accuracy for every point of the grid. rows: of graded()."""
    cell = lambda t, m, s, n, right: F.struct(t.alias("t"), m.alias("m"), s.alias("s"), F.lit(n).alias("n"), right.alias("right"))
    ot, om = _met(F.col("own.score"), grid.thresholds), _met(F.col("own.margin"), grid.margins)
    lt, lm, ln = _met(F.col("label.score"), grid.thresholds), _met(F.col("label.margin"), grid.margins), _met(F.col("label.n"), grid.least)
    met = rows.select("profile", ot.alias("ot"), om.alias("om"), lt.alias("lt"), lm.alias("lm"), ln.alias("ln"), F.col("own.right").alias("o"), F.col("label.right").alias("l"))
    c = F.col
    cells = met.select("profile", F.explode(F.array(
        cell(c("ot"), c("om"), F.lit(len(grid.least)), 1, c("o")),
        cell(c("lt"), c("lm"), c("ln"), 1, c("l")),
        cell(F.least("ot", "lt"), F.least("om", "lm"), c("ln"), -1, -c("l")),
    )).alias("x")).select("profile", "x.*")
    counts = cells.where("t > 0 and m > 0 and s > 0").groupBy("profile", "t", "m", "s").agg(F.sum("n").alias("n"), F.sum("right").alias("right"))
    place = lambda bars: F.explode(F.sequence(F.lit(1), F.lit(len(bars))))
    total = rows.groupBy("profile").agg(F.count("*").alias("segments"))
    points = total.withColumn("t", place(grid.thresholds)).withColumn("m", place(grid.margins)).withColumn("s", place(grid.least))
    out = points.join(counts, ["profile", "t", "m", "s"], "left").fillna(0, ["n", "right"])
    for axis, others in (("t", ("m", "s")), ("m", ("t", "s")), ("s", ("t", "m"))):
        w = Window.partitionBy("profile", *others).orderBy(F.desc(axis)).rowsBetween(Window.unboundedPreceding, 0)
        out = out.withColumns({"n": F.sum("n").over(w), "right": F.sum("right").over(w)})
    bar = lambda bars, axis, kind: F.element_at(F.array(*[F.lit(b).cast(kind) for b in sorted(bars)]), F.col(axis))
    return out.select(
        "profile", bar(grid.thresholds, "t", "double").alias("threshold"), bar(grid.margins, "m", "double").alias("margin"), bar(grid.least, "s", "long").alias("least"),
        "segments", F.col("n").alias("taken"), "right", (F.col("n") / F.col("segments")).alias("coverage"), (F.col("right") / F.col("segments")).alias("accuracy"),
    )


def best_points(scores: DataFrame, k: int) -> DataFrame:
    """The k best points by accuracy, then coverage; the first profile and the lowest bars on ties."""
    return scores.orderBy(F.desc("accuracy"), F.desc("coverage"), "profile", "threshold", "margin", "least").limit(k)


def sweep(candidates: DataFrame, truth: DataFrame, profiles: list[str], first: Grid, then: Grid, beam: int = 3) -> DataFrame:
    """Two steps: all profiles over the first grid; the best `beam` of (profile, margin) over the thresholds and label sizes of the other. step, then the columns of grid_scores().

    The segments are graded once, as a table, and each step is one pass over it.
    """
    from parlance.tables import materialize

    rows = materialize(graded(candidates, truth, profiles), "graded")
    one = materialize(grid_scores(rows, first), "first-step")
    kept = best_points(one, beam).select("profile", "margin").distinct()
    wide = Grid(then.thresholds, first.margins, then.least)
    two = grid_scores(rows.join(F.broadcast(kept.select("profile").distinct()), "profile", "left_semi"), wide).join(F.broadcast(kept), ["profile", "margin"], "left_semi")  # `beam` rows
    return one.select(F.lit(1).alias("step"), "*").unionByName(two.select(F.lit(2).alias("step"), "*"))
