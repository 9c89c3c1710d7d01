"""Window and sequence operators: runs, merging, trimming, chopping, sampling, sliding windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_runs(df: DataFrame, keys: list[str], order: list[str], breaks: Column, run: str = "run") -> DataFrame:
    """Number the runs of each key: a row for which breaks holds (or that is the first) starts one. breaks may use lag columns over (keys, order)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    marked = df.withColumn("_new", F.when(F.coalesce(breaks, F.lit(True)), 1).otherwise(0))
    return marked.withColumn(run, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def before(column: str, keys: list[str], order: list[str]) -> Column:
    return F.lag(column).over(Window.partitionBy(*keys).orderBy(*order))


def merge_turns(turns: DataFrame, gap: float = 0.2, least: float = 0.8) -> DataFrame:
    """Neighbours of one speaker at most gap apart become one turn (its end the largest so far); shorter ones than least go."""
    from parlance.operators.lines import Line

    line = Line(turns, ["session"], ["start", "end", "seg_idx"])
    same = line.beside(line.rows, _last=(F.struct("speaker"), 1))
    same = line.running(same, "stretch", (~F.col("_last").eqNullSafe(F.struct("speaker"))).cast("int"), "sum")
    # stretches ascend, so the largest (stretch, end) before a row is of its own stretch or of an earlier one
    so_far = line.running(same, "_far", F.struct("stretch", "end"), "max", own=False)
    far = F.when(F.col("_far.stretch") == F.col("stretch"), F.col("_far.end"))
    runs = line.running(so_far, "run", (far.isNull() | (F.col("start") - far > gap)).cast("int"), "sum")
    merged = runs.groupBy("session", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.first("speaker").alias("speaker"), F.count("*").alias("parts"))
    return merged.where(F.col("end") - F.col("start") >= least).drop("run")


def word_runs(words: DataFrame) -> DataFrame:
    """Consecutive words of one segment and speaker as one row."""
    keys, order = ["session", "seg_idx"], ["word_idx"]
    speaker = before("speaker", keys, order)
    runs = with_runs(words.withColumn("_prev", speaker).withColumn("_i", before("word_idx", keys, order)), keys, order, F.col("_i").isNull() | ~F.col("speaker").eqNullSafe(F.col("_prev")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_idx", "word"))), lambda x: x["word"]), " ")
    return runs.groupBy("session", "seg_idx", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.first("speaker").alias("speaker"), F.count("*").alias("n_words"), text.alias("text"))


def split_on_label_or_gap(words: DataFrame, gap: float = 0.35) -> DataFrame:
    """Repair, first step: a segment breaks where the speaker changes or words lie gap or more apart."""
    keys, order = ["session", "seg_idx"], ["start", "end", "word_idx"]
    w = Window.partitionBy(*keys).orderBy(*order)
    prev_end, prev = F.lag("end").over(w), F.lag("speaker").over(w)
    marked = words.withColumn("_pe", prev_end).withColumn("_ps", prev)
    runs = with_runs(marked, keys, order, F.col("_pe").isNull() | ~F.col("speaker").eqNullSafe(F.col("_ps")) | (F.col("start") - F.col("_pe") >= gap))
    return runs.groupBy(*keys, "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.first("speaker").alias("speaker"), F.count("*").alias("n_words"))


def trim_overlaps(segments: DataFrame, most: float = 0.3, heavy: float = 0.15) -> DataFrame:
    """Neighbours that overlap by up to most meet at the middle; beyond heavy both are flagged."""
    from parlance.operators.lines import Line

    line = Line(segments, ["session"], ["start", "end", "seg_idx"])
    out = line.beside(line.rows, _ns=(F.col("start"), -1), _pe=(F.col("end"), 1))
    out = out.withColumns({"_n": F.col("end") - F.col("_ns"), "_l": F.col("_pe") - F.col("start")})
    cut_n, cut_l = (F.col("_n") > 0) & (F.col("_n") <= most), (F.col("_l") > 0) & (F.col("_l") <= most)
    return out.select(
        "session",
        "seg_idx",
        "speaker",
        F.when(cut_l, (F.col("start") + F.col("_pe")) / 2).otherwise(F.col("start")).alias("start"),
        F.when(cut_n, (F.col("end") + F.col("_ns")) / 2).otherwise(F.col("end")).alias("end"),
        (F.coalesce(cut_n & (F.col("_n") > heavy), F.lit(False)) | F.coalesce(cut_l & (F.col("_l") > heavy), F.lit(False))).alias("overlap_heavy"),
    )


def _joined_runs(segments: DataFrame, joins: Column, end: Column) -> DataFrame:
    """Each row that joins the one before it is one row with that; joins may use _pe and _pr, the end and raw label before."""
    from parlance.operators.lines import Line

    line = Line(segments, ["session"], ["start", "end", "seg_idx"])
    marked = line.beside(line.rows, _pe=(F.col("end"), 1), _pr=(F.col("speaker_raw"), 1))
    runs = line.running(marked, "run", F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1), "sum")
    return runs.groupBy("session", "run").agg(F.min("start").alias("start"), end.alias("end"), F.first("speaker_raw").alias("speaker_raw"), F.count("*").alias("parts")).drop("run")


def merge_same_raw(segments: DataFrame, gap: float = 0.2) -> DataFrame:
    """Repair, merging: neighbours of one non-blank raw label, 0 to gap apart. The merged row ends where its last part ends."""
    apart = F.col("start") - F.col("_pe")
    joins = (F.col("speaker_raw") == F.col("_pr")) & (F.trim("speaker_raw") != "") & (apart >= 0) & (apart <= gap)
    return _joined_runs(segments, joins, F.max_by("end", F.struct("start", "end", "seg_idx")))


def absorb_short(segments: DataFrame, shorter: float = 0.35) -> DataFrame:
    """A segment under `shorter` seconds joins the one before if the raw label is the same."""
    return _joined_runs(segments, (F.col("end") - F.col("start") < shorter) & (F.col("speaker_raw") == F.col("_pr")), F.max("end"))


def training_windows(segments: DataFrame, least: float, most: float, size: float, stride: float) -> DataFrame:
    """Chop segments: one window up to 1.05 times the size, else windows at each stride; the last reaches the segment's end."""
    duration = F.col("end") - F.col("start")
    size = min(size, most) if most > 0 else size
    step = max(stride, least)
    s = segments.withColumn("d", duration).where((F.col("d") > 0) & (F.col("d") >= least))
    n = F.ceil((F.col("d") - size) / step) + 1  # windows up to the first that reaches the end
    starts = F.sequence(F.lit(0), F.when(F.col("d") <= size * 1.05, F.lit(0)).otherwise(F.greatest(n - 1, F.lit(0)).cast("int")))
    s = s.withColumn("i", F.explode(starts))
    at = F.col("start") + F.col("i") * step
    s = s.withColumns({"at": at, "to": F.least(at + size, F.col("end"))}).where((F.col("i") == 0) | ((F.col("at") < F.col("end")) & (F.col("to") - F.col("at") >= least)))
    last = F.col("i") == F.max("i").over(Window.partitionBy("session", "seg_idx"))
    return s.select("session", "seg_idx", "speaker", F.col("i").cast("long").alias("window_index"), F.col("at").alias("start"), F.when(last, F.col("end")).otherwise(F.col("to")).alias("end"))


def _in_windows(records: DataFrame, size: float, hop: float) -> DataFrame:
    """Spoken records with w, the number of each full window that they touch: by arithmetic on the hop, not by a join."""
    last = records.groupBy("session").agg(F.max("end").alias("until"))
    count = F.floor((F.col("until") + 1e-6 - size) / hop)
    spans = last.where(F.col("until") + 1e-6 >= size).select("session", count.alias("most"))
    rows = records.where("nullif(speaker, '') is not null").join(spans, "session")
    first = F.greatest(F.lit(0), F.floor((F.col("start") - size) / hop) + 1)
    final = F.least(F.col("most"), F.ceil(F.col("end") / hop) - 1)
    return rows.where(first <= final).withColumn("w", F.explode(F.sequence(first, final)))


def sliding_windows(records: DataFrame, size: float, hop: float, least_speakers: int) -> DataFrame:
    """Full windows of each session, scored: distinct speakers, speaker changes, words and their balance.

    records: session, seg_idx, start, end, speaker, n_words.
    """
    rows = _in_windows(records, size, hop)
    w = Window.partitionBy("session", "w").orderBy("start", "seg_idx")
    rows = rows.withColumn("turned", (F.col("speaker") != F.lag("speaker").over(w)).cast("int"))
    by_speaker = rows.groupBy("session", "w", "speaker").agg(F.sum("n_words").alias("n"), F.sum("turned").alias("turns"))
    out = by_speaker.groupBy("session", "w").agg(F.count("*").alias("speaker_count"), F.coalesce(F.sum("turns"), F.lit(0)).alias("speaker_turns"), F.sum("n").alias("total_words"), F.max("n").alias("most_words"))
    out = out.where((F.col("speaker_count") >= least_speakers) & (F.col("total_words") > 0))
    score = F.col("speaker_count") * 1000.0 + F.col("speaker_turns") * 10.0 + F.col("total_words") + (1 - F.col("most_words") / F.col("total_words")) * 100.0
    return out.select("session", (F.col("w") * hop).cast("double").alias("start"), (F.col("w") * hop + size).cast("double").alias("end"), score.alias("score"), "speaker_count", "speaker_turns", "total_words")


#: Fixed targets and tolerances of a lively session's windows, and the score from which a window is like one.
LIVELY = {"speaker_count": (6.0, 2.0), "speaker_turns": (100.0, 40.0), "median_turn": (1.1, 1.0), "short_share": (0.55, 0.30), "median_words": (8.0, 4.0)}
LIVELY_LEAST, SHORT_TURN = 0.70, 1.5


def window_styles(records: DataFrame, size: float, hop: float, least_speakers: int, like: dict[str, tuple[float, float]] | None = None, least: float = LIVELY_LEAST) -> DataFrame:
    """sliding_windows() with median_turn (seconds), short_share (turns of 1.5 s at most), median_words, style_score (mean of triangular scores around the targets) and lively."""
    from parlance.operators.evidence import style_score

    length = F.greatest(F.col("end") - F.col("start"), F.lit(0.0))
    turns = _in_windows(records, size, hop).groupBy("session", "w").agg(F.median(length).alias("median_turn"), F.avg((length <= SHORT_TURN).cast("int")).alias("short_share"), F.median("n_words").alias("median_words"))
    turns = turns.select("session", (F.col("w") * hop).cast("double").alias("start"), "median_turn", "short_share", "median_words")
    out = sliding_windows(records, size, hop, least_speakers).join(turns, ["session", "start"]).withColumn("style_score", style_score(like or LIVELY))
    return out.withColumn("lively", F.col("style_score") >= least)


#: Windows of a session that one task may order; longer sessions are worked out in rounds.
WINDOWS = 10_000


def greedy_windows(windows: DataFrame, k: int) -> DataFrame:
    """The k best windows of a session that don't overlap, taken greedily by score (then speakers, turns, earlier start).

    Sessions of at most WINDOWS windows, counted, are ordered in one array each. Beyond that k rounds find the best of each session's windows that none of the chosen overlaps, a
    minimum that tasks combine before it is shuffled.
    """
    from parlance.operators.lines import largest
    from parlance.tables import materialize

    rows = materialize(windows.select("session", "start", "end", "score", "speaker_count", "speaker_turns"), "windows")
    return _greedy_arrays(rows, k) if largest(rows, ["session"]) <= WINDOWS else _greedy_rounds(rows, k)


def _greedy_arrays(rows: DataFrame, k: int) -> DataFrame:
    w = F.struct((-F.col("score")).alias("s"), (-F.col("speaker_count")).alias("c"), (-F.col("speaker_turns")).alias("t"), "start", "end")
    kind = "array<struct<s:double,c:bigint,t:bigint,start:double,end:double>>"

    def take(chosen: Column, x: Column) -> Column:
        clash = F.exists(chosen, lambda y: ~((x["end"] <= y["start"]) | (x["start"] >= y["end"])))
        return F.when(clash | (F.size(chosen) >= k), chosen).otherwise(F.concat(chosen, F.array(x)))

    ranked = rows.groupBy("session").agg(F.array_sort(F.collect_list(w)).cast(kind).alias("all"))
    chosen = F.aggregate("all", F.expr(f"cast(array() as {kind})"), take)
    return ranked.select("session", F.posexplode(chosen).alias("rank", "x")).select("session", (F.col("rank") + 1).cast("long").alias("rank"), "x.start", "x.end", (-F.col("x.s")).alias("score"))


def _greedy_rounds(rows: DataFrame, k: int) -> DataFrame:
    from parlance.tables import materialize

    order = F.struct(-F.col("score"), -F.col("speaker_count"), -F.col("speaker_turns"), "start", "end")
    few = rows.select("session").distinct().count() <= 1_000_000
    taken: DataFrame | None = None
    for rank in range(1, k + 1):
        left = rows
        if taken is not None:  # at most k a session
            chosen = taken.groupBy("session").agg(F.collect_list(F.struct("start", "end")).alias("chosen"))
            left = rows.join(F.broadcast(chosen) if few else chosen, "session").where(~F.exists("chosen", lambda y: ~((F.col("end") <= y["start"]) | (F.col("start") >= y["end"]))))
        best = left.groupBy("session").agg(F.min_by(F.struct("start", "end", "score"), order).alias("b")).select("session", F.lit(rank).cast("long").alias("rank"), "b.*")
        best = materialize(best, "best")
        if best.isEmpty():
            break
        taken = best if taken is None else taken.unionByName(best)
    return taken if taken is not None else rows.select("session", F.lit(0).cast("long").alias("rank"), "start", "end", "score").limit(0)


def every_nth(rows: DataFrame, keys: list[str], order: list[str], limit: int) -> DataFrame:
    """At most limit rows of each key, evenly stepped: every ceil(n / limit)-th, then the first limit of them."""
    w = Window.partitionBy(*keys)
    out = rows.withColumn("_i", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_n", F.count("*").over(w))
    step = F.ceil(F.col("_n") / limit)
    return out.where((F.col("_i") % step == 0) & (F.col("_i") / step < limit)).drop("_i", "_n")


def sample_evenly(rows: DataFrame, keys: list[str], order: list[str], limit: Column | int) -> DataFrame:
    """limit rows of each key at half-even rounded, evenly spaced places; all where there are fewer."""
    limit = F.lit(limit) if isinstance(limit, int) else limit
    out = numbered(rows, keys, order).withColumn("_k", limit.cast("int"))
    # which of the limit places may round to this row: its own share of them, or the one before or after
    step = (F.col("_n") - 1) / F.greatest(F.col("_k") - 1, F.lit(1))
    near = F.round(F.col("_i") / F.greatest(step, F.lit(1e-9)))
    hit = F.lit(False)
    for d in (-1, 0, 1):
        j = near + d
        hit = hit | ((j >= 0) & (j < F.col("_k")) & (F.bround(j * (F.col("_n") - 1) / F.greatest(F.col("_k") - 1, F.lit(1))) == F.col("_i")))
    keep = (F.col("_k") > 0) & ((F.col("_n") <= F.col("_k")) | hit)
    return out.where(keep).drop("_i", "_n", "_k")


def numbered(rows: DataFrame, keys: list[str], order: list[str], parts: int = 64) -> DataFrame:
    """rows with _i (place within the key, from 0) and _n (rows of the key).

    Rows are dealt into ranges of the first order column (if it is a number), numbered within (key, range), and moved up by what earlier ranges of the
    key hold, so a key that holds a third of all rows is many tasks. The bounds are fixed numbers, found first; they needn't be exact quantiles.
    """
    numeric = rows.schema[order[0]].dataType.typeName() in ("byte", "short", "integer", "long", "float", "double")
    bounds = sorted(set(rows.approxQuantile(order[0], [i / parts for i in range(1, parts)], 0.005))) if numeric else []
    part = sum(((F.col(order[0]) > x).cast("int") for x in bounds), F.lit(0))
    spread = rows.withColumn("_part", F.coalesce(part, F.lit(0)))
    counts = spread.groupBy(*keys, "_part").agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*keys)
    counts = counts.select(*keys, "_part", (F.sum("_c").over(w.orderBy("_part")) - F.col("_c")).alias("_before"), F.sum("_c").over(w).alias("_n"))
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys] + [F.col("a._part") == F.col("b._part")]
    inside = spread.withColumn("_i", F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order)) - 1)
    joined = inside.alias("a").join(counts.alias("b"), same)
    return joined.select(*[F.col(f"a.{c}").alias(c) for c in rows.columns], (F.col("a._i") + F.col("b._before")).alias("_i"), F.col("b._n").alias("_n"))


def sandwiches(segments: DataFrame) -> DataFrame:
    """Per session: segments, short ones (2 s at most), median duration, and those between two of one other speaker."""
    from parlance.operators.lines import Line

    line = Line(segments, ["session"], ["start", "end", "seg_idx"])
    s = line.beside(line.rows, p=(F.col("speaker"), 1), x=(F.col("speaker"), -1)).withColumn("d", F.col("end") - F.col("start"))
    return s.groupBy("session").agg(F.count("*").alias("segments"), F.count_if(F.col("d") <= 2).alias("short"), F.round(F.median("d"), 6).alias("median_duration"), F.count_if((F.col("p") == F.col("x")) & (F.col("p") != F.col("speaker"))).alias("sandwiched"))
