"""Queries over turns, words and segments in time."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.operators import evaluation, intervals, sequences
from parlance.plans.registry import registry
from parlance.sources import adapters as A

QUERIES, SQL, query = registry()

_WINDOWS = A.TURNS + """, spans AS (SELECT session, max("end") AS until FROM turns GROUP BY session),
wins AS (SELECT session, unnest(generate_series(0, CAST(floor((until + 1e-6 - 60) / 15) AS BIGINT))) AS w FROM spans WHERE until + 1e-6 >= 60),
rws AS (SELECT t.*, w FROM turns t JOIN wins USING (session) WHERE t."end" > w * 15 AND t.start < w * 15 + 60 AND nullif(speaker, '') IS NOT NULL),
chg AS (SELECT *, CASE WHEN speaker <> lag(speaker) OVER (PARTITION BY session, w ORDER BY start, seg_idx) THEN 1 ELSE 0 END AS c FROM rws),
sp AS (SELECT session, w, speaker, sum(n_words) AS n, sum(c) AS c FROM chg GROUP BY ALL),
sc AS (SELECT session, w, count(*) AS speaker_count, sum(c) AS speaker_turns, sum(n) AS total_words, max(n) AS top FROM sp GROUP BY ALL),
scored AS (SELECT session, w * 15.0::DOUBLE AS start, w * 15.0::DOUBLE + 60 AS "end",
  speaker_count * 1000.0::DOUBLE + speaker_turns * 10.0::DOUBLE + total_words + (1 - top / total_words::DOUBLE) * 100.0::DOUBLE AS score, speaker_count, speaker_turns::BIGINT AS speaker_turns, total_words::BIGINT AS total_words
  FROM sc WHERE speaker_count >= 2 AND total_words > 0)"""


@query(f"WITH {_WINDOWS} SELECT session, start, \"end\", round(score, 6) AS score, speaker_count, speaker_turns, total_words FROM scored")
def f1_sliding_windows(spark, sf):
    return sequences.sliding_windows(A.turn_records(spark, sf), 60, 15, 2).withColumn("score", F.round("score", 6))


@query(f"""WITH {_WINDOWS}, st AS (SELECT session, w * 15.0::DOUBLE AS start, median("end" - start) AS mt, avg(CASE WHEN "end" - start <= 1.5 THEN 1 ELSE 0 END) AS ss, median(n_words) AS mw FROM rws GROUP BY session, w),
y AS (SELECT *, (greatest(0, 1 - abs(speaker_count - 6) / 2) + greatest(0, 1 - abs(speaker_turns - 100) / 40) + greatest(0, 1 - abs(mt - 1.1) / 1.0) + greatest(0, 1 - abs(ss - 0.55) / 0.3) + greatest(0, 1 - abs(mw - 8) / 4)) / 5 AS style FROM scored JOIN st USING (session, start))
SELECT session, start, round(mt, 6) AS median_turn, round(ss, 6) AS short_share, mw::DOUBLE AS median_words, round(style, 6) AS style_score, style >= 0.05 AS lively FROM y""")
def e16_window_styles(spark, sf):
    """Medians, short turns and style of every scored window."""
    s = sequences.window_styles(A.turn_records(spark, sf), 60, 15, 2, least=0.05)
    return s.select("session", "start", F.round("median_turn", 6).alias("median_turn"), F.round("short_share", 6).alias("short_share"), "median_words", F.round("style_score", 6).alias("style_score"), "lively")


@query(f"""WITH {_WINDOWS}, o AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY score DESC, speaker_count DESC, speaker_turns DESC, start) AS r FROM scored),
a AS (SELECT * FROM o WHERE r = 1),
b AS (SELECT o.* FROM o JOIN a USING (session) WHERE o."end" <= a.start OR o.start >= a."end" QUALIFY row_number() OVER (PARTITION BY o.session ORDER BY o.r) = 1),
c AS (SELECT o.* FROM o JOIN a USING (session) JOIN b ON b.session = o.session WHERE (o."end" <= a.start OR o.start >= a."end") AND (o."end" <= b.start OR o.start >= b."end") QUALIFY row_number() OVER (PARTITION BY o.session ORDER BY o.r) = 1)
SELECT session, 1::BIGINT AS rank, start, "end", round(score, 6) AS score FROM a UNION ALL SELECT session, 2, start, "end", round(score, 6) FROM b UNION ALL SELECT session, 3, start, "end", round(score, 6) FROM c""")
def g2_greedy_windows(spark, sf):
    return sequences.greedy_windows(sequences.sliding_windows(A.turn_records(spark, sf), 60, 15, 2), 3).withColumn("score", F.round("score", 6))


@query(f"""WITH {A.TURNS}, s AS (SELECT *, "end" - start AS d FROM turns WHERE "end" - start >= 2),
w AS (SELECT *, unnest(CASE WHEN d <= 4 * 1.05 THEN [0] ELSE generate_series(0, greatest(0, CAST(ceil((d - 4) / 3) AS BIGINT))) END) AS i FROM s),
x AS (SELECT *, start + i * 3 AS a, least(start + i * 3 + 4, "end") AS b FROM w),
y AS (SELECT * FROM x WHERE i = 0 OR (a < "end" AND b - a >= 2))
SELECT session, seg_idx, speaker, i AS window_index, a AS start, CASE WHEN i = max(i) OVER (PARTITION BY session, seg_idx) THEN "end" ELSE b END AS "end" FROM y""")
def f2_training_windows(spark, sf):
    return sequences.training_windows(A.turn_records(spark, sf), 2.0, 4.0, 5.0, 3.0)


@query(f"""WITH {A.SEGMENTS}, a AS (SELECT *, CASE WHEN speaker IS NOT DISTINCT FROM lag(speaker) OVER w THEN 0 ELSE 1 END AS n FROM segments WINDOW w AS (PARTITION BY session ORDER BY start, "end", seg_idx)),
b AS (SELECT *, sum(n) OVER (PARTITION BY session ORDER BY start, "end", seg_idx) AS st FROM a),
c AS (SELECT *, max("end") OVER (PARTITION BY session, st ORDER BY start, "end", seg_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS sf FROM b),
d AS (SELECT *, sum(CASE WHEN sf IS NULL OR start - sf > 60 THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY start, "end", seg_idx) AS run FROM c)
SELECT session, min(start) AS start, max("end") AS "end", any_value(speaker) AS speaker, count(*) AS parts FROM d GROUP BY session, run HAVING max("end") - min(start) >= 5""")
def f3_merge_turns(spark, sf):
    return sequences.merge_turns(A.segments(spark, sf), gap=60.0, least=5.0)


@query(f"""WITH {A.SHIFTED}, a AS (SELECT *, CASE WHEN speaker IS NOT DISTINCT FROM lag(speaker) OVER w AND lag(word_idx) OVER w IS NOT NULL THEN 0 ELSE 1 END AS n FROM shifted WINDOW w AS (PARTITION BY session, seg_idx ORDER BY word_idx)),
b AS (SELECT *, sum(n) OVER (PARTITION BY session, seg_idx ORDER BY word_idx)::BIGINT AS run FROM a)
SELECT session, seg_idx, run, min(start) AS start, max("end") AS "end", any_value(speaker) AS speaker, count(*) AS n_words, string_agg(word, ' ' ORDER BY word_idx) AS text FROM b GROUP BY session, seg_idx, run""")
def f4_word_runs(spark, sf):
    return sequences.word_runs(A.shifted_words(spark, sf))


@query(f"""WITH {A.SHIFTED}, a AS (SELECT *, CASE WHEN speaker IS NOT DISTINCT FROM lag(speaker) OVER w AND start - lag("end") OVER w < 0.6 THEN 0 ELSE 1 END AS n FROM shifted WINDOW w AS (PARTITION BY session, seg_idx ORDER BY start, "end", word_idx)),
b AS (SELECT *, sum(n) OVER (PARTITION BY session, seg_idx ORDER BY start, "end", word_idx)::BIGINT AS run FROM a)
SELECT session, seg_idx, run, min(start) AS start, max("end") AS "end", any_value(speaker) AS speaker, count(*) AS n_words FROM b GROUP BY session, seg_idx, run""")
def f5a_split_segments(spark, sf):
    return sequences.split_on_label_or_gap(A.shifted_words(spark, sf), 0.6)


_NEIGHBOURS = f"""WITH {A.SEGMENTS}, n AS (SELECT *, "end" - lead(start) OVER w AS nx, lag("end") OVER w - start AS ls, lead(start) OVER w AS ns, lag("end") OVER w AS pe, lag(speaker_raw) OVER w AS pr FROM segments WINDOW w AS (PARTITION BY session ORDER BY start, "end", seg_idx))"""


@query(_NEIGHBOURS + """ SELECT session, seg_idx, speaker, CASE WHEN ls > 0 AND ls <= 30 THEN (start + pe) / 2 ELSE start END AS start, CASE WHEN nx > 0 AND nx <= 30 THEN ("end" + ns) / 2 ELSE "end" END AS "end",
coalesce(nx > 15 AND nx <= 30, false) OR coalesce(ls > 15 AND ls <= 30, false) AS overlap_heavy FROM n""")
def f5b_trim_overlaps(spark, sf):
    return sequences.trim_overlaps(A.segments(spark, sf), 30.0, 15.0)


@query(_NEIGHBOURS + """, r AS (SELECT *, sum(CASE WHEN speaker_raw = pr AND start - pe >= 0 AND start - pe <= 200 THEN 0 ELSE 1 END) OVER (PARTITION BY session ORDER BY start, "end", seg_idx) AS run FROM n)
SELECT session, min(start) AS start, arg_max("end", (start, "end", seg_idx)) AS "end", any_value(speaker_raw) AS speaker_raw, count(*) AS parts FROM r GROUP BY session, run""")
def f5c_merge_same_raw(spark, sf):
    return sequences.merge_same_raw(A.segments(spark, sf), 200.0)


@query(_NEIGHBOURS + """, r AS (SELECT *, sum(CASE WHEN "end" - start < 20 AND speaker_raw = pr THEN 0 ELSE 1 END) OVER (PARTITION BY session ORDER BY start, "end", seg_idx) AS run FROM n)
SELECT session, min(start) AS start, max("end") AS "end", any_value(speaker_raw) AS speaker_raw, count(*) AS parts FROM r GROUP BY session, run""")
def f5d_absorb_short(spark, sf):
    return sequences.absorb_short(A.segments(spark, sf), 20.0)


@query(f"""WITH {A.TURNS}, c AS (SELECT session, CASE WHEN speaker <> lag(speaker) OVER (PARTITION BY session ORDER BY seg_idx) THEN 1 ELSE 0 END AS c FROM turns WHERE speaker IS NOT NULL)
SELECT session, sum(c)::BIGINT AS turns FROM c GROUP BY session""")
def f8_turn_counts(spark, sf):
    t = A.turn_records(spark, sf).where("speaker is not null")
    changed = (F.col("speaker") != sequences.before("speaker", ["session"], ["seg_idx"])).cast("int")
    return t.select("session", changed.alias("c")).groupBy("session").agg(F.coalesce(F.sum("c"), F.lit(0)).alias("turns"))


@query(f"""WITH {A.SEGMENTS} SELECT session, seg_idx, speaker FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY seg_idx) - 1 AS i, count(*) OVER (PARTITION BY session) AS n FROM segments)
WHERE i % CAST(ceil(n / 10.0) AS BIGINT) = 0 AND i / CAST(ceil(n / 10.0) AS DOUBLE) < 10""")
def f11_every_nth(spark, sf):
    return sequences.every_nth(A.segments(spark, sf), ["session"], ["seg_idx"], 10).select("session", "seg_idx", "speaker")


@query(f"""WITH {A.SEGMENTS}, n AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY seg_idx) - 1 AS i, count(*) OVER (PARTITION BY session) AS n FROM segments)
SELECT session, seg_idx, speaker FROM n WHERE n <= 7 OR list_contains(list_transform(generate_series(0, 6), lambda j: CAST(round_even(j * (n - 1) / 6.0, 0) AS BIGINT)), i)""")
def f12_sample_evenly(spark, sf):
    return sequences.sample_evenly(A.segments(spark, sf), ["session"], ["seg_idx"], 7).select("session", "seg_idx", "speaker")


@query(f"""WITH {A.SEGMENTS}, n AS (SELECT *, lag(speaker) OVER w AS p, lead(speaker) OVER w AS x, "end" - start AS d FROM segments WINDOW w AS (PARTITION BY session ORDER BY start, "end", seg_idx))
SELECT session, count(*) AS segments, count(*) FILTER (d <= 2) AS short, round(median(d), 6) AS median_duration, count(*) FILTER (p = x AND p <> speaker) AS sandwiched FROM n GROUP BY session""")
def f13_sandwiches(spark, sf):
    return sequences.sandwiches(A.segments(spark, sf))


@query(f"""WITH {A.SHIFTED}, p AS (
  SELECT s.session, s.seg_idx, s.word_idx, t.speaker AS tsp, t.seg_idx AS ti, greatest(0, least(s."end", t."end") - greatest(s.start, t.start)) AS o,
         t.start <= (s.start + s."end") / 2 AND (s.start + s."end") / 2 <= t."end" AS holds, least(abs((s.start + s."end") / 2 - t.start), abs((s.start + s."end") / 2 - t."end")) AS gap
  FROM shifted s JOIN turns t USING (session))
SELECT session, seg_idx, word_idx, coalesce(arg_min(tsp, (-o, ti)) FILTER (o > 0), arg_max(tsp, ti) FILTER (holds), arg_min(tsp, (gap, ti))) AS turn_speaker FROM p GROUP BY session, seg_idx, word_idx""")
def d1_words_to_turns(spark, sf):
    turns = A.turn_records(spark, sf).select("session", F.col("seg_idx").alias("turn_idx"), "start", "end", "speaker")
    return intervals.label_by_overlap(A.shifted_words(spark, sf), turns).select("session", "seg_idx", "word_idx", "turn_speaker")


_ALIGNED = A.SHIFTED + """, p AS (
  SELECT w.session, w.seg_idx, w.word_idx, s.speaker AS sp, s.start AS ss, s."end" AS se, s.seg_idx AS i, s.word_idx AS j, abs((s.start + s."end") / 2 - m) AS md,
         CASE WHEN m BETWEEN s.start AND s."end" THEN 0.0::DOUBLE ELSE least(abs(m - s.start), abs(m - s."end")) END AS gap
  FROM (SELECT *, (start + "end") / 2 AS m FROM words) w JOIN shifted s ON s.session = w.session AND s.start <= m + 0.35 AND s."end" >= m - 0.35),
best AS (SELECT session, seg_idx, word_idx, arg_min(sp, (gap, md, ss, se, i, j)) AS predicted FROM p WHERE gap <= 0.35 GROUP BY ALL),
aligned AS (SELECT w.session, w.seg_idx, w.word_idx, w.speaker AS actual, coalesce(predicted, '<unmatched>') AS predicted FROM words w LEFT JOIN best USING (session, seg_idx, word_idx))"""


def _aligned(spark, sf):
    return intervals.nearest_words(A.words(spark, sf), A.shifted_words(spark, sf))


@query(f"WITH {_ALIGNED} SELECT * FROM aligned")
def d2_nearest_words(spark, sf):
    return _aligned(spark, sf)


@query(f"""WITH {_ALIGNED}, m AS (SELECT session, count(*) AS total, count(*) FILTER (predicted <> '<unmatched>') AS matched, count(*) FILTER (predicted = actual) AS correct FROM aligned GROUP BY session)
SELECT *, round(matched / total, 9) AS coverage, round(correct / total, 9) AS accuracy, round(CASE WHEN matched > 0 THEN correct / matched ELSE 0.0 END, 9) AS matched_accuracy FROM m""")
def e5_alignment_metrics(spark, sf):
    m = evaluation.alignment_metrics(_aligned(spark, sf), ["session"])
    return m.withColumns({c: F.round(c, 9) for c in ("coverage", "accuracy", "matched_accuracy")})


@query(f"""WITH {_ALIGNED} SELECT least(actual, predicted) || '::' || greatest(actual, predicted) AS pair, count(*) AS n FROM aligned
WHERE lower(trim(actual)) NOT IN ('', 'unknown', '<unmatched>') AND lower(trim(predicted)) NOT IN ('', 'unknown', '<unmatched>') AND actual <> predicted GROUP BY 1""")
def e6_confusion_pairs(spark, sf):
    return evaluation.confusion_pairs(evaluation.confusion(_aligned(spark, sf)))


@query(f"WITH {_ALIGNED} SELECT session, actual, predicted, count(*) AS n FROM aligned GROUP BY ALL")
def e27_confusion_by_session(spark, sf):
    return evaluation.confusion(_aligned(spark, sf), ["session"])


@query(f"""WITH {_ALIGNED}, m AS (SELECT session, count(*) AS total, count(*) FILTER (predicted = actual) AS correct FROM aligned GROUP BY session), s AS (SELECT session, avg(correct / total) AS m FROM m GROUP BY session)
SELECT round((SELECT avg(correct / total) FROM m), 6) AS mean_of_windows, round((SELECT sum(correct) / sum(total) FROM m), 6) AS pooled, round((SELECT avg(m) FROM s), 6) AS mean_of_sessions""")
def e13_rollup(spark, sf):
    m = evaluation.alignment_metrics(_aligned(spark, sf), ["session"])
    return evaluation.rolled_up(m).select(*[F.round(c, 6).alias(c) for c in ("mean_of_windows", "pooled", "mean_of_sessions")])


@query(f"""WITH {A.SHIFTED}, p AS (SELECT t.session, t.seg_idx, s.speaker AS sp, s.start AS ss FROM turns t JOIN shifted s ON s.session = t.session
  AND (least(s."end", t."end") - greatest(s.start, t.start) > 0 OR (s.start + s."end") / 2 BETWEEN t.start - 0.35 AND t."end" + 0.35)),
v AS (SELECT session, seg_idx, sp, count(*) AS n, min(ss) AS seen FROM p GROUP BY ALL)
SELECT session, seg_idx, sum(n)::BIGINT AS n_words, arg_min(sp, (-n, seen, sp)) AS dominant, max(n) AS n_dominant FROM v GROUP BY session, seg_idx""")
def d3_dominant_speaker(spark, sf):
    return intervals.dominant_speaker(A.turn_records(spark, sf), A.shifted_words(spark, sf))


@query(f"""WITH {A.SEGMENTS}, n AS (SELECT session, seg_idx, lead(seg_idx) OVER w AS next_idx, greatest(lead(start) OVER w - "end", start - lead("end") OVER w, 0) AS gap FROM segments WINDOW w AS (PARTITION BY session ORDER BY seg_idx))
SELECT session, seg_idx, next_idx, round(0.35 * exp(-gap / 0.75), 9) AS weight FROM n WHERE next_idx IS NOT NULL AND gap <= 2""")
def d7_adjacent_pairs(spark, sf):
    from pyspark.sql import Window

    from parlance.operators.attribution import temporal_weight

    w = Window.partitionBy("session").orderBy("seg_idx")
    gap = F.greatest(F.lead("start").over(w) - F.col("end"), F.col("start") - F.lead("end").over(w), F.lit(0.0))
    s = A.segments(spark, sf).select("session", "seg_idx", F.lead("seg_idx").over(w).alias("next_idx"), gap.alias("gap"))
    return s.where("next_idx is not null and gap <= 2").select("session", "seg_idx", "next_idx", F.round(temporal_weight(F.col("gap")), 9).alias("weight"))


def _flips(size: int, of: str) -> str:
    """Places that fit, on the speakers of table `of`; of those the first, then always the next that lies more than size places on (what is between is unfit once that is done); and the speakers after it."""
    inner = range(size)
    at = lambda c, j: c if j == 0 else f"lag({c}) OVER w" if j < 0 else f"lead({c}, {j}) OVER w"
    gaps = " AND ".join(f"{at('start', j + 1)} - {at(chr(34) + 'end' + chr(34), j)} <= 1e6" for j in range(-1, size))
    fits = " AND ".join([f"{at('who', -1)} = {at('who', size)}", f"{at('who', -1)} NOT IN ('', 'unknown')", gaps, *(f"{at('who', j)} IS DISTINCT FROM {at('who', -1)} AND {at('weak', j)}" for j in inner), " + ".join(f"{at(chr(34) + 'end' + chr(34), j)} - {at('start', j)}" for j in inner) + " <= 60"])
    return f"""c{size} AS MATERIALIZED (SELECT session, i, l FROM (SELECT session, i, {at('who', -1)} AS l, {fits} AS fits FROM {of} WINDOW w AS (PARTITION BY session ORDER BY i)) WHERE fits),
p{size} AS (SELECT session, min(i) AS i FROM c{size} GROUP BY session UNION ALL SELECT p.session, min(c.i) AS i FROM p{size} p JOIN c{size} c ON c.session = p.session AND c.i > p.i + {size} GROUP BY p.session),
n{size} AS MATERIALIZED (SELECT o.* REPLACE (coalesce(t.l, o.who) AS who) FROM {of} o LEFT JOIN (SELECT c.session, c.i + unnest(range({size})) AS i, l FROM c{size} c SEMI JOIN p{size} p USING (session, i)) t ON t.session = o.session AND t.i = o.i)"""


@query(f"""WITH RECURSIVE {A.SEGMENTS}, o AS MATERIALIZED (SELECT session, seg_idx, start, "end", speaker, speaker AS who, seg_idx % 4 <> 0 AS weak, row_number() OVER (PARTITION BY session ORDER BY start, "end", seg_idx) AS i FROM segments),
{_flips(2, 'o')}, {_flips(1, 'n2')} SELECT session, seg_idx, speaker, who AS smoothed FROM n1""")
def f6_smooth_flips(spark, sf):
    from parlance.operators.attribution import smooth_flips

    s = A.segments(spark, sf).withColumn("score", F.when(F.col("seg_idx") % 4 == 0, 0.9).otherwise(0.2))
    return smooth_flips(s, 2, 60.0, 1e6, 0.5)
