"""Queries of evidence, styles, signals and experiments."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.operators import evidence as V
from parlance.plans.attribution_queries import _CANDIDATES, _candidates
from parlance.plans.registry import registry
from parlance.session import table
from parlance.sources import adapters as A

QUERIES, SQL, query = registry()

_TOP = f"""WITH {_CANDIDATES}, t AS (SELECT session, seg_idx, arg_min(speaker, rank) AS speaker, max(speaker) FILTER (rank = 2) AS second, max(score) FILTER (rank = 1) AS score, coalesce(max(score) FILTER (rank = 2), 0) AS s2 FROM cand WHERE rank <= 3 GROUP BY ALL)"""


@query(_TOP + """ SELECT session, seg_idx, speaker, round(score - s2, 6) AS margin, CASE WHEN speaker <> second THEN least(speaker, second) || '::' || greatest(speaker, second) END AS pair,
"end" - start >= 0.75 AND score >= 0.3 AND score - s2 >= 0.02 AND NOT (seg_idx % 5 = 0) AS seed FROM segments JOIN t USING (session, seg_idx)""".replace("speaker,", "t.speaker,", 1).replace("WHEN speaker <> second THEN least(speaker, second) || '::' || greatest(speaker, second)", "WHEN t.speaker <> second THEN least(t.speaker, second) || '::' || greatest(t.speaker, second)"))
def j1_c12_segment_evidence(spark, sf):
    s = A.segments(spark, sf).withColumn("overlap_heavy", F.col("seg_idx") % 5 == 0)
    e = V.segment_evidence(_candidates(spark, sf), s, 0.25, 0.2, 0.02)
    return e.select("session", "seg_idx", "speaker", F.round("margin", 6).alias("margin"), "pair", "seed")


@query(f"WITH {_CANDIDATES} SELECT session, seg_idx, speaker, round(least(1.0, (score - 0.1) / 0.9), 9) AS w FROM cand WHERE rank <= 3 AND score > 0.1")
def d17_anchor_edges(spark, sf):
    return V.anchor_edges(_candidates(spark, sf), 0.1).withColumn("w", F.round("w", 9))


@query("""SELECT l_orderkey, l_linenumber, round((greatest(0, 1 - abs(l_quantity - 25) / 20) + greatest(0, 1 - abs(l_discount - 0.05) / 0.05) + greatest(0, 1 - abs(l_tax - 0.04) / 0.04)) / 3, 9) AS score,
CASE WHEN l_returnflag = 'R' THEN 0 WHEN (greatest(0, 1 - abs(l_quantity - 25) / 20) + greatest(0, 1 - abs(l_discount - 0.05) / 0.05) + greatest(0, 1 - abs(l_tax - 0.04) / 0.04)) / 3 >= 0.7 THEN 1 ELSE 2 END AS priority FROM lineitem""")
def e17_c18_style(spark, sf):
    line = table(spark, sf, "lineitem").withColumn("raw", V.style_score({"l_quantity": (25.0, 20.0), "l_discount": (0.05, 0.05), "l_tax": (0.04, 0.04)}))
    return line.select("l_orderkey", "l_linenumber", F.round("raw", 9).alias("score"), V.style_priority(F.col("l_returnflag"), F.col("raw"), "R", 0.7).alias("priority"))


@query("""WITH w AS (SELECT vec_id AS label, embedding::DOUBLE[] AS s FROM embeddings)
SELECT label, len(s) / 16000.0::DOUBLE AS duration, round(sqrt(list_dot_product(s, s) / len(s)), 9) AS rms, list_max(list_transform(s, lambda x: abs(x))) AS peak_abs,
len(list_filter(s, lambda x: abs(x) >= 0.25)) / len(s) AS clipping_fraction, len(list_filter(s, lambda x: abs(x) <= 0.02)) / len(s) AS silence_fraction FROM w""")
def e18_signal_quality(spark, sf):
    w = table(spark, sf, "embeddings").select(F.col("vec_id").alias("label"), F.lit(16000).alias("sample_rate"), F.col("embedding").cast("array<double>").alias("samples"))
    return V.signal_quality(w, 0.25, 0.02).withColumn("rms", F.round("rms", 9))


@query(f"""WITH {A.TURNS}, fr AS (SELECT conv_id AS session, role AS stem, turn * 4.0::DOUBLE AS start, turn * 4.0::DOUBLE + 9 AS "end", length(text) / 100.0::DOUBLE AS power FROM conversations),
p AS (SELECT t.session, seg_idx, stem, avg(power) AS power FROM turns t JOIN fr ON fr.session = t.session AND fr."end" > t.start AND fr.start < t."end" GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY session, seg_idx ORDER BY round(power, 9) DESC, stem) AS r FROM p)
SELECT session, seg_idx, max(stem) FILTER (r = 1) AS stem, round(max(power) FILTER (r = 1) / sum(power), 6) AS dominant_share FROM r GROUP BY session, seg_idx""")
def d15_stem_power(spark, sf):
    c = table(spark, sf, "conversations")
    at = F.col("turn") * 4.0
    frames = c.select(F.col("conv_id").alias("session"), F.col("role").alias("stem"), at.alias("start"), (at + 9).alias("end"), (F.length("text") / 100.0).alias("power"))
    return V.stem_power(A.turn_records(spark, sf), frames).select("session", "seg_idx", "stem", F.round("dominant_share", 6).alias("dominant_share"))


_RESULTS = """r AS (SELECT source AS name, lang AS session, 'mean_chars' AS metric, avg(n_chars) AS value FROM documents GROUP BY ALL), d AS (SELECT r.*, value - b AS delta FROM r LEFT JOIN (SELECT session, metric, value AS b FROM r WHERE name = 'src0') USING (session, metric))"""


def _results(spark, sf):
    r = table(spark, sf, "documents").groupBy(F.col("source").alias("name"), F.col("lang").alias("session")).agg(F.avg("n_chars").alias("value")).withColumn("metric", F.lit("mean_chars"))
    return V.deltas(r, r.where("name = 'src0'"))


@query(f"WITH {_RESULTS} SELECT name, session, metric, round(value, 6) AS value, round(delta, 6) AS delta FROM d")
def d16_deltas(spark, sf):
    return _results(spark, sf).withColumns({"value": F.round("value", 6), "delta": F.round("delta", 6)})


@query(f"""WITH {_RESULTS}, e AS (SELECT name, avg(delta) AS gain, min(delta) AS worst FROM d GROUP BY name)
SELECT name, round(gain, 6) AS gain, round(worst, 6) AS worst, gain >= 50 AND worst >= -500 AS accepted, row_number() OVER (ORDER BY gain >= 50 AND worst >= -500 DESC, gain DESC, worst DESC, name) AS rank FROM e""")
def g7_c21_ranked_experiments(spark, sf):
    e = V.accepted_experiments(_results(spark, sf), 50.0, 500.0)
    return e.select("name", F.round("gain", 6).alias("gain"), F.round("worst", 6).alias("worst"), "accepted", "rank")


@query(f"WITH {A.SEGMENTS} SELECT session, round(median(\"end\" - start), 6) AS median_duration FROM segments GROUP BY session")
def e25_median_durations(spark, sf):
    return A.segments(spark, sf).groupBy("session").agg(F.round(F.median(F.col("end") - F.col("start")), 6).alias("median_duration"))


@query(f"WITH {A.SEGMENTS}, m AS (SELECT session, median(\"end\" - start) AS m FROM segments GROUP BY session) SELECT arg_min(session, (m, session)) AS session FROM m")
def g10_short_slice(spark, sf):
    m = A.segments(spark, sf).groupBy("session").agg(F.median(F.col("end") - F.col("start")).alias("m"))
    return m.agg(F.min_by("session", F.struct("m", "session")).alias("session"))


@query("""SELECT pair, kind, key, n FROM (SELECT source AS pair, 'lang' AS kind, lang AS key, count(*) AS n FROM documents GROUP BY ALL UNION ALL SELECT source, 'length', CASE WHEN n_chars >= 3000 THEN 'long' WHEN n_chars >= 500 THEN 'medium' ELSE 'short' END, count(*) FROM documents GROUP BY ALL)""")
def e22_mining_summary(spark, sf):
    d = table(spark, sf, "documents").select(F.col("source").alias("pair"), "lang", F.when(F.col("n_chars") >= 3000, "long").when(F.col("n_chars") >= 500, "medium").otherwise("short").alias("length"))
    return d.groupingSets([["pair", "lang"], ["pair", "length"]], "pair", "lang", "length").agg(F.count("*").alias("n")).select("pair", F.when(F.col("lang").isNotNull(), "lang").otherwise("length").alias("kind"), F.coalesce("lang", "length").alias("key"), "n")


@query(f"""WITH {A.DATASET} SELECT row_id, p AS pass_index FROM dataset CROSS JOIN (SELECT unnest([0, 1, 2]) AS p)""")
def j8_replayed_passes(spark, sf):
    d = A.dataset(spark, sf).select("row_id")
    return V.passes(d, 3).select("row_id", "pass_index")


@query(f"""WITH {A.SHIFTED} SELECT session, seg_idx, string_agg(word, ' ' ORDER BY start, "end", word_idx) AS text, count(*) AS n FROM shifted GROUP BY session, seg_idx""")
def i10_i11_segment_text(spark, sf):
    w = A.shifted_words(spark, sf).groupBy("session", "seg_idx").agg(F.array_sort(F.collect_list(F.struct("start", "end", "word_idx", "word"))).alias("w"), F.count("*").alias("n"))
    return w.select("session", "seg_idx", F.array_join(F.transform("w", lambda x: x["word"]), " ").alias("text"), "n")


@query(f"""WITH {A.SEGMENTS}, s AS (SELECT session, speaker_raw AS label, speaker, count(*) AS n FROM segments GROUP BY ALL) SELECT session, label, arg_max(speaker, (n, speaker)) AS stem FROM s GROUP BY session, label""")
def d9_label_stems(spark, sf):
    s = A.segments(spark, sf).groupBy("session", F.col("speaker_raw").alias("label"), "speaker").agg(F.count("*").alias("n"))
    return s.groupBy("session", "label").agg(F.max_by("speaker", F.struct("n", "speaker")).alias("stem"))


@query("""SELECT conv_id AS session, i AS part FROM (SELECT conv_id, unnest(generate_series(0, max(turn) + 2)) AS i FROM conversations GROUP BY conv_id) WHERE (conv_id, i) NOT IN (SELECT conv_id, turn FROM conversations)""")
def a19_k5_missing_parts(spark, sf):
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("session"), F.col("turn").alias("part"))
    want = c.groupBy("session").agg(F.max("part").alias("m")).select("session", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") + 2)).alias("part"))
    return want.join(c, ["session", "part"], "left_anti")


@query(f"""WITH {A.SEGMENTS} SELECT session, count(*) AS n, min(start) AS start, max("end") AS "end" FROM segments WHERE speaker IN ('click', 'view') AND session NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') GROUP BY session""")
def c13_allowed_excluded(spark, sf):
    out = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("session")).distinct()
    s = A.segments(spark, sf).where(F.col("speaker").isin("click", "view")).join(out, "session", "left_anti")
    return s.groupBy("session").agg(F.count("*").alias("n"), F.min("start").alias("start"), F.max("end").alias("end"))


@query("""SELECT epoch_us(ts) // 3600000000 * 3600000000 AS start_us, event_type, count(*) AS n, round(avg(value), 6) AS mean_value FROM events GROUP BY ALL""")
def k8_windowed_counts(spark, sf):
    """The batch form of the watermarked window: the same plan runs on a stream."""
    from parlance.streaming.watch import turn_counts

    e = table(spark, sf, "events").selectExpr("cast(ts as timestamp) ts", "event_type", "value")
    return turn_counts(e, "10 minutes", "1 hour", "1 hour").select(F.unix_micros("window.start").alias("start_us"), "event_type", "n", F.round("mean_value", 6).alias("mean_value"))


@query("""WITH n AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS b FROM events), r AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts) AS run FROM n)
SELECT user_id, epoch_us(min(ts)) AS start_us, count(*) AS n FROM r GROUP BY user_id, run""")
def k9_user_sessions(spark, sf):
    from parlance.streaming.watch import user_sessions

    e = table(spark, sf, "events").selectExpr("cast(ts as timestamp) ts", "user_id")
    return user_sessions(e).select("user_id", F.unix_micros("session_window.start").alias("start_us"), "n")
