"""Queries of the candidate pool, evaluation from end to end, and label fallbacks."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.operators import attribution as R
from parlance.operators import datasets as D
from parlance.operators import evaluation as E
from parlance.operators import pool as P
from parlance.plans.attribution_queries import _CANDIDATES
from parlance.plans.bank_queries import _CENTRES, _UNITS
from parlance.plans.registry import registry
from parlance.plans.sequence_queries import _ALIGNED
from parlance.session import table
from parlance.sources import adapters as A

QUERIES, SQL, query = registry()

_POOL = """pool AS (SELECT l_orderkey * 10 + l_linenumber AS row_id, 's' || (l_suppkey % 6) AS speaker, CASE WHEN l_partkey % 11 = 0 THEN 'unknown' ELSE 's' || (l_partkey % 6) END AS second_speaker,
  CASE l_returnflag WHEN 'N' THEN 'low_share' WHEN 'A' THEN 'not_dominant' ELSE 'too_short' END AS rejection, CASE WHEN l_partkey % 13 <> 0 THEN (1 - l_discount * 6)::DOUBLE END AS dominant_share,
  CASE l_linestatus WHEN 'O' THEN 'loud' ELSE 'generic' END AS style_profile FROM lineitem)"""
_HARD = _POOL + """, hard AS (SELECT *, least(speaker, second_speaker) || '::' || greatest(speaker, second_speaker) AS pair, coalesce(dominant_share, 0) AS share FROM pool
  WHERE second_speaker <> 'unknown' AND speaker <> second_speaker AND rejection IN ('low_share', 'not_dominant') AND coalesce(dominant_share, 0) >= 0.55)"""


def _pool(spark, sf):
    line = table(spark, sf, "lineitem")
    c = F.col
    return line.select(
        (c("l_orderkey") * 10 + c("l_linenumber")).alias("row_id"),
        F.concat(F.lit("s"), (c("l_suppkey") % 6).cast("string")).alias("speaker"),
        F.when(c("l_partkey") % 11 == 0, "unknown").otherwise(F.concat(F.lit("s"), (c("l_partkey") % 6).cast("string"))).alias("second_speaker"),
        F.when(c("l_returnflag") == "N", "low_share").when(c("l_returnflag") == "A", "not_dominant").otherwise("too_short").alias("rejection"),
        F.when(c("l_partkey") % 13 != 0, (1 - c("l_discount") * 6).cast("double")).alias("dominant_share"),
        F.when(c("l_linestatus") == "O", "loud").otherwise("generic").alias("style_profile"),
    )


@query(f"""WITH {_HARD} SELECT row_id, pair, CASE WHEN split_part(pair, '::', 2) = speaker THEN split_part(pair, '::', 1) ELSE split_part(pair, '::', 2) END AS partner, 'mixed_rejection_' || rejection AS selection_reason FROM hard WHERE pair IN ('s0::s1', 's2::s5', 's3::s4')""")
def c9_hard_candidates(spark, sf):
    pairs = spark.createDataFrame([("s0::s1",), ("s2::s5",), ("s3::s4",)], "pair string")
    return P.hard_candidates(_pool(spark, sf), pairs).select("row_id", "pair", "partner", "selection_reason")


@query(f"""WITH {_HARD}, w(pair, weight) AS (VALUES ('s0::s1', 1.0::DOUBLE), ('s2::s5', 0.75::DOUBLE), ('s3::s4', 0.5::DOUBLE)),
r AS (SELECT h.*, weight, style_profile = 'loud' AS st, CASE WHEN style_profile = 'loud' THEN 0 ELSE 1 END AS priority FROM hard h JOIN w USING (pair)),
a AS (SELECT *, CASE WHEN st THEN row_number() OVER (PARTITION BY pair, speaker, st ORDER BY weight DESC, priority, row_id) END AS sr FROM r),
b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY pair, speaker ORDER BY coalesce(sr <= 6, false) DESC, weight DESC, priority, row_id) <= 20),
c AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY speaker ORDER BY weight DESC, priority, row_id) <= 15)
SELECT row_id, pair, speaker FROM c ORDER BY weight DESC, priority, row_id LIMIT 60""")
def j6_hard_negatives(spark, sf):
    weights = spark.createDataFrame([("s0::s1", 1.0), ("s2::s5", 0.75), ("s3::s4", 0.5)], "pair string, weight double")
    return P.hard_negatives(_pool(spark, sf), weights, "loud", per_speaker=15, total=60).select("row_id", "pair", "speaker")


@query("""SELECT source || '::' || lang AS pair, metric, CAST(sum(value) AS BIGINT) AS value FROM (SELECT source, lang, 'documents' AS metric, 1 AS value FROM documents UNION ALL SELECT source, lang, 'chars', n_chars FROM documents UNION ALL
SELECT source, lang, 'bad', CASE WHEN quality = 0 THEN 1 END FROM documents LEFT JOIN labels USING (doc_id)) GROUP BY ALL HAVING sum(value) IS NOT NULL OR true""".replace("CAST(sum(value) AS BIGINT)", "CAST(sum(coalesce(value, 0)) AS BIGINT)").replace(" HAVING sum(value) IS NOT NULL OR true", ""))
def e7_pair_metrics(spark, sf):
    d, marks = table(spark, sf, "documents"), table(spark, sf, "labels")
    pair = F.concat_ws("::", "source", "lang").alias("pair")
    rows = d.select(F.col("doc_id").alias("session"), pair, F.lit("documents").alias("metric"), F.lit(1).cast("long").alias("value")).unionByName(d.select(F.col("doc_id").alias("session"), pair, F.lit("chars").alias("metric"), F.col("n_chars").cast("long").alias("value")))
    bad = d.join(marks, "doc_id", "left").select(F.col("doc_id").alias("session"), pair, F.lit("bad").alias("metric"), F.when(F.col("quality") == 0, F.lit(1).cast("long")).alias("value"))
    return E.summed_pair_metrics(rows.unionByName(bad))


_WINDOWED = _ALIGNED + """, m AS (SELECT session, CAST(floor((w.start + w."end") / 2 / 60) AS BIGINT) AS win, actual, predicted FROM aligned JOIN words w USING (session, seg_idx, word_idx))"""


@query(f"""WITH {_WINDOWED} SELECT session, win AS window, count(*) AS total, count(*) FILTER (predicted <> '<unmatched>') AS matched, count(*) FILTER (predicted = actual) AS correct, round(count(*) FILTER (predicted = actual) / count(*), 9) AS accuracy FROM m GROUP BY session, win""")
def j17_evaluation(spark, sf):
    """Reference and recognised words from end to end, by window of a minute."""
    e = E.evaluate(A.words(spark, sf), A.shifted_words(spark, sf), 60.0)
    return e.select("session", "window", "total", "matched", "correct", F.round("accuracy", 9).alias("accuracy"))


@query("""WITH p AS (SELECT conv_id AS session, 'w' || turn AS win, length(text) AS n FROM conversations WHERE role <> 'system'), r AS (SELECT conv_id AS session, 'w' || turn AS win, length(text) AS n FROM conversations WHERE role <> 'assistant')
SELECT session, win AS window, p.n AS n, r.n AS ref_n FROM p JOIN r USING (session, win)""")
def d18_same_windows(spark, sf):
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("session"), F.concat(F.lit("w"), F.col("turn").cast("string")).alias("window"), F.length("text").cast("long").alias("n"), "role")
    return E.same_windows(c.where("role <> 'system'").drop("role"), c.where("role <> 'assistant'").drop("role"))


_PATTERNS = A.SEGMENTS + """, s AS (SELECT *, CASE WHEN seg_idx % 3 = 0 THEN 'view' ELSE speaker END AS predicted, CASE WHEN seg_idx % 7 <> 0 THEN speaker END AS reference FROM segments),
n AS (SELECT *, lag(predicted) OVER w AS b, lead(predicted) OVER w AS a, "end" - start AS d FROM s WINDOW w AS (PARTITION BY session ORDER BY start, "end", seg_idx)),
f AS (SELECT *, predicted = reference AS ok, coalesce(b = a AND b <> predicted, false) AS mid FROM n WHERE reference IS NOT NULL)"""


@query(f"""WITH {_PATTERNS} SELECT session, count(*) AS segments, count(*) FILTER (NOT ok) AS wrong, round(coalesce(median(d) FILTER (ok), 0), 6) AS right_median, round(coalesce(median(d) FILTER (NOT ok), 0), 6) AS wrong_median,
round(coalesce(count(*) FILTER (ok AND d <= 2) / nullif(count(*) FILTER (ok), 0), 0), 9) AS right_short, round(coalesce(count(*) FILTER (NOT ok AND d <= 2) / nullif(count(*) FILTER (NOT ok), 0), 0), 9) AS wrong_short,
count(*) FILTER (mid) AS sandwiches, count(*) FILTER (mid AND NOT ok AND b = reference) AS fixable, count(*) FILTER (mid AND ok) AS already_right FROM f GROUP BY session""")
def e21_error_patterns(spark, sf):
    s = A.segments(spark, sf).withColumns({"predicted": F.when(F.col("seg_idx") % 3 == 0, "view").otherwise(F.col("speaker")), "reference": F.when(F.col("seg_idx") % 7 != 0, F.col("speaker"))})
    return E.error_patterns(s).withColumns({"right_median": F.round("right_median", 6), "wrong_median": F.round("wrong_median", 6), "right_short": F.round("right_short", 9), "wrong_short": F.round("wrong_short", 9)})


_VECTORS = _UNITS + """, lx AS (SELECT session, label, i, avg(v[i]) AS x FROM (SELECT entry_idx % 7 AS session, entry_idx % 5 AS label, v, unnest(generate_series(1, len(v))) AS i FROM un) GROUP BY ALL),
lm AS (SELECT session, label, list(x ORDER BY i) AS m FROM lx GROUP BY session, label), lv AS (SELECT session, label, list_transform(m, lambda x: x / sqrt(list_dot_product(m, m))) AS v FROM lm)"""


def _labelled(spark, sf):
    return A.sessions_of_vectors(spark, sf).withColumn("label", (F.col("seg_idx") % 5).cast("string"))


@query(f"WITH {_VECTORS} SELECT session, CAST(label AS VARCHAR) AS label, round(v[1], 6) AS first, round(v[64], 6) AS last FROM lv")
def e4_label_vectors(spark, sf):
    e = F.col("embedding")
    return R.label_vectors(_labelled(spark, sf)).select("session", "label", F.round(e[0], 6).alias("first"), F.round(e[63], 6).alias("last"))


@query(f"""WITH {_CENTRES}, {_VECTORS.removeprefix(_UNITS + ", ")}, own AS (SELECT DISTINCT entry_idx % 7 AS session, entry_idx % 5 AS label, CASE WHEN entry_idx % 5 = 2 THEN 'spk_2' END AS sp FROM bank),
c AS (SELECT session, label, speaker, list_dot_product(v, centroid) AS score, list_distance(v, centroid) AS d, variance FROM lv CROSS JOIN clusters),
r AS (SELECT *, row_number() OVER (PARTITION BY session, label ORDER BY score DESC, speaker) AS r FROM c WHERE d <= greatest(sqrt(variance) * 2.5, 1e-4)),
t AS (SELECT session, label, arg_min(speaker, r) AS speaker, max(score) FILTER (r = 1) AS s1, coalesce(max(score) FILTER (r = 2), 0) AS s2 FROM r WHERE r <= 2 GROUP BY ALL)
SELECT session, CAST(label AS VARCHAR) AS label, coalesce(sp, CASE WHEN s1 >= 0.3 AND s1 - s2 >= 0.01 THEN speaker END) AS speaker, CASE WHEN sp IS NOT NULL THEN 'segments' WHEN s1 >= 0.3 AND s1 - s2 >= 0.01 THEN 'label_vector' END AS source FROM own LEFT JOIN t USING (session, label)""")
def d12_label_fallback(spark, sf):
    v = _labelled(spark, sf)
    own = v.select("session", "label").distinct().withColumns({"speaker": F.lit("spk_2"), "selected": F.col("label") == "2"})
    return R.label_fallback(own, R.label_vectors(v), A.bank(spark, sf), 0.3, 0.01)


@query(f"""WITH {A.SHIFTED}, v AS (SELECT session, seg_idx, speaker, sum(greatest("end" - start, 0)) AS seconds FROM shifted GROUP BY ALL) SELECT session, seg_idx, arg_min(speaker, (-round(seconds, 6), speaker)) AS speaker FROM v GROUP BY session, seg_idx""")
def e26_duration_votes(spark, sf):
    return R.duration_vote(A.shifted_words(spark, sf)).select("session", "seg_idx", "speaker")


_COUNTED = _CANDIDATES + """, f AS (SELECT session, seg_idx, speaker, CASE WHEN seg_idx % 4 = 0 THEN 'unknown' ELSE speaker END AS old, CASE WHEN seg_idx % 6 = 0 THEN 'view' WHEN seg_idx % 4 = 0 THEN 'unknown' ELSE speaker END AS new FROM segments)"""


@query(f"""WITH {_COUNTED} SELECT session, count(*) AS segments_in, count(*) FILTER (old = 'unknown') AS unknown_in, count(*) FILTER (seg_idx % 5 <> 1) AS segments_out, count(*) FILTER (seg_idx % 5 <> 1 AND new <> 'unknown') AS matched, count(*) FILTER (seg_idx % 5 <> 1 AND new = 'unknown') AS unknown_out, count(*) FILTER (seg_idx % 5 <> 1 AND new <> old) AS changed FROM f GROUP BY session""")
def e24_repair_counters(spark, sf):
    s = A.segments(spark, sf)
    old = F.when(F.col("seg_idx") % 4 == 0, "unknown").otherwise(F.col("speaker"))
    before = s.select("session", "seg_idx", old.alias("speaker"))
    after = s.where("seg_idx % 5 <> 1").select("session", "seg_idx", F.when(F.col("seg_idx") % 6 == 0, "view").otherwise(old).alias("speaker"))
    return R.repair_counters(before, after)


@query(f"""WITH {_COUNTED}, d AS (SELECT *, least(speaker, 'view') || '::' || greatest(speaker, 'view') AS pair, seg_idx % 5 = 0 AS seed, CASE WHEN seg_idx % 3 <> 0 THEN speaker END AS g FROM f WHERE speaker <> 'view')
SELECT pair, count(*) FILTER (seed) AS seeds, count(*) FILTER (NOT seed AND new <> old) AS overrides, count(*) FILTER (NOT seed AND new <> old AND old = 'unknown') AS rescued, count(*) FILTER (NOT seed AND new = old AND g IS NOT NULL) AS unchanged, count(*) FILTER (NOT seed AND g IS NULL) AS unresolved FROM d GROUP BY pair""")
def e24_graph_counters(spark, sf):
    s = A.segments(spark, sf).where("speaker <> 'view'")
    old = F.when(F.col("seg_idx") % 4 == 0, "unknown").otherwise(F.col("speaker"))
    pair = F.concat_ws("::", F.least("speaker", F.lit("view")), F.greatest("speaker", F.lit("view")))
    new, said = F.when(F.col("seg_idx") % 6 == 0, "view").otherwise(old), F.when(F.col("seg_idx") % 3 != 0, F.col("speaker"))
    return R.graph_counters(s.select(pair.alias("pair"), (F.col("seg_idx") % 5 == 0).alias("seed"), old.alias("speaker"), new.alias("final"), said.alias("graph_label")))


@query(f"""WITH {A.SEGMENTS}, s AS (SELECT session, CASE WHEN session % 4 = 0 THEN 'one.wav' ELSE speaker_raw || '.wav' END AS file, seg_idx, CASE WHEN seg_idx % 3 = 0 THEN NULL ELSE speaker END AS speaker, seg_idx % 5 = 0 AS matched FROM segments),
n AS (SELECT session, count(DISTINCT file) AS files FROM s GROUP BY session), l(file, label) AS (VALUES ('one.wav', 'Ann'), ('S0.wav', 'Bob'), ('S1.wav', 'Cem'))
SELECT session, file, seg_idx, CASE WHEN label IS NOT NULL AND CASE WHEN files > 1 THEN NOT matched ELSE speaker IS NULL END THEN label ELSE speaker END AS speaker FROM s JOIN n USING (session) LEFT JOIN l USING (file)""")
def c23_file_labels(spark, sf):
    s = A.segments(spark, sf)
    file = F.when(F.col("session") % 4 == 0, "one.wav").otherwise(F.concat("speaker_raw", F.lit(".wav")))
    s = s.select("session", file.alias("file"), "seg_idx", F.when(F.col("seg_idx") % 3 != 0, F.col("speaker")).alias("speaker"), (F.col("seg_idx") % 5 == 0).alias("matched"))
    return R.file_labels(s, spark.createDataFrame([("one.wav", "Ann"), ("S0.wav", "Bob"), ("S1.wav", "Cem")], "file string, label string"))


@query("""WITH m(ord, key, value) AS (VALUES (1, 'src1', 'Alice'), (2, 'src2', 'Bob')), d AS (SELECT doc_id, trim(CASE WHEN doc_id % 10 = 0 THEN ' ' WHEN doc_id % 11 = 0 THEN 'Unknown' ELSE source || '  ' END) AS raw FROM documents),
x AS (SELECT doc_id, raw, arg_min(value, (CASE WHEN raw = key THEN 1 ELSE 2 END, ord)) FILTER (raw = key OR (length(raw) >= 3 AND (contains(raw, key) OR contains(key, raw)))) AS v FROM d CROSS JOIN m GROUP BY doc_id, raw)
SELECT doc_id, coalesce(v, CASE WHEN lower(raw) IN ('', 'unknown') THEN 'unknown' ELSE raw END) AS label, v IS NOT NULL AS matched FROM x""")
def c2_resolved_labels(spark, sf):
    from parlance.operators.names import resolved_labels

    name = F.when(F.col("doc_id") % 10 == 0, " ").when(F.col("doc_id") % 11 == 0, "Unknown").otherwise(F.concat("source", F.lit("  ")))
    mapping = spark.createDataFrame([(1, "src1", "Alice"), (2, "src2", "Bob")], "ord int, key string, value string")
    return resolved_labels(table(spark, sf, "documents").select("doc_id", name.alias("name")), "doc_id", "name", mapping)


@query(f"""WITH {A.SHIFTED}, w AS (SELECT session, seg_idx, list(word ORDER BY word_idx) AS w, list(speaker ORDER BY word_idx) AS s FROM shifted GROUP BY ALL)
SELECT session, seg_idx, 'Ann' AS speaker, array_to_string(s, ',') AS raws, len(w) AS n FROM w""")
def c17_relabelled_words(spark, sf):
    word = F.struct("word_idx", "word", "speaker", F.lit(None).cast("string").alias("speaker_raw"))
    s = A.shifted_words(spark, sf).groupBy("session", "seg_idx").agg(F.array_sort(F.collect_list(word)).alias("words")).withColumns({"speaker": F.lit(None).cast("string"), "speaker_raw": F.lit(None).cast("string")})
    s = R.relabelled_words(s, F.lit("Ann"))
    return s.select("session", "seg_idx", "speaker", F.array_join(F.transform("words", lambda w: w["speaker_raw"]), ",").alias("raws"), F.size("words").cast("long").alias("n"))


@query(f"""WITH {A.TURNS}, t AS (SELECT session, seg_idx, speaker, start, least("end", start + 8) AS "end" FROM turns WHERE speaker IN ('user', 'assistant') AND least("end", start + 8) - start >= 1.5),
n AS (SELECT *, row_number() OVER (PARTITION BY speaker ORDER BY session, seg_idx) - 1 AS i, count(*) OVER (PARTITION BY speaker) AS n FROM t)
SELECT session, seg_idx, speaker, start, "end" FROM n WHERE n <= 50 OR list_contains(list_transform(generate_series(0, 49), lambda j: CAST(round_even(j * (n - 1) / 49::DOUBLE, 0) AS BIGINT)), i)""")
def c14_clean_segments(spark, sf):
    stems = spark.createDataFrame([("user",), ("assistant",)], "speaker string")
    return D.clean_segments(A.turn_records(spark, sf), stems, 1.5, 8.0, 50).select("session", "seg_idx", "speaker", "start", "end")


@query(f"""WITH {A.DATASET} SELECT label, 'mixed_aug' AS source, count(*) AS n, count(DISTINCT session) AS sessions FROM dataset GROUP BY label""")
def c19_relabelled_sources(spark, sf):
    return D.relabelled_sources(A.dataset(spark, sf), "mixed_aug").groupBy("label", "source").agg(F.count("*").alias("n"), F.countDistinct("session").alias("sessions"))


@query(f"""WITH {A.DATASET} SELECT row_id, label FROM dataset WHERE row_id IN (SELECT l_orderkey * 10 + 1 FROM lineitem)""")
def c20_subset(spark, sf):
    first = table(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + 1).alias("row_id"))
    return D.subset(A.dataset(spark, sf), first).select("row_id", "label")


@query(f"""WITH {A.DATASET} SELECT row_id, label FROM dataset WHERE source = 'bank' UNION ALL SELECT row_id, label FROM dataset WHERE duration > 3""")
def h2_appended(spark, sf):
    d = A.dataset(spark, sf)
    return D.appended(d.where("source = 'bank'"), d.where("duration > 3")).select("row_id", "label")
