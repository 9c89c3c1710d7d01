"""Queries that turn candidates into speakers."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.operators import attribution as R
from parlance.plans.registry import registry
from parlance.session import table
from parlance.sources import adapters as A

QUERIES, SQL, query = registry()

_CANDIDATES = A.SEGMENTS + """, c0 AS (SELECT session, speaker_raw AS label, seg_idx, speaker, ("end" - start) / 500 AS score FROM segments
UNION ALL SELECT session, speaker_raw, seg_idx, 'view', 0.25::DOUBLE FROM segments WHERE speaker <> 'view'),
cand AS (SELECT *, row_number() OVER (PARTITION BY session, seg_idx ORDER BY score DESC, speaker) AS rank FROM c0)"""


def _candidates(spark, sf):
    """Two candidates a segment: its own speaker by duration, and a constant one."""
    from pyspark.sql import Window

    s = A.segments(spark, sf)
    own = s.select("session", F.col("speaker_raw").alias("label"), "seg_idx", "speaker", ((F.col("end") - F.col("start")) / 500).alias("score"))
    view = s.where("speaker <> 'view'").select("session", F.col("speaker_raw").alias("label"), "seg_idx", F.lit("view").alias("speaker"), F.lit(0.25).alias("score"))
    rank = F.row_number().over(Window.partitionBy("session", "seg_idx").orderBy(F.desc("score"), "speaker"))
    return own.unionByName(view).withColumn("rank", rank.cast("long"))


def _label_sql(metric: str, order: str) -> str:
    return f"""WITH {_CANDIDATES}, e AS (SELECT session, label, count(DISTINCT seg_idx) AS embedded FROM cand GROUP BY ALL),
b AS (SELECT session, label, speaker, sum(score) / any_value(embedded) AS mean, count(*) AS support, count(*) FILTER (rank = 1) AS votes, max(score) AS score_max, any_value(embedded) AS embedded FROM cand JOIN e USING (session, label) GROUP BY ALL),
r AS (SELECT *, {metric} AS metric, row_number() OVER (PARTITION BY session, label ORDER BY {order}) AS r FROM b),
t AS (SELECT session, label, arg_min(speaker, r) AS speaker, max(mean) FILTER (r = 1) AS score, max(support) FILTER (r = 1) AS support, max(embedded) AS embedded, max(metric) FILTER (r = 1) - coalesce(max(metric) FILTER (r = 2), 0) AS margin FROM r WHERE r <= 2 GROUP BY ALL)
SELECT session, label, speaker, round(score, 5) AS score, support, embedded, round(margin, 6) AS margin, embedded >= 3 AND score >= 0.1 AND margin >= 0.02 AS selected FROM t"""


def _labels(spark, sf, how):
    out = R.label_speakers(_candidates(spark, sf), 0.1, 0.02, 3, how)
    return out.select("session", "label", "speaker", F.round("score", 5).alias("score"), "support", "embedded", F.round("margin", 6).alias("margin"), "selected")


@query(_label_sql("mean", "round(mean, 9) DESC, speaker"))
def e1_label_mean(spark, sf):
    return _labels(spark, sf, "mean")


@query(_label_sql("votes / embedded", "votes DESC, round(mean, 9) DESC, speaker"))
def e1_label_vote(spark, sf):
    return _labels(spark, sf, "vote")


@query(f"""WITH {A.SEGMENTS}, a AS (SELECT session, seg_idx, speaker, ("end" - start) / 500 AS score FROM segments WHERE speaker <> 'error'),
b AS (SELECT session, seg_idx, CASE WHEN speaker_raw = 'S0' THEN speaker ELSE 'other' END AS speaker, 0.3::DOUBLE AS score FROM segments WHERE speaker <> 'click'),
f AS (SELECT session, seg_idx, speaker, coalesce(a.score, 0) AS c, coalesce(b.score, 0) AS k FROM a FULL JOIN b USING (session, seg_idx, speaker))
SELECT session, seg_idx, speaker, c, k, round(0.7 * c + 0.3 * k, 9) AS score, row_number() OVER (PARTITION BY session, seg_idx ORDER BY 0.7::DOUBLE * c + 0.3::DOUBLE * k DESC, c DESC, k DESC, speaker) AS rank FROM f""")
def d5_fused_candidates(spark, sf):
    s = A.segments(spark, sf)
    a = s.where("speaker <> 'error'").select("session", "seg_idx", "speaker", ((F.col("end") - F.col("start")) / 500).alias("score"))
    b = s.where("speaker <> 'click'").select("session", "seg_idx", F.when(F.col("speaker_raw") == "S0", F.col("speaker")).otherwise("other").alias("speaker"), F.lit(0.3).alias("score"))
    return R.fused_candidates(a, b).withColumn("score", F.round("score", 9))


@query(f"""WITH {A.SEGMENTS}, m AS (SELECT session, seg_idx, speaker FROM segments WHERE "end" - start >= 60), l AS (SELECT session, speaker_raw AS label, min(speaker) AS speaker FROM segments GROUP BY ALL HAVING count(*) >= 25)
SELECT session, seg_idx, speaker_raw AS label, coalesce(m.speaker, l.speaker, 'unknown') AS speaker, CASE WHEN m.speaker IS NOT NULL THEN 'segment' WHEN l.speaker IS NOT NULL THEN 'label' ELSE 'none' END AS how
FROM segments s LEFT JOIN m USING (session, seg_idx) LEFT JOIN l ON l.session = s.session AND l.label = s.speaker_raw""")
def d11_resolved_speakers(spark, sf):
    s = A.segments(spark, sf).withColumnRenamed("speaker_raw", "label")
    matches = s.select("session", "seg_idx", "speaker", (F.col("end") - F.col("start") >= 60).alias("matched"))
    labels = s.groupBy("session", "label").agg(F.min("speaker").alias("speaker"), (F.count("*") >= 25).alias("selected"))
    return R.resolve(s.drop("speaker"), matches, labels)


@query("""WITH p AS (SELECT lang || '::' || source AS pair, n_chars > 1000 AS long FROM documents), a AS (SELECT pair, count(*) AS n FROM p WHERE NOT long GROUP BY pair), b AS (SELECT pair, count(*) AS n FROM p WHERE long GROUP BY pair)
SELECT pair, coalesce(a.n, 0) AS pre, coalesce(b.n, 0) AS post, coalesce(b.n, 0) - coalesce(a.n, 0) AS delta FROM a FULL JOIN b USING (pair)""")
def d14_pair_diagnostics(spark, sf):
    p = table(spark, sf, "documents").select(F.concat_ws("::", "lang", "source").alias("pair"), (F.col("n_chars") > 1000).alias("long"))
    count = lambda d: d.groupBy("pair").agg(F.count("*").alias("n"))
    return R.diagnostics(count(p.where("not long")), count(p.where("long")))


@query(f"""WITH {A.SEGMENTS}, o AS (SELECT * FROM (VALUES ('click::view', 0.3), ('error::view', 0.1)) t(pair, margin)),
p AS (SELECT session, seg_idx, CASE WHEN speaker <> lag(speaker) OVER w THEN least(speaker, lag(speaker) OVER w) || '::' || greatest(speaker, lag(speaker) OVER w) END AS pair FROM segments WINDOW w AS (PARTITION BY session ORDER BY seg_idx))
SELECT session, seg_idx, pair, greatest(0.2, coalesce(margin, 0))::DOUBLE AS margin FROM p LEFT JOIN o USING (pair)""")
def d13_pair_overrides(spark, sf):
    from pyspark.sql import Window

    from parlance.functions.text import pair_key

    w = Window.partitionBy("session").orderBy("seg_idx")
    own = spark.createDataFrame([("click::view", 0.3), ("error::view", 0.1)], "pair string, own double")
    p = A.segments(spark, sf).select("session", "seg_idx", pair_key(F.col("speaker"), F.lag("speaker").over(w)).alias("pair"))
    return p.join(F.broadcast(own), "pair", "left").select("session", "seg_idx", "pair", F.greatest(F.lit(0.2), F.coalesce("own", F.lit(0.0))).alias("margin"))


@query(f"""WITH {A.SEGMENTS}, s AS (SELECT session, seg_idx, speaker, greatest(0, least(1, (("end" - start) / 100 - 0.25) / 0.75)) AS weight FROM segments WHERE ("end" - start) / 100 > 0.25)
SELECT session, seg_idx, speaker, round(weight, 9) AS weight FROM s""")
def g9_candidate_score_map(spark, sf):
    s = A.segments(spark, sf).withColumn("raw", (F.col("end") - F.col("start")) / 100).where("raw > 0.25")
    return s.select("session", "seg_idx", "speaker", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("raw") - 0.25) / 0.75)), 9).alias("weight"))
