"""Queries of trained classifiers and of sweeps over their bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.operators import bank as B
from parlance.operators import classifier as C
from parlance.operators import sweeps as W
from parlance.plans.graph_queries import _EVIDENCE
from parlance.plans.registry import registry
from parlance.sources import adapters as A

QUERIES, SQL, query = registry()

GRID = W.Grid((0.1, 0.2, 0.3, 0.4), (0.0, 0.03, 0.08, 0.2), (1, 3, 6))
FIRST, THEN = W.Grid((0.2,), (0.0, 0.03, 0.08, 0.2), (2,)), W.Grid((0.1, 0.25, 0.4), (0.0,), (1, 3, 8))


def _profiles(spark, sf):
    """Candidates of every vector by centroid and by votes of its neighbours, and its true speaker."""
    b, q = A.bank(spark, sf), A.sessions_of_vectors(spark, sf)
    labels = A.vector_segments(spark, sf).select("session", "seg_idx", F.col("speaker_raw").alias("label"))
    votes = B.knn_votes(q, b, 5).withColumnRenamed("probability", "score")
    ranked = votes.withColumn("rank", F.row_number().over(B.Window.partitionBy("session", "seg_idx").orderBy(F.desc(F.round("score", 9)), "speaker")).cast("long"))
    fields = ["session", "seg_idx", "rank", "speaker", "score"]
    both = B.bank_scores(q, B.clusters_by_speaker(b)).select(F.lit("centroid").alias("profile"), *fields).unionByName(ranked.select(F.lit("knn").alias("profile"), *fields))
    truth = labels.join(q.select("session", "seg_idx", F.col("own").alias("actual")), ["session", "seg_idx"])
    return both.join(labels, ["session", "seg_idx"]), truth, ["centroid", "knn"]


_GRADED = _EVIDENCE + """, votes AS (SELECT seg_idx, speaker, sum(1 / greatest(d, 1e-6)) AS vote FROM (SELECT a.entry_idx AS seg_idx, b.speaker, 1 - list_dot_product(a.v, b.v) AS d FROM un a JOIN un b ON a.entry_idx <> b.entry_idx QUALIFY row_number() OVER (PARTITION BY a.entry_idx ORDER BY list_dot_product(a.v, b.v) DESC, b.entry_idx) <= 5) GROUP BY ALL),
knn AS (SELECT seg_idx % 7 AS session, seg_idx, speaker, vote / sum(vote) OVER (PARTITION BY seg_idx) AS score FROM votes),
cand AS MATERIALIZED (SELECT 'centroid' AS profile, session, seg_idx, rank, speaker, score FROM ranked UNION ALL SELECT 'knn', session, seg_idx, row_number() OVER (PARTITION BY seg_idx ORDER BY round(score, 9) DESC, speaker), speaker, score FROM knn),
cl AS (SELECT c.*, v.speaker_raw AS label FROM cand c JOIN vsegments v USING (session, seg_idx)),
emb AS (SELECT profile, session, label, count(DISTINCT seg_idx) AS n FROM cl GROUP BY ALL),
lm AS (SELECT profile, session, label, speaker, sum(score) / any_value(n) AS mean, any_value(n) AS n FROM cl JOIN emb USING (profile, session, label) GROUP BY ALL),
lr AS (SELECT *, row_number() OVER (PARTITION BY profile, session, label ORDER BY mean DESC, speaker) AS r FROM lm),
lab AS (SELECT profile, session, label, arg_min(speaker, r) AS l_speaker, max(mean) FILTER (r = 1) AS l_score, max(mean) FILTER (r = 1) - coalesce(max(mean) FILTER (r = 2), 0) AS l_margin, any_value(n) AS l_n FROM lr WHERE r <= 2 GROUP BY ALL),
own AS (SELECT profile, session, seg_idx, arg_min(speaker, rank) AS speaker, max(score) FILTER (rank = 1) AS score, max(score) FILTER (rank = 1) - coalesce(max(score) FILTER (rank = 2), 0) AS margin FROM cand WHERE rank <= 2 GROUP BY ALL),
truth AS (SELECT v.session, v.seg_idx, v.speaker_raw AS label, b.speaker AS actual FROM vsegments v JOIN bank b ON b.entry_idx = v.seg_idx),
graded AS MATERIALIZED (SELECT p.profile, t.*, o.speaker, o.score, o.margin, l.l_speaker, l.l_score, l.l_margin, l.l_n FROM truth t CROSS JOIN (SELECT unnest(['centroid', 'knn']) AS profile) p LEFT JOIN own o ON o.profile = p.profile AND o.seg_idx = t.seg_idx
  LEFT JOIN lab l ON l.profile = p.profile AND l.session = t.session AND l.label = t.label)"""


def _points(grid: W.Grid) -> str:
    values = ", ".join(f"({t}::DOUBLE, {m}::DOUBLE, {n}::BIGINT)" for t in grid.thresholds for m in grid.margins for n in grid.least)
    return f"""SELECT profile, threshold, g.margin, least, count(*) AS segments, count(*) FILTER (who IS NOT NULL) AS taken, count(*) FILTER (who = actual) AS "right" FROM
  (SELECT profile, threshold, g.margin, least, actual, CASE WHEN score >= threshold AND x.margin >= g.margin THEN speaker WHEN l_score >= threshold AND l_margin >= g.margin AND l_n >= least THEN l_speaker END AS who
   FROM graded x CROSS JOIN (VALUES {values}) g(threshold, margin, least)) g GROUP BY ALL"""


@query(f"WITH {_GRADED}, s AS ({_points(GRID)}) SELECT profile, threshold, margin, least, segments, taken, \"right\", round(taken / segments, 6) AS coverage, round(\"right\" / segments, 6) AS accuracy FROM s")
def j12_parameter_grid(spark, sf):
    """Accuracy and coverage at every point of a grid, over all segments."""
    s = W.grid_scores(W.graded(*_profiles(spark, sf)), GRID)
    return s.withColumns({c: F.round(c, 6) for c in ("coverage", "accuracy")})


@query(f"""WITH {_GRADED}, a AS MATERIALIZED (SELECT 1 AS step, * FROM ({_points(FIRST)})), beam AS (SELECT DISTINCT profile, margin FROM (SELECT * FROM a ORDER BY "right" / segments DESC, taken / segments DESC, profile, threshold, margin, least LIMIT 3)),
b AS (SELECT 2 AS step, * FROM ({_points(W.Grid(THEN.thresholds, FIRST.margins, THEN.least))}) WHERE (profile, margin) IN (SELECT (profile, margin) FROM beam))
SELECT step, profile, threshold, margin, least, taken, "right" FROM (FROM a UNION ALL FROM b)""")
def j12_sweep_steps(spark, sf):
    s = W.sweep(*_profiles(spark, sf), FIRST, THEN, 3)
    return s.select("step", "profile", "threshold", "margin", "least", "taken", "right")


def _trained(spark, sf, model: str):
    """Fitted to all vectors, then asked for each of them."""
    q = A.sessions_of_vectors(spark, sf)
    fitted = C.fit(q.select(F.col("own").alias("label"), "embedding"), model)
    s = C.score(fitted, q)
    return s.select("session", "seg_idx", "rank", "speaker", F.round("score", 4).alias("score"))


@query()
def j5_logreg(spark, sf):
    """Class-weighted softmax regression."""
    return _trained(spark, sf, "logreg")


@query()
def j5_logreg_unbalanced(spark, sf):
    return _trained(spark, sf, "logreg_unbalanced")


@query()
def j5_lda_logreg(spark, sf):
    """Softmax regression on the discriminant axes."""
    return _trained(spark, sf, "lda_logreg")


@query()
def j5_lda_knn(spark, sf):
    """Distance-weighted votes of the nearest entries on the discriminant axes."""
    return _trained(spark, sf, "lda_knn")


@query()
def j14_augmented(spark, sf):
    """Every vector as 64 samples, as it is and under two draws of the heavy profile: loudness and peak."""
    from parlance.operators.augment import augmented_passes
    from parlance.session import table

    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("row_id"), F.lit(16000).alias("sample_rate"), F.col("embedding").cast("array<float>").alias("samples"))
    out = augmented_passes(rows, ["row_id"], "heavy", 2)
    square = F.aggregate("samples", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    return out.select("row_id", "pass_index", F.round(F.sqrt(square / F.size("samples")), 5).alias("rms"), F.round(F.array_max(F.transform("samples", F.abs)).cast("double"), 5).alias("peak"))
