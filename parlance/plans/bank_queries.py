"""Queries of the vector bank."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.operators import bank as B
from parlance.operators import clusters as K
from parlance.plans.registry import registry
from parlance.sources import adapters as A

QUERIES, SQL, query = registry()

_UNITS = A.BANK + """, un AS (SELECT entry_idx, speaker, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM bank),
qn AS (SELECT session, seg_idx, own, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM queries)"""

_CENTRES = _UNITS + """, ex AS (SELECT speaker, i, avg(v[i]) AS x FROM (SELECT speaker, v, unnest(generate_series(1, len(v))) AS i FROM un) GROUP BY ALL),
mean AS (SELECT speaker, list(x ORDER BY i) AS m FROM ex GROUP BY speaker),
centre AS (SELECT speaker, list_transform(m, lambda x: x / sqrt(list_dot_product(m, m))) AS centroid FROM mean),
clusters AS (SELECT speaker, any_value(centroid) AS centroid, avg(pow(list_distance(v, centroid), 2)) AS variance, count(*) AS members FROM un JOIN centre USING (speaker) GROUP BY speaker)"""

#: Each query meets the clusters of all entries but itself.
_RAW = _CENTRES + """, qx AS (SELECT seg_idx, u.speaker, u.v, unnest(generate_series(1, len(u.v))) AS i FROM qn q JOIN un u ON u.speaker = q.own AND u.entry_idx <> q.seg_idx),
qm AS (SELECT seg_idx, speaker, list(x ORDER BY i) AS m FROM (SELECT seg_idx, speaker, i, avg(v[i]) AS x FROM qx GROUP BY ALL) GROUP BY ALL),
qc AS (SELECT seg_idx, speaker, list_transform(m, lambda x: x / sqrt(list_dot_product(m, m))) AS centroid FROM qm),
qv AS (SELECT qc.seg_idx, qc.speaker, any_value(centroid) AS centroid, avg(pow(list_distance(u.v, centroid), 2)) AS variance FROM qc JOIN un u ON u.speaker = qc.speaker AND u.entry_idx <> qc.seg_idx GROUP BY ALL),
met AS (SELECT q.session, q.seg_idx, q.v, c.speaker, c.centroid AS w, c.variance, -1 AS place FROM qn q JOIN clusters c ON c.speaker IS DISTINCT FROM q.own
  UNION ALL SELECT q.session, q.seg_idx, q.v, speaker, centroid, variance, -1 FROM qn q JOIN qv USING (seg_idx)),
raw AS (SELECT session, seg_idx, speaker, list_dot_product(v, w) AS score, list_distance(v, w) AS distance, variance, place FROM met)"""

_RANKED = _RAW + """, ranked AS (SELECT session, seg_idx, speaker, score, distance, row_number() OVER (PARTITION BY session, seg_idx ORDER BY score DESC, speaker) AS rank FROM raw WHERE distance <= greatest(sqrt(variance) * 2.5, 1e-4))"""

_EXAMPLES = """, ex3 AS (SELECT speaker, entry_idx, un.v, variance, row_number() OVER (PARTITION BY speaker ORDER BY list_distance(v, centroid), entry_idx) - 1 AS place FROM un JOIN clusters USING (speaker) QUALIFY place < 3)"""


def _scores(spark, sf, radius=2.5):
    return B.bank_scores(A.queries(spark, sf), B.clusters_by_speaker(A.bank(spark, sf)), radius)


@query(f"WITH {_CENTRES} SELECT speaker, round(variance, 6) AS variance, members, round(centroid[1], 6) AS first FROM clusters")
def e2_e3_centroids(spark, sf):
    c = B.clusters_by_speaker(A.bank(spark, sf))
    return c.select("speaker", F.round("variance", 6).alias("variance"), "members", F.round(F.col("centroid")[0], 6).alias("first"))


@query(f"WITH {_RANKED} SELECT session, seg_idx, rank, speaker, round(score, 6) AS score, round(distance, 6) AS distance FROM ranked")
def d4_bank_scores(spark, sf):
    return _scores(spark, sf).select("session", "seg_idx", "rank", "speaker", F.round("score", 6).alias("score"), F.round("distance", 6).alias("distance"))


@query(f"WITH {_CENTRES}{_EXAMPLES} SELECT speaker, place, entry_idx FROM ex3")
def g5_prototypes(spark, sf):
    b = A.bank(spark, sf)
    return B.prototypes(b, B.clusters_by_speaker(b), 3).select("speaker", "place", "entry_idx")


@query(f"""WITH {_RAW}{_EXAMPLES}, all_met AS (SELECT session, seg_idx, speaker, score, distance, variance, place FROM raw UNION ALL
  SELECT session, seg_idx, speaker, list_dot_product(qn.v, ex3.v), list_distance(qn.v, ex3.v), variance, place FROM qn JOIN ex3 ON entry_idx <> seg_idx),
best AS (SELECT session, seg_idx, speaker, arg_max({{'score': score, 'source': CASE WHEN place < 0 THEN 'centroid' ELSE 'prototype' END}}, (score, -place)) AS b FROM all_met WHERE distance <= greatest(sqrt(variance) * 2.5, 1e-4) GROUP BY ALL)
SELECT session, seg_idx, row_number() OVER (PARTITION BY session, seg_idx ORDER BY b.score DESC, speaker) AS rank, speaker, round(b.score, 6) AS score, b.source AS source FROM best""")
def d4_prototype_scores(spark, sf):
    b = A.bank(spark, sf)
    c = B.clusters_by_speaker(b)
    s = B.bank_scores(A.queries(spark, sf), c, 2.5, B.prototypes(b, c, 3))
    return s.select("session", "seg_idx", "rank", "speaker", F.round("score", 6).alias("score"), "source")


@query(f"""WITH {_RANKED}, t AS (SELECT session, seg_idx, arg_min(speaker, rank) AS speaker, max(score) FILTER (rank = 1) AS score, coalesce(max(score) FILTER (rank = 2), 0) AS second FROM ranked WHERE rank <= 2 GROUP BY ALL)
SELECT session, seg_idx, speaker, round(score - second, 6) AS margin, score >= 0.2 AND score - second >= 0.03 AS matched FROM t""")
def c11_accept_rule(spark, sf):
    return B.accepted(_scores(spark, sf), 0.2, 0.03).select("session", "seg_idx", "speaker", F.round("margin", 6).alias("margin"), "matched")


@query(f"""WITH {_RAW}, qs AS (SELECT r.session, r.seg_idx, r.speaker, list_dot_product(q.v, u.v) AS s, u.entry_idx FROM raw r JOIN qn q USING (session, seg_idx) JOIN un u ON u.speaker <> r.speaker AND u.entry_idx <> r.seg_idx),
qr AS (SELECT session, seg_idx, speaker, avg(s) AS qm, greatest(stddev_pop(s), 1e-6) AS qs FROM (SELECT *, row_number() OVER (PARTITION BY session, seg_idx, speaker ORDER BY s DESC, entry_idx) AS r FROM qs) WHERE r <= 20 GROUP BY ALL),
cs AS (SELECT c.speaker, list_dot_product(c.centroid, u.v) AS s, entry_idx FROM clusters c JOIN un u ON u.speaker <> c.speaker),
cr AS (SELECT speaker, avg(s) AS cm, greatest(stddev_pop(s), 1e-6) AS cs FROM (SELECT *, row_number() OVER (PARTITION BY speaker ORDER BY s DESC, entry_idx) AS r FROM cs) WHERE r <= 20 GROUP BY ALL)
SELECT session, seg_idx, speaker, round(score, 6) AS raw_score, round(coalesce(0.5 * ((score - cm) / cs + (score - qm) / qs), score), 4) AS score FROM raw LEFT JOIN qr USING (session, seg_idx, speaker) LEFT JOIN cr USING (speaker)""")
def e14_normalised_scores(spark, sf):
    b = A.bank(spark, sf)
    s = B.normalised_scores(A.queries(spark, sf), b, B.clusters_by_speaker(b), 20)
    return s.select("session", "seg_idx", "speaker", F.round("raw_score", 6).alias("raw_score"), F.round("score", 4).alias("score"))


@query(f"""WITH {_UNITS}, p AS (SELECT a.entry_idx % 7 AS session, a.entry_idx AS src, b.entry_idx AS dst, list_dot_product(a.v, b.v) AS w FROM un a JOIN un b ON a.entry_idx % 7 = b.entry_idx % 7 AND a.entry_idx <> b.entry_idx),
n AS (SELECT session, src, dst, w FROM p WHERE w >= 0.05 QUALIFY row_number() OVER (PARTITION BY session, src ORDER BY w DESC, dst) <= 3),
u AS (SELECT * FROM n UNION ALL SELECT session, dst, src, w FROM n) SELECT session, src, dst, round(max(w), 6) AS w FROM u GROUP BY session, src, dst""")
def d6_knn_edges(spark, sf):
    return B.nearest_neighbours(A.sessions_of_vectors(spark, sf), 3, 0.05).withColumn("w", F.round("w", 6))


@query(f"""WITH {_CENTRES} SELECT speaker, members, round(variance, 6) AS variance FROM clusters""")
def j16_grown_bank(spark, sf):
    """A bank that begins with half of the speakers and is extended with the others."""
    b = A.bank(spark, sf)
    grown = B.add_entries(b.where("speaker < 'spk_5'"), b.where("speaker >= 'spk_5'"))
    return B.clusters_by_speaker(grown).select("speaker", "members", F.round("variance", 6).alias("variance"))


@query(f"""WITH {A.BANK}, k AS (SELECT entry_idx, CASE lower(speaker) WHEN 'spk_1' THEN 'spk_0' ELSE speaker END AS label FROM bank WHERE speaker <> 'spk_9'),
n AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY entry_idx) - 1 AS i, count(*) OVER (PARTITION BY label) AS n FROM k)
SELECT entry_idx, label FROM n WHERE n <= 20 OR list_contains(list_transform(generate_series(0, 19), lambda j: CAST(round_even(j * (n - 1) / 19::DOUBLE, 0) AS BIGINT)), i)""")
def a23_bank_dataset(spark, sf):
    from parlance.operators.datasets import bank_samples

    aliases = spark.createDataFrame([("spk_1", "spk_0")], "key string, value string")
    return bank_samples(A.bank(spark, sf).where("speaker <> 'spk_9'"), aliases, 20).select("entry_idx", "label")


@query(f"WITH {A.BANK} SELECT speaker, count(*) AS entries FROM bank GROUP BY speaker")
def e23_bank_summary(spark, sf):
    return A.bank(spark, sf).groupBy("speaker").agg(F.count("*").alias("entries"))


@query()
def e15_whitened_scores(spark, sf):
    # the bank and the searches are the same vectors: whitened once, read as both
    white = B.whitened(A.sessions_of_vectors(spark, sf), *B.whitening(A.bank(spark, sf)))
    b = white.select(F.col("seg_idx").alias("entry_idx"), F.col("own").alias("speaker"), "embedding")
    return B.bank_scores(white, B.clusters_by_speaker(b), 1e9)


#: Density clusters by distance 0.75 and 4 neighbours: cores, what they reach (recursively), and entries beside a core; clusters are numbered by their first core.
_DENSE = _UNITS + """, nb AS MATERIALIZED (SELECT a.speaker, a.entry_idx AS a, b.entry_idx AS b FROM un a JOIN un b ON a.speaker = b.speaker WHERE 1 - list_dot_product(a.v, b.v) <= 0.75),
core AS MATERIALIZED (SELECT a FROM nb GROUP BY a HAVING count(*) >= 4),
cc AS MATERIALIZED (SELECT a, b FROM nb WHERE a IN (FROM core) AND b IN (FROM core)),
reach AS (SELECT a, a AS b FROM core UNION SELECT reach.a, cc.b FROM reach JOIN cc ON cc.a = reach.b),
firsts AS (SELECT a AS entry_idx, min(b) AS f FROM reach GROUP BY a UNION ALL SELECT nb.a, min(r.f) FROM nb JOIN (SELECT a, min(b) AS f FROM reach GROUP BY a) r ON r.a = nb.b WHERE nb.a NOT IN (FROM core) GROUP BY nb.a),
dense AS MATERIALIZED (SELECT speaker, entry_idx, CASE WHEN f IS NULL THEN -1 ELSE dense_rank() OVER (PARTITION BY speaker, f IS NULL ORDER BY f) - 1 END AS cluster FROM un LEFT JOIN firsts USING (entry_idx))"""

#: The same as clusters: members by cluster_id, centroids, variances.
_GROUPS = _DENSE + """, mem AS MATERIALIZED (SELECT un.speaker, entry_idx, v, CASE WHEN cluster < 0 THEN un.speaker || '_solo_' || entry_idx ELSE un.speaker || '_c' || cluster END AS cluster_id FROM un JOIN dense USING (entry_idx)),
gx AS (SELECT cluster_id, i, avg(v[i]) AS x FROM (SELECT cluster_id, v, unnest(generate_series(1, len(v))) AS i FROM mem) GROUP BY ALL),
gm AS (SELECT cluster_id, list(x ORDER BY i) AS m FROM gx GROUP BY ALL),
groups AS MATERIALIZED (SELECT speaker, cluster_id, any_value(list_transform(m, lambda x: x / sqrt(list_dot_product(m, m)))) AS centroid, avg(pow(list_distance(v, list_transform(m, lambda x: x / sqrt(list_dot_product(m, m)))), 2)) AS variance, count(*) AS members FROM mem JOIN gm USING (cluster_id) GROUP BY ALL)"""
_DENSE, _GROUPS = (f"RECURSIVE {x}" for x in (_DENSE, _GROUPS))


def _dense(spark, sf):
    b = A.bank(spark, sf)
    return K.members(b, K.density_clusters(b, 0.75, 4))


@query(f"WITH {_DENSE} SELECT speaker, entry_idx, cluster FROM dense")
def e20_density_clusters(spark, sf):
    return K.density_clusters(A.bank(spark, sf), 0.75, 4)


@query(f"WITH {_GROUPS} SELECT speaker, cluster_id, members, round(variance, 6) AS variance, round(centroid[1], 6) AS first FROM groups")
def e20_cluster_table(spark, sf):
    """Centroid and variance of every cluster of every speaker; noise entries are clusters of their own."""
    c = K.clusters_of(_dense(spark, sf))
    return c.select("speaker", "cluster_id", "members", F.round("variance", 6).alias("variance"), F.round(F.col("centroid")[0], 6).alias("first"))


@query(f"""WITH {_GROUPS}, own AS (SELECT q.session, q.seg_idx, q.v, m.cluster_id AS own FROM qn q JOIN mem m ON m.entry_idx = q.seg_idx),
ox AS (SELECT seg_idx, m.v, unnest(generate_series(1, len(m.v))) AS i FROM own o JOIN mem m ON m.cluster_id = o.own AND m.entry_idx <> o.seg_idx),
om AS (SELECT seg_idx, list(x ORDER BY i) AS m FROM (SELECT seg_idx, i, avg(v[i]) AS x FROM ox GROUP BY ALL) GROUP BY ALL),
oc AS (SELECT seg_idx, list_transform(m, lambda x: x / sqrt(list_dot_product(m, m))) AS centroid FROM om),
ov AS (SELECT o.seg_idx, any_value(centroid) AS centroid, avg(pow(list_distance(m.v, centroid), 2)) AS variance FROM own o JOIN oc USING (seg_idx) JOIN mem m ON m.cluster_id = o.own AND m.entry_idx <> o.seg_idx GROUP BY ALL),
met AS (SELECT session, seg_idx, v, speaker, cluster_id, centroid, variance FROM own JOIN groups ON cluster_id <> own UNION ALL SELECT o.session, o.seg_idx, o.v, g.speaker, own, ov.centroid, ov.variance FROM own o JOIN ov USING (seg_idx) JOIN groups g ON g.cluster_id = own),
near AS (SELECT session, seg_idx, speaker, cluster_id, list_dot_product(v, centroid) AS score FROM met WHERE variance <= 1e-12 OR list_distance(v, centroid) <= greatest(sqrt(variance) * 1.2, 1e-4)),
best AS (SELECT session, seg_idx, speaker, max(score) AS score, arg_max(cluster_id, score) AS cluster_id FROM near GROUP BY ALL)
SELECT session, seg_idx, row_number() OVER (PARTITION BY session, seg_idx ORDER BY score DESC, speaker) AS rank, speaker, cluster_id, round(score, 6) AS score FROM best""")
def d4_cluster_scores(spark, sf):
    """Each query against all clusters of all speakers, its own cluster without itself; the best cluster counts."""
    rows = _dense(spark, sf)
    clusters = K.clusters_of(rows).withColumn("variance", F.when(F.col("members") > 1, F.col("variance")).otherwise(0.0))
    q = A.queries(spark, sf).join(rows.select(F.col("entry_idx").alias("seg_idx"), F.col("cluster_id").alias("own_cluster")), "seg_idx")
    s = B.bank_scores(q, clusters, 1.2)
    return s.select("session", "seg_idx", "rank", "speaker", "cluster_id", F.round("score", 6).alias("score"))


def _kmeans_sql(k: int, rounds: int) -> str:
    parts = [f"kn AS (SELECT speaker, entry_idx, un.v, centroid, row_number() OVER (PARTITION BY speaker ORDER BY entry_idx) - 1 AS i, count(*) OVER (PARTITION BY speaker) AS n FROM un JOIN clusters USING (speaker))",
             f"c0 AS (SELECT speaker, j AS ctr, v FROM kn JOIN (SELECT unnest(range({k})) AS j) ON j < least({k}, n) AND i = j * n // least({k}, n))"]
    near = "SELECT x.speaker, x.entry_idx, x.v, arg_min(c.ctr, (list_distance(x.v, c.v), c.ctr)) AS ctr FROM kn x JOIN c{r} c USING (speaker) GROUP BY ALL"
    for r in range(rounds):
        parts.append(f"a{r} AS MATERIALIZED ({near.format(r=r)})")
        parts.append(f"m{r} AS (SELECT speaker, ctr, list(x ORDER BY i) AS v FROM (SELECT speaker, ctr, i, avg(v[i]) AS x FROM (SELECT speaker, ctr, v, unnest(generate_series(1, len(v))) AS i FROM a{r}) GROUP BY ALL) GROUP BY ALL)")
        parts.append(f"c{r + 1} AS MATERIALIZED (SELECT speaker, ctr, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN m{r} m USING (speaker, ctr))")
    # each centre in turn takes the nearest entry that is left
    parts.append(f"d AS MATERIALIZED (SELECT speaker, ctr, entry_idx, list_distance(x.v, c.v) AS d FROM kn x JOIN c{rounds} c USING (speaker))")
    for j in range(k):
        gone = " AND ".join(["true", *(f"(speaker, entry_idx) NOT IN (SELECT (speaker, entry_idx) FROM p{i})" for i in range(j))])
        parts.append(f"p{j} AS MATERIALIZED (SELECT speaker, arg_min(entry_idx, (d, entry_idx)) AS entry_idx, {j} AS place FROM d WHERE ctr = {j} AND {gone} GROUP BY speaker)")
    return _CENTRES + ", " + ", ".join(parts) + " " + " UNION ALL ".join(f"SELECT speaker, place, entry_idx FROM p{j}" for j in range(k))


@query(f"WITH {_kmeans_sql(3, 8)}")
def g5_kmeans_prototypes(spark, sf):
    """The entries nearest the centres of 8 rounds of k-means inside each speaker's cluster."""
    b = A.bank(spark, sf)
    rows = K.members(b)
    out = K.prototypes_of(rows, K.clusters_of(rows), 3, "kmeans", 8)
    return out.select("speaker", "place", "entry_idx")


@query(f"""WITH {_UNITS}, n AS (SELECT a.entry_idx AS seg_idx, b.speaker, 1 - list_dot_product(a.v, b.v) AS d FROM un a JOIN un b ON a.entry_idx <> b.entry_idx QUALIFY row_number() OVER (PARTITION BY a.entry_idx ORDER BY list_dot_product(a.v, b.v) DESC, b.entry_idx) <= 5),
v AS (SELECT seg_idx, speaker, sum(1 / greatest(d, 1e-6)) AS vote FROM n GROUP BY ALL) SELECT seg_idx % 7 AS session, seg_idx, speaker, round(vote / sum(vote) OVER (PARTITION BY seg_idx), 4) AS probability FROM v""")
def j5_knn_classifier(spark, sf):
    """Distance-weighted cosine vote of each vector's 5 nearest other bank entries."""
    return B.knn_votes(A.sessions_of_vectors(spark, sf), A.bank(spark, sf), 5).withColumn("probability", F.round("probability", 4))
