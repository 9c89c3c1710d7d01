"""Queries of the session graph: every vector is a segment, its candidates are the bank's speakers."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.operators import bank as B
from parlance.operators import graph as G
from parlance.plans.bank_queries import _RANKED
from parlance.plans.registry import registry
from parlance.sources import adapters as A

QUERIES, SQL, query = registry()

#: The bars are those that the tables' vectors can meet; two pairs have values of their own.
GRAPH = G.SessionGraph(
    candidate_floor=0.05, min_similarity=0.1, strong_seed_score=0.3, strong_seed_margin=0.05, override_min_confidence=0.3, override_min_margin=0.03,
    pairs={"spk_1::spk_2": {"same_raw_label_weight": 0.6, "override_min_confidence": 0.2}, "spk_0::spk_3": {"same_top1_weight": 0.3, "override_min_delta": 0.5}},
)
THRESHOLD, MARGIN = 0.2, 0.03


def known_and_candidates(spark, sf):
    q = A.sessions_of_vectors(spark, sf)
    candidates = B.bank_scores(q, B.clusters_by_speaker(A.bank(spark, sf)))
    return G.evidence(A.vector_segments(spark, sf), candidates, THRESHOLD, MARGIN, 0.0, GRAPH), candidates, q


def _own(name: str, pair: str = "pair") -> str:
    cases = " ".join(f"WHEN '{k}' THEN {v[name]}" for k, v in GRAPH.pairs.items() if name in v)
    return f"CASE {pair} {cases} ELSE {getattr(GRAPH, name)} END" if cases else str(getattr(GRAPH, name))


def _bonus(name: str) -> str:
    return f"greatest({getattr(GRAPH, name)}, {_own(name)}, {_own(name, 'r_pair')})"


_EVIDENCE = _RANKED.replace(" WHERE entry_idx % 100 = 0", "") + f""", {A.VECTOR_SEGMENTS},
top AS (SELECT session, seg_idx, arg_min(speaker, rank) AS top1, max(speaker) FILTER (rank = 2) AS top2, max(score) FILTER (rank = 1) AS score, coalesce(max(score) FILTER (rank = 2), 0) AS second FROM ranked WHERE rank <= 2 GROUP BY ALL),
ev AS MATERIALIZED (SELECT s.*, t.score, t.score - second AS margin, CASE WHEN top1 <> top2 THEN least(top1, top2) || '::' || greatest(top1, top2) END AS pair,
  CASE WHEN t.score >= {THRESHOLD} AND t.score - second >= {MARGIN} THEN top1 END AS local_speaker FROM vsegments s LEFT JOIN top t USING (session, seg_idx)),
known AS MATERIALIZED (SELECT *, local_speaker IS NOT NULL AND "end" - start >= 0.75 AND score >= {max(THRESHOLD + 0.05, GRAPH.strong_seed_score)} AND margin >= {GRAPH.strong_seed_margin} AND NOT overlap_heavy AND NOT was_split AS seed FROM ev)"""

_EDGES = _EVIDENCE + f""",
pull AS MATERIALIZED (SELECT session, seg_idx AS node, speaker AS label, least(1, (score - {GRAPH.candidate_floor}) / (1 - {GRAPH.candidate_floor}::DOUBLE)) AS w FROM ranked WHERE rank <= 3 AND score > {GRAPH.candidate_floor}),
near AS (SELECT a.session, a.seg_idx AS src, b.seg_idx AS dst, list_dot_product(a.v, b.v) AS w FROM qn a JOIN qn b ON a.session = b.session AND a.seg_idx <> b.seg_idx),
knn AS (SELECT * FROM near WHERE w >= {GRAPH.min_similarity} QUALIFY row_number() OVER (PARTITION BY session, src ORDER BY w DESC, dst) <= {GRAPH.knn}),
line AS (SELECT *, lead(seg_idx) OVER w AS dst, lead(start) OVER w AS r_start, lead("end") OVER w AS r_end, lead(speaker_raw) OVER w AS r_raw, lead(local_speaker) OVER w AS r_speaker, lead(pair) OVER w AS r_pair, lead(seed) OVER w AS r_seed
  FROM known WINDOW w AS (PARTITION BY session ORDER BY seg_idx)),
gaps AS (SELECT *, greatest(r_start - "end", start - r_end, 0) AS gap FROM line WHERE dst IS NOT NULL),
side AS (SELECT session, seg_idx AS src, dst, greatest(CASE WHEN gap <= 2 THEN 0.35 * exp(-gap / 0.75) ELSE 0 END, CASE WHEN speaker_raw = r_raw THEN {_bonus('same_raw_label_weight')} ELSE 0 END,
  CASE WHEN NOT seed AND NOT r_seed AND local_speaker = r_speaker THEN {_bonus('same_top1_weight')} ELSE 0 END)::DOUBLE AS w FROM gaps),
one AS (SELECT * FROM knn UNION ALL SELECT * FROM side WHERE w > 0),
edge AS MATERIALIZED (SELECT session, src, dst, max(w) AS w FROM (SELECT session, src, dst, w FROM one UNION ALL SELECT session, dst, src, w FROM one) GROUP BY ALL)"""


def _rounds() -> str:
    """Unrolled; a session whose scores have settled keeps them."""
    parts = [f"""seeds AS MATERIALIZED (SELECT session, seg_idx AS node, local_speaker AS label FROM known WHERE seed),
total AS (SELECT session, node, sum(w) AS total FROM (SELECT session, src AS node, w FROM edge UNION ALL SELECT session, node, w FROM pull) GROUP BY ALL),
share AS MATERIALIZED (SELECT e.session, e.src AS node, e.dst, {GRAPH.alpha} * w / total AS p FROM edge e JOIN total t ON t.session = e.session AND t.node = e.src WHERE (e.session, e.src) NOT IN (SELECT (session, node) FROM seeds)),
free AS MATERIALIZED (SELECT * FROM share WHERE (session, dst) NOT IN (SELECT (session, node) FROM seeds)),
base AS MATERIALIZED (SELECT session, node, label, sum(p) AS score FROM (SELECT s.session, s.node, label, p FROM share s JOIN seeds h ON h.session = s.session AND h.node = s.dst
  UNION ALL SELECT session, node, label, {GRAPH.alpha} * w / total FROM pull JOIN total USING (session, node) WHERE (session, node) NOT IN (SELECT (session, node) FROM seeds)) GROUP BY ALL),
f1 AS MATERIALIZED (SELECT *, 0::DOUBLE AS was FROM base)"""]  # fmt: skip
    for r in range(1, GRAPH.max_iters):
        parts.append(f"""g{r} AS MATERIALIZED (SELECT session FROM f{r} GROUP BY session HAVING max(abs(score - was)) > {GRAPH.tolerance}),
f{r + 1} AS MATERIALIZED (SELECT session, node, label, sum(score) AS score, sum(was) AS was FROM (SELECT e.session, e.node, label, p * score AS score, 0::DOUBLE AS was FROM free e JOIN f{r} f ON f.session = e.session AND f.node = e.dst
  UNION ALL SELECT *, 0 FROM base UNION ALL SELECT session, node, label, 0, score FROM f{r}) WHERE session IN (FROM g{r}) GROUP BY ALL UNION ALL SELECT * FROM f{r} WHERE session NOT IN (FROM g{r}))""")
    return ", ".join(parts) + f""",
found AS (SELECT session, node, label, score FROM f{GRAPH.max_iters} UNION ALL SELECT *, 1 FROM seeds),
best AS (SELECT session, node, arg_min(label, r) AS label, max(score) FILTER (r = 1) AS score, max(score) FILTER (r = 1) - coalesce(max(score) FILTER (r = 2), 0) AS margin FROM (SELECT *, row_number() OVER (PARTITION BY session, node ORDER BY score DESC, label) AS r FROM found WHERE score > 0) GROUP BY ALL)"""


_GRAPH = _EDGES + ", " + _rounds()


@query(f"WITH {_EDGES} SELECT session, src, dst, round(w, 9) AS w FROM edge")
def j2_session_edges(spark, sf):
    known, _, q = known_and_candidates(spark, sf)
    return G.session_edges(known, q, GRAPH).withColumn("w", F.round("w", 9))


@query(f"""WITH {_GRAPH}, nb AS (SELECT session, src AS node, string_agg(dst::VARCHAR, ',' ORDER BY w DESC, dst) AS neighbours FROM (SELECT *, row_number() OVER (PARTITION BY session, src ORDER BY w DESC, dst) AS r FROM edge) WHERE r <= 3 GROUP BY ALL)
SELECT session, node, label, round(score, 6) AS score, round(margin, 6) AS margin, neighbours FROM best LEFT JOIN nb USING (session, node)""")
def j2_session_graph(spark, sf):
    g = G.session_graph(*known_and_candidates(spark, sf), GRAPH)
    near = F.array_join(F.transform("neighbours", lambda x: x["node"].cast("string")), ",")
    return g.select("session", "node", "label", F.round("score", 6).alias("score"), F.round("margin", 6).alias("margin"), near.alias("neighbours"))


@query(f"""WITH {_GRAPH}, l AS (SELECT k.session, seg_idx, coalesce(local_speaker, 'unknown') AS speaker, pair, seed, b.label, round(b.score, 9) AS g, b.margin AS gm, k.score FROM known k LEFT JOIN best b ON b.session = k.session AND b.node = k.seg_idx),
o AS (SELECT *, coalesce(NOT seed AND g >= {_own('override_min_confidence')} AND gm >= {GRAPH.override_min_margin} AND (speaker = 'unknown' OR g >= score + {_own('override_min_delta')}), false) AS overridden FROM l)
SELECT session, seg_idx, CASE WHEN overridden THEN label ELSE speaker END AS speaker, overridden FROM o""")
def j3_graph_overrides(spark, sf):
    known, candidates, q = known_and_candidates(spark, sf)
    local = known.select("session", "seg_idx", F.coalesce("local_speaker", F.lit("unknown")).alias("speaker"), "score", "seed", "pair")
    out = G.overridden(local, G.session_graph(known, candidates, q, GRAPH), GRAPH)
    return out.select("session", "seg_idx", F.col("final").alias("speaker"), "overridden")
