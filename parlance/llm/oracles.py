"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from parlance.llm.quality import Risk
from parlance.llm.urls import LISTED_LABELS

SQL: dict[str, str] = {}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL["op2_jaccard_join"] = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
x AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p WHERE 100 * c >= 85 * (na + nb - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.other)
SELECT doc_id, any_value(len(s))::BIGINT AS n_shingles, min(other) AS component_id FROM r JOIN s USING (doc_id) GROUP BY doc_id
"""

_RISK = Risk()
_CUTS = ", ".join(f"('{r}', {i}, {c}::DOUBLE)" for r, cuts in _RISK.cutoffs.items() for i, c in enumerate(cuts))
_P = _RISK.false_rejection / len(_RISK.cutoffs)

SQL["op4_quality_rules"] = rf"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS c FROM (SELECT doc_id, i, (w[i], w[i + 1], w[i + 2]) AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM t))),
rep AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM g WHERE c > 1) GROUP BY doc_id),
f AS (SELECT doc_id, lang, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
  (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, len(l) AS n_lines,
  length(regexp_replace(t, '[^\p{{Lu}}]+', '', 'g')) AS n_upper, length(regexp_replace(t, '[^!?]+', '', 'g')) AS n_marks FROM t LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f),
ratio AS (SELECT doc_id, lang, base_failed, unnest([
  {{'rule': 'symbols_per_char', 'v': coalesce(n_symbols / nullif(word_chars, 0), 0)}}, {{'rule': 'marks_per_word', 'v': coalesce(n_marks / nullif(n_words, 0), 0)}},
  {{'rule': 'upper_share', 'v': coalesce(n_upper / nullif(word_chars, 0), 0)}}, {{'rule': 'dup_line_share', 'v': coalesce(n_dup_lines / nullif(n_lines, 0), 0)}},
  {{'rule': 'repeat_share', 'v': coalesce(n_repeat_words / nullif(n_words, 0), 0)}}, {{'rule': 'chars_per_word', 'v': coalesce(word_chars / nullif(n_words, 0), 0)}}], recursive := true) FROM b),
cuts(rule, i, c) AS (VALUES {_CUTS}),
held AS (SELECT doc_id, min(quality) = 1 AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
k AS (SELECT lang, rule, i, any_value(c) AS c, count(*) FILTER (good) AS n, count(*) FILTER (good AND v > c) AS k, count(*) FILTER (NOT good AND v > c) AS bad
  FROM ratio JOIN held USING (doc_id) JOIN cuts USING (rule) WHERE NOT base_failed GROUP BY ALL),
p AS (SELECT *, list_sum(list_transform(range(0, k + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({_P}) + (n - j) * ln(1 - {_P})))) AS tail,
  (SELECT count(DISTINCT lang) FROM k) * (SELECT count(*) FROM cuts) AS tests FROM k WHERE n > 0),
cut AS (SELECT lang, rule, arg_min(c, (k - bad, i)) AS c FROM p WHERE tail <= {_RISK.level} / tests AND bad > k GROUP BY ALL),
bad AS (SELECT doc_id, min(rule) AS rule FROM ratio JOIN cut USING (lang, rule) WHERE v > c GROUP BY doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, CASE WHEN base_failed THEN 'base' ELSE bad.rule END AS failed_rule, NOT base_failed AND bad.rule IS NULL AS kept FROM b LEFT JOIN bad USING (doc_id)
"""

SQL["op5_warc"] = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), m AS (SELECT payload_digest, max(page_id) AS last FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN last <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN last <> page_id THEN last END AS refers_to
FROM p LEFT JOIN m USING (payload_digest)
"""

_LABELS = ", ".join(f"'{w}'" for line in LISTED_LABELS.values() for w in line.split())

SQL["op7_url_filter"] = rf"""
WITH u AS (SELECT page_id, url, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r AS (SELECT *, CASE WHEN (host = 'example.net' OR suffix(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
  WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
  WHEN (host = 'org' OR suffix(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/' WHEN (host = 'net' OR suffix(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule,
  contains(url, '://') AND len(list_intersect(regexp_split_to_array(regexp_replace(host, ':[0-9]+$', ''), '[.\-]'), [{_LABELS}])) > 0 AS l FROM u)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN l THEN 'block' ELSE 'allow' END AS verdict, coalesce(rule IS NULL AND l, false) AS listed FROM r
"""

SQL["op10_embedding_near_dup"] = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings),
ok AS (SELECT * FROM v WHERE label IS NOT NULL AND x IS NOT NULL AND len(list_filter(x, lambda y: y IS NULL OR NOT isfinite(y))) = 0 AND list_dot_product(x, x) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE list_dot_product(a.x, b.x) >= 0.98 * sqrt(list_dot_product(a.x, a.x)) * sqrt(list_dot_product(b.x, b.x))),
r AS (SELECT vec_id, vec_id AS other FROM embeddings UNION SELECT r.vec_id, l.b FROM r JOIN l ON l.a = r.other),
c AS (SELECT vec_id, min(other) AS component_id FROM r GROUP BY vec_id), n AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN c USING (vec_id) LEFT JOIN n USING (vec_id)
"""

_DRAWS = ", ".join(f"('0x' || substr(x, {1 + 8 * i}, 8))::BIGINT AS h{i + 1}" for i in range(4))

SQL["op11_infill"] = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents),
u AS (SELECT doc_id, t, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u, {_DRAWS} FROM t),
c AS (SELECT *, len(u)::BIGINT AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT doc_id, n, form, t, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM p
"""


def _centroid_sql(k: int = 8, rounds: int = 10) -> str:
    """Every round as two tables: the assignment by all exact distances, and the floors of the means (// truncates, hence the remainder)."""
    near = """SELECT id, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT id, c, list_sum(list_transform(list_zip(x.v, m.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM x, {m} m) GROUP BY id"""
    parts = [
        "k AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding::DOUBLE[], lambda y: y IS NOT NULL AND isfinite(y))) = 64)",
        "x AS MATERIALIZED (SELECT row_number() OVER () AS id, vec_id, list_transform(e, lambda y: floor(1024 * y)::BIGINT) AS v, row_number() OVER (ORDER BY sha256('3:' || coalesce(vec_id::VARCHAR, '')), e) - 1 AS draw FROM k)",
        f"m0 AS (SELECT draw AS c, v FROM x WHERE draw < {k})",
    ]
    for i in range(rounds):
        parts.append(f"a{i} AS MATERIALIZED ({near.format(m=f'm{i}')})")
        parts.append(
            f"s{i} AS (SELECT c, i, sum(y)::BIGINT AS s, count(*) AS n FROM (SELECT a.c, unnest(x.v) AS y, unnest(range(1, 65)) AS i FROM a{i} a JOIN x USING (id)) GROUP BY c, i),"
            f" m{i + 1} AS MATERIALIZED (SELECT c, coalesce(w.v, m.v) AS v FROM m{i} m LEFT JOIN (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM s{i} GROUP BY c) w USING (c))"
        )
    parts.append(f"f AS MATERIALIZED ({near.format(m=f'm{rounds}')})")
    return f"""
WITH {", ".join(parts)},
t AS (SELECT c, sum(d)::BIGINT AS s FROM f GROUP BY c)
SELECT vec_id, f.c::INTEGER AS cluster, d AS distance, t.s AS cluster_inertia, (SELECT sum(s)::BIGINT FROM t) AS inertia, sha256(array_to_string(m.v, ',')) AS centroid_sha256
FROM f JOIN x USING (id) JOIN t ON t.c = f.c JOIN m{rounds} m ON m.c = f.c
"""


SQL["op13_centroids"] = _centroid_sql()
