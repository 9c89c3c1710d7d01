"""Queries that build and describe training sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.operators import datasets as D
from parlance.operators import evaluation as E
from parlance.plans.registry import registry
from parlance.session import table
from parlance.sources import adapters as A

QUERIES, SQL, query = registry()

_REASON = """CASE WHEN label NOT IN ('spk_0', 'spk_1', 'spk_2', 'spk_3') THEN 'speaker' WHEN NOT coalesce(dominant_share >= 0.7, false) THEN 'dominant_share'
WHEN NOT (active_speakers >= 0 AND active_speakers <= 2) THEN 'active_speakers' WHEN duration < 0.8 THEN 'min_duration' WHEN duration > 4 THEN 'max_duration' END"""


def _reason():
    return D.dataset_rejection(["spk_0", "spk_1", "spk_2", "spk_3"], None, 0.7, 2, 0.8, 4.0)


@query(f"WITH {A.DATASET} SELECT row_id, label, source, session FROM dataset WHERE ({_REASON}) IS NULL")
def c6_filtered_dataset(spark, sf):
    return A.dataset(spark, sf).where(_reason().isNull()).select("row_id", "label", "source", "session")


@query(f"WITH {A.DATASET} SELECT coalesce({_REASON}, 'kept') AS reason, count(*) AS n FROM dataset GROUP BY 1")
def c6_rejection_counts(spark, sf):
    return A.dataset(spark, sf).select(F.coalesce(_reason(), F.lit("kept")).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query(f"""WITH {A.DATASET}, q AS (SELECT session, label, source, CASE WHEN row_id % 50 = 0 THEN 'decode' WHEN row_id % 31 = 0 THEN 'non_finite' WHEN duration < 0.8 THEN 'too_short' WHEN (row_id % 100) / 10000.0 > 0.005 THEN 'clipping' WHEN (row_id % 10) / 10.0 > 0.8 THEN 'silence' END AS reason FROM dataset)
SELECT reason, session, label, source, count(*) AS n FROM q WHERE reason IS NOT NULL GROUP BY GROUPING SETS ((reason, session), (reason, label), (reason, source))""")
def c7_e12_quality_rejections(spark, sf):
    d = A.dataset(spark, sf).withColumns({"decode_ok": F.col("row_id") % 50 != 0, "finite_ok": F.col("row_id") % 31 != 0, "clipping_fraction": (F.col("row_id") % 100) / 10000.0, "silence_fraction": (F.col("row_id") % 10) / 10.0})
    d = d.withColumn("reason", D.quality_rejection()).where("reason is not null")
    return d.groupingSets([["reason", "session"], ["reason", "label"], ["reason", "source"]], "reason", "session", "label", "source").agg(F.count("*").alias("n"))


_PURITY = """p AS (SELECT *, coalesce(dominant_share, 0) AS share, duration * coalesce(dominant_share, 0) AS t1, duration * (1 - coalesce(dominant_share, 0)) AS t2 FROM dataset)"""


@query(f"""WITH {A.DATASET}, {_PURITY} SELECT row_id, CASE WHEN duration < 0.8 THEN 'too_short' WHEN duration > 4 THEN 'too_long' WHEN duration <= 0 THEN 'no_power' WHEN t1 < 1e-6 THEN 'low_power' WHEN share < 0.8 THEN 'low_share' WHEN t1 <= t2 THEN 'not_dominant' END AS rejection,
CASE WHEN share >= 0.8 THEN 'high' WHEN share >= 0.65 THEN 'medium' ELSE 'low' END AS bucket FROM p""")
def c8_e8_purity(spark, sf):
    d = A.dataset(spark, sf).withColumn("dominant_share", F.coalesce("dominant_share", F.lit(0.0)))
    d = d.withColumns({"total_power": F.col("duration"), "top1_power": F.col("duration") * F.col("dominant_share"), "top2_power": F.col("duration") * (1 - F.col("dominant_share"))})
    rejection, bucket = D.purity(0.8, 4.0)
    return d.select("row_id", rejection.alias("rejection"), bucket.alias("bucket"))


@query(f"""WITH {A.DATASET} SELECT label, domain, source, count(*) AS n, round(min(duration), 6) AS shortest, round(avg(duration), 6) AS mean, round(max(duration), 6) AS longest, count(DISTINCT session) AS sessions FROM dataset GROUP BY ALL""")
def e9_dataset_summary(spark, sf):
    d = A.dataset(spark, sf).groupBy("label", "domain", "source")
    return d.agg(F.count("*").alias("n"), F.round(F.min("duration"), 6).alias("shortest"), F.round(F.avg("duration"), 6).alias("mean"), F.round(F.max("duration"), 6).alias("longest"), F.countDistinct("session").alias("sessions"))


@query(f"WITH {A.DATASET} SELECT source, session, label, count(*) AS n FROM dataset GROUP BY GROUPING SETS ((source, label), (session, label))")
def e10_breakdown(spark, sf):
    return D.breakdown(A.dataset(spark, sf))


@query(f"""WITH {A.DATASET}, b AS (SELECT domain, label, count(*) AS samples, count(DISTINCT session) AS sessions FROM dataset GROUP BY ALL), m AS (SELECT domain, median(samples) AS median_samples FROM b GROUP BY domain)
SELECT domain, label, samples, sessions, median_samples, sessions < 10 AS low_session_count, median_samples > 0 AND samples < median_samples * 0.5 AS low_sample_count FROM b JOIN m USING (domain)""")
def e11_coverage(spark, sf):
    return D.coverage(A.dataset(spark, sf), 10, 0.5)


@query(f"""WITH {A.DATASET}, t AS (SELECT * FROM dataset WHERE label IN ('spk_0', 'spk_1', 'spk_2')), c AS (SELECT source, label, count(*) AS n FROM t GROUP BY ALL),
l AS (SELECT source, label, least(min(n) OVER (PARTITION BY source), 100) AS lim, count(*) OVER (PARTITION BY source) AS k FROM c), raw AS (SELECT label, n AS raw FROM c WHERE source = 'mixed_raw'),
f AS (SELECT source, label, CASE WHEN source = 'mixed_aug_total' THEN least(lim, coalesce(raw, 0)) ELSE lim END AS lim FROM l LEFT JOIN raw USING (label) WHERE k = 3),
n AS (SELECT t.row_id, t.label, t.source, lim, row_number() OVER (PARTITION BY t.source, t.label ORDER BY row_id) - 1 AS i, count(*) OVER (PARTITION BY t.source, t.label) AS n FROM t JOIN f USING (source, label))
SELECT row_id, label, source FROM n WHERE n <= lim OR list_contains(list_transform(generate_series(0, lim - 1), lambda j: CAST(round_even(j * (n - 1) / greatest(lim - 1, 1)::DOUBLE, 0) AS BIGINT)), i)""")
def g8_balanced(spark, sf):
    return D.balanced(A.dataset(spark, sf), ["spk_0", "spk_1", "spk_2"], 100).select("row_id", "label", "source")


@query("""WITH p AS (SELECT least(source, lang) || '::' || greatest(source, lang) AS pair, count(*) AS n FROM documents GROUP BY 1), k AS (SELECT pair, row_number() OVER (ORDER BY n DESC, pair) AS r FROM p QUALIFY r <= 5)
SELECT 'en::src7' AS pair, 0 AS place UNION ALL SELECT 'a::b', 1 UNION ALL SELECT pair, r + 2 FROM k WHERE pair NOT IN ('en::src7', 'a::b')""")
def g4_top_pairs(spark, sf):
    from parlance.functions.text import pair_key

    p = table(spark, sf, "documents").select(pair_key(F.col("source"), F.col("lang")).alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    return D.top_pairs(p, ["en::src7", "a::b"], 5)


_POOL = """pool AS (SELECT l_orderkey * 10 + l_linenumber AS row_id, 'p' || (l_suppkey % 4) AS pair, 's' || (l_partkey % 5) AS speaker, (l_suppkey % 4) / 4.0::DOUBLE AS weight, l_returnflag = 'R' AS is_style, CAST(l_quantity AS INT) AS priority FROM lineitem)"""


@query(f"""WITH {_POOL}, a AS (SELECT *, CASE WHEN is_style THEN row_number() OVER (PARTITION BY pair, speaker, is_style ORDER BY weight DESC, priority, row_id) END AS sr FROM pool),
b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY pair, speaker ORDER BY coalesce(sr <= 6, false) DESC, weight DESC, priority, row_id) <= 20),
c AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY speaker ORDER BY weight DESC, priority, row_id) <= 50)
SELECT row_id, pair, speaker FROM c ORDER BY weight DESC, priority, row_id LIMIT 150""")
def g6_capped_mining(spark, sf):
    line = table(spark, sf, "lineitem")
    pool = line.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id"), F.concat(F.lit("p"), (F.col("l_suppkey") % 4).cast("string")).alias("pair"), F.concat(F.lit("s"), (F.col("l_partkey") % 5).cast("string")).alias("speaker"), ((F.col("l_suppkey") % 4) / 4.0).alias("weight"), (F.col("l_returnflag") == "R").alias("is_style"), F.col("l_quantity").cast("int").alias("priority"))
    return D.capped(pool, 20, 6, 50, 150).select("row_id", "pair", "speaker")


@query("""WITH p AS (SELECT source || '::' || lang AS pair, count(*) AS n FROM documents GROUP BY 1), s AS (SELECT lang AS speaker, count(*) AS total, avg(quality) AS accuracy FROM documents JOIN labels USING (doc_id) GROUP BY lang),
o AS (SELECT speaker, greatest(0, 1 - accuracy) * total AS poor FROM s WHERE total > 0)
SELECT pair, n, round(greatest(0.5, 0.5 + 0.5 * n / (SELECT max(n) FROM p) + 0.25 * (coalesce(a.poor, 0) + coalesce(b.poor, 0)) / (2 * (SELECT max(poor) FROM o))), 9) AS weight
FROM p LEFT JOIN o a ON a.speaker = split_part(pair, '::', 1) LEFT JOIN o b ON b.speaker = split_part(pair, '::', 2)""")
def e19_pair_weights(spark, sf):
    docs = table(spark, sf, "documents")
    pairs = docs.groupBy(F.concat_ws("::", "source", "lang").alias("pair")).agg(F.count("*").alias("n"))
    speakers = docs.join(table(spark, sf, "labels"), "doc_id").groupBy(F.col("lang").alias("speaker")).agg(F.count("*").alias("total"), F.avg("quality").alias("accuracy"))
    return E.pair_weights(pairs, speakers).withColumn("weight", F.round("weight", 9))


@query("SELECT doc_id, source FROM documents WHERE lang = 'en' UNION ALL SELECT doc_id, source FROM documents WHERE source <> 'src0'")
def h1_union_all(spark, sf):
    d = table(spark, sf, "documents")
    return d.where("lang = 'en'").unionByName(d.where("source <> 'src0'")).select("doc_id", "source")


@query("SELECT DISTINCT source, lang FROM documents WHERE source NOT IN (SELECT DISTINCT source FROM documents WHERE lang = 'es' AND n_chars > 15000)")
def h3_deduplicated_sources(spark, sf):
    d = table(spark, sf, "documents")
    out = d.where("lang = 'es' and n_chars > 15000").select("source").distinct()
    return d.select("source", "lang").dropDuplicates().join(out, "source", "left_anti").select("source", "lang")


@query("SELECT source FROM documents WHERE lang = 'en' AND n_chars > 3000 INTERSECT SELECT source FROM documents WHERE lang = 'de' AND n_chars > 3000")
def h4_intersection(spark, sf):
    d = table(spark, sf, "documents").where("n_chars > 3000")
    return d.where("lang = 'en'").select("source").intersect(d.where("lang = 'de'").select("source"))


@query("SELECT source AS key FROM documents UNION SELECT lang FROM documents")
def h5_key_union(spark, sf):
    d = table(spark, sf, "documents")
    return d.select(F.col("source").alias("key")).union(d.select("lang")).distinct()


@query("SELECT source AS speaker, min(doc_id) AS first_pos FROM documents GROUP BY source")
def h6_ordered_distinct(spark, sf):
    return table(spark, sf, "documents").groupBy(F.col("source").alias("speaker")).agg(F.min("doc_id").alias("first_pos"))


@query("""WITH s AS (SELECT source, row_number() OVER (ORDER BY source) - 1 AS i FROM (SELECT DISTINCT source FROM documents)) SELECT source, (i // 6) AS chunk FROM s""")
def h7_source_chunks(spark, sf):
    from pyspark.sql import Window

    s = table(spark, sf, "documents").select("source").distinct()
    return s.select("source", F.floor((F.row_number().over(Window.orderBy("source")) - 1) / 6).alias("chunk"))  # distinct sources: a short list


@query(f"WITH {A.DATASET} SELECT row_id, session FROM dataset WHERE session IN (SELECT 'Session ' || (p_partkey % 40) FROM part WHERE p_partkey % 40 < 3)")
def c16_leaks(spark, sf):
    held = table(spark, sf, "part").where("p_partkey % 40 < 3").select(F.concat(F.lit("Session "), (F.col("p_partkey") % 40).cast("string")).alias("session"))
    return D.leaks(A.dataset(spark, sf), held).select("row_id", "session")


_KEPT = f"AND ({_REASON}) IS NULL"
_BALANCED = SQL["g8_balanced"].replace("WHERE label IN ('spk_0', 'spk_1', 'spk_2'))", f"WHERE label IN ('spk_0', 'spk_1', 'spk_2') {_KEPT})")


@query(f"""WITH {A.DATASET}, f AS (SELECT * FROM dataset WHERE true {_KEPT}), b AS MATERIALIZED (SELECT row_id, label, source FROM ({_BALANCED})), k AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label)
SELECT 'rejections' AS stage, count(*) AS n FROM (SELECT DISTINCT coalesce({_REASON}, 'kept') FROM dataset) UNION ALL SELECT 'filtered', count(*) FROM f UNION ALL SELECT 'bank_samples', sum(least(n, 20))::BIGINT FROM k UNION ALL SELECT 'balanced', count(*) FROM b
UNION ALL SELECT 'coverage', count(*) FROM (SELECT DISTINCT domain, label FROM f) UNION ALL SELECT 'breakdown', count(*) FROM (SELECT source, session, label FROM b JOIN dataset USING (row_id, label, source) GROUP BY GROUPING SETS ((source, label), (session, label)))
UNION ALL SELECT 'training', 2 * (SELECT count(*) FROM b) + (SELECT sum(least(n, 20))::BIGINT FROM k)""")
def j10_prepared_baseline(spark, sf):
    """All stages of a baseline, made twice in one folder: the second time only what a changed setting asks for."""
    from parlance.operators import baseline as P
    from parlance.tables import new_path

    data = A.dataset(spark, sf)
    aliases, holdout = spark.createDataFrame([], "key string, value string"), spark.createDataFrame([("Session 99",)], "session string")
    sources = {"dataset": (data, sf), "bank": (A.bank(spark, sf), sf), "aliases": (aliases, "none"), "holdout": (holdout, "99")}
    config = {"filter": {"speakers": ["spk_0", "spk_1", "spk_2", "spk_3"], "share": 0.7, "least": 0.8, "most": 4.0}, "balance": {"targets": ["spk_0", "spk_1", "spk_2"], "cap": 100}, "bank": {"most": 20}}
    folder = new_path(spark, "baseline")
    P.prepare_baseline(spark, folder, sources, config)
    tables, built = P.prepare_baseline(spark, folder, sources, {**config, "passes": 2})
    if built != ["training"]:
        raise RuntimeError(f"stages were built again that nothing changed for: {built}")
    return P.stage_sizes(tables, [s.name for s in P.baseline_stages(config)])
