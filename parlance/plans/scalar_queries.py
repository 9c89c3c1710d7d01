"""Queries of scalar functions, text outputs and name matching."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from parlance.functions import text as T
from parlance.plans.registry import registry
from parlance.session import table
from parlance.sources import adapters as A

QUERIES, SQL, query = registry()


@query(r"""SELECT event_id, printf('%02d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) AS clock,
printf('%02d:%02d:%02d,%03d', m // 3600000, m // 60000 % 60, m // 1000 % 60, m % 1000) AS srt
FROM (SELECT event_id, CAST(floor(value * 60) AS BIGINT) AS s, CAST(round_even(value * 1000, 0) AS BIGINT) AS m FROM events)""")
def i1_i2_clocks(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", T.clock(F.col("value") * 60).alias("clock"), T.srt_clock(F.col("value")).alias("srt"))


@query(r"""SELECT page_id, trim(regexp_extract(html, '(?is)<h1>(.*?)</h1>', 1)) AS heading, CASE WHEN regexp_matches(url, '\d') THEN CAST(regexp_extract(url, '(\d+)', 1) AS BIGINT) END AS number,
regexp_replace(lower(url), '[^a-z0-9]+', '', 'g') AS simple FROM pages""")
def i5_i9_i21_page_text(spark, sf):
    p = table(spark, sf, "pages")
    return p.select("page_id", T.tagged(F.col("html"), "h1").alias("heading"), T.session_number(F.col("url")).alias("number"), T.simplified(F.col("url")).alias("simple"))


@query(r"""SELECT doc_id, len(list_filter(string_split_regex(trim(text), '\s+'), lambda x: x <> '')) AS n_words FROM documents""")
def i8_word_counts(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.word_count(F.col("text")).cast("long").alias("n_words"))


@query(f"""WITH {A.SEGMENTS}, n AS (SELECT *, lead(start) OVER (PARTITION BY session ORDER BY seg_idx) AS ns, lead("end") OVER (PARTITION BY session ORDER BY seg_idx) AS ne FROM segments)
SELECT session, seg_idx, round((start + "end") / 2, 3) AS midpoint, round(greatest(0, least("end", ne) - greatest(start, ns)), 6) AS overlap,
CASE WHEN "end" > 1000 AND start < 2000000 THEN true ELSE false END AS in_window, round(greatest(0, 1 - abs(("end" - start) - 50) / 25), 6) AS style FROM n WHERE ns IS NOT NULL""")
def i14_i17_interval_scalars(spark, sf):
    from parlance.operators.intervals import overlap

    w = Window.partitionBy("session").orderBy("seg_idx")
    s = A.segments(spark, sf).withColumns({"ns": F.lead("start").over(w), "ne": F.lead("end").over(w)}).where("ns is not null")
    c = F.col
    style = F.greatest(F.lit(0.0), 1 - F.abs((c("end") - c("start")) - 50) / 25)
    return s.select("session", "seg_idx", F.round((c("start") + c("end")) / 2, 3).alias("midpoint"), F.round(overlap(c("start"), c("end"), c("ns"), c("ne")), 6).alias("overlap"), ((c("end") > 1000) & (c("start") < 2000000)).alias("in_window"), F.round(style, 6).alias("style"))


@query("""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), x AS (SELECT *, list_transform(e, lambda x: exp(x - list_max(e))) AS p FROM v)
SELECT vec_id, round(list_dot_product(e, e), 9) AS squared, round(sqrt(list_dot_product(e, e)), 9) AS norm, list_transform(p, lambda x: round(x / list_sum(p), 9)) AS soft FROM x""")
def i12_i16_vector_scalars(spark, sf):
    from parlance.functions import vectors as V

    v = table(spark, sf, "embeddings").select("vec_id", V.doubles(F.col("embedding")).alias("e"))
    soft = F.transform(V.softmax(F.col("e")), lambda x: F.round(x, 9))
    return v.select("vec_id", F.round(V.dot(F.col("e"), F.col("e")), 9).alias("squared"), F.round(V.norm(F.col("e")), 9).alias("norm"), soft.alias("soft"))


@query(rf"""WITH {A.TURNS}, l AS (SELECT session, seg_idx, speaker || ' ' || printf('%02d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) || ' ' || regexp_extract(coalesce(text, ''), '^([^
]*)', 1) AS line FROM (SELECT *, CAST(floor(start) AS BIGINT) AS s FROM turns)),
p AS (SELECT session, seg_idx, line, regexp_extract(line, '{T.SPEAKER_FIRST}', 1) AS speaker, regexp_extract(line, '{T.SPEAKER_FIRST}', 2) AS clock, regexp_extract(line, '{T.SPEAKER_FIRST}', 3) AS said FROM l WHERE regexp_matches(line, '{T.SPEAKER_FIRST}'))
SELECT session, seg_idx, line, speaker, (split_part(clock, ':', 1)::BIGINT * 3600 + split_part(clock, ':', 2)::BIGINT * 60 + split_part(clock, ':', 3)::BIGINT)::DOUBLE AS start, said AS text FROM p""")
def a9_i4_transcript_lines(spark, sf):
    """Every turn's first line, written with its clock and read back; lines without a text aren't transcript lines."""
    t = A.turn_records(spark, sf)
    line = F.concat("speaker", F.lit(" "), T.clock(F.col("start")), F.lit(" "), F.regexp_extract(F.coalesce("text", F.lit("")), r"^([^\n]*)", 1))
    t = t.select("session", "seg_idx", line.alias("line")).withColumn("p", T.transcript_line(F.col("line"))).where("p is not null")
    return t.select("session", "seg_idx", "line", "p.speaker", "p.start", "p.text")


@query(f"""WITH {A.TURNS}, s AS (SELECT session, seg_idx, start, row_number() OVER (PARTITION BY session ORDER BY start, seg_idx) AS idx, speaker, text FROM turns)
SELECT session, idx, speaker || ': ' || trim(text) AS line FROM s WHERE trim(coalesce(text, '')) <> ''""")
def b2_g1_consolidated(spark, sf):
    """All turns in order of time, numbered before blank ones go, as a subtitle writer numbers them."""
    w = Window.partitionBy("session").orderBy("start", "seg_idx")
    t = A.turn_records(spark, sf).withColumn("idx", F.row_number().over(w).cast("long"))
    return t.where("trim(coalesce(text, '')) <> ''").select("session", "idx", F.concat("speaker", F.lit(": "), F.trim("text")).alias("line"))


@query("""WITH m(ord, key, value) AS (VALUES (1, 'src1', 'Alice'), (2, 'src', 'Bob'), (3, 'de', 'Carol')),
d AS (SELECT doc_id, source AS raw, regexp_replace(lower(source), '[^a-z0-9]+', '', 'g') AS simple FROM documents)
SELECT doc_id, coalesce(arg_min(value, (CASE WHEN raw = key OR simple = key THEN 1 ELSE 2 END, ord)) FILTER (raw = key OR simple = key OR (length(key) >= 3 AND (contains(simple, key) OR contains(key, simple)))), any_value(raw)) AS speaker
FROM d CROSS JOIN m GROUP BY doc_id""")
def c1_choose_speaker(spark, sf):
    from parlance.operators.names import choose_speaker

    mapping = spark.createDataFrame([(1, "src1", "Alice"), (2, "src", "Bob"), (3, "de", "Carol")], "ord int, key string, value string")
    return choose_speaker(table(spark, sf, "documents").select("doc_id", F.col("source").alias("name")), "doc_id", "name", mapping)


@query("""SELECT doc_id, CASE lower(trim(lang)) WHEN 'en' THEN 'English' WHEN 'de' THEN 'German' ELSE lang END AS label FROM documents""")
def c3_canonical_alias(spark, sf):
    alias = F.create_map(F.lit("en"), F.lit("English"), F.lit("de"), F.lit("German"))
    return table(spark, sf, "documents").select("doc_id", F.coalesce(alias[F.lower(F.trim("lang"))], "lang").alias("label"))


@query("""SELECT event_id, CASE WHEN a <> b THEN least(a, b) || '::' || greatest(a, b) END AS pair FROM (SELECT event_id, event_type AS a, lag(event_type) OVER (ORDER BY event_id) AS b FROM events)""")
def c4_pair_keys(spark, sf):
    # the order over all rows is the events' own id; the previous event is met by a join on it, not by one global window
    e = table(spark, sf, "events").select("event_id", F.col("event_type").alias("a"))
    last = e.select((F.col("event_id") + 1).alias("event_id"), F.col("a").alias("b"))
    return e.join(last, "event_id", "left").select("event_id", T.pair_key(F.col("a"), F.col("b")).alias("pair"))


@query(f"""WITH {A.TURNS} SELECT session, seg_idx, greatest(0.2, CASE WHEN d < 0.75 THEN 0.60 WHEN d < 1.25 THEN 0.50 WHEN d < 2 THEN 0.35 ELSE 0 END)::DOUBLE AS threshold,
greatest(0.05, CASE WHEN d < 0.75 THEN 0.20 WHEN d < 1.25 THEN 0.14 WHEN d < 2 THEN 0.08 ELSE 0 END)::DOUBLE AS margin FROM (SELECT *, "end" - start AS d FROM turns)""")
def c10_adaptive_gates(spark, sf):
    from parlance.operators.attribution import gates

    t, m = gates(F.col("end") - F.col("start"), F.lit(0.2), F.lit(0.05))
    return A.turn_records(spark, sf).select("session", "seg_idx", t.alias("threshold"), m.alias("margin"))


@query(r"""SELECT 'f' || conv_id AS file, count(*) AS segments, sum(length(text)) AS chars FROM conversations WHERE conv_id % 5 < 3 AND text IS NOT NULL GROUP BY conv_id""")
def c22_payloads(spark, sf):
    """Conversations written as payloads of five shapes, of which three are known, and read back."""
    from parlance.sources.readers import payload_segments

    c = table(spark, sf, "conversations").where("text is not null")
    turn = F.to_json(F.struct(F.col("turn").cast("double").alias("start"), (F.col("turn") + 1.0).alias("end"), F.col("role").alias("speaker"), "text"))
    by = c.groupBy("conv_id").agg(F.array_join(F.sort_array(F.collect_list(turn)), ",").alias("t")).withColumn("name", F.concat(F.lit('"f'), F.col("conv_id").cast("string"), F.lit('"')))
    shape = lambda *x: F.concat(*[F.col(p) if p in ("t", "name") else F.lit(p) for p in x])
    kind = F.col("conv_id") % 5
    value = F.when(kind == 0, shape("[", "name", ", [", "t", ', 7, "x"]]')).when(kind == 1, shape("{", "name", ": [", "t", "]}")).when(kind == 2, shape("{", "name", ': {"segments": [', "t", "]}}")).when(kind == 3, shape("[", "name", ', "text"]')).otherwise(shape("{", "name", ": [", "t", '], "b": []}'))
    rows = payload_segments(by.select(value.alias("value")))
    return rows.groupBy("file").agg(F.count("*").alias("segments"), F.sum(F.length("text")).alias("chars"))
