"""Queries that find inputs in a listing of files."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.functions import text as T
from parlance.operators import discovery as D
from parlance.plans.registry import registry
from parlance.session import table
from parlance.sources import adapters as A

QUERIES, SQL, query = registry()

_PARTS = A.FILES + r""", pp AS (SELECT path, bytes, regexp_replace(regexp_replace(path, '^.*/', ''), '(.)\.[^.]*$', '\1') AS stem, split_part(path, '/', -1) AS name, split_part(path, '/', -2) AS parent, split_part(path, '/', -3) AS grand FROM files)"""
_FIRST = lambda p, i: "coalesce(" + ", ".join(f"nullif(regexp_extract({n}, '{p}', {i}), '')" for n in ("stem", "name", "parent", "grand")) + ")"
_KEYS = "list_distinct(list_transform(regexp_extract_all(lower({0}), 'session\\s*([0-9]+(?:\\s+[0-9]+_[0-9]+)?)', 1), lambda k: 'session ' || regexp_replace(k, '\\s+', ' ', 'g')))"
_STEM = "regexp_replace(regexp_replace({0}, '^.*/', ''), '(.)\\.[^.]*$', '\\1')"


@query(f"""WITH {_PARTS}, s AS (SELECT path, coalesce({", ".join(f"CASE WHEN regexp_matches({n}, '{T.SPLIT_SESSION}') THEN {n} END" for n in ("stem", "name", "parent", "grand"))}) AS split, {_FIRST(T.SESSION, 1)} AS named, {_FIRST(T.PLAIN_NUMBER, 1)} AS plain FROM pp)
SELECT path, CAST(coalesce(CASE WHEN split IS NOT NULL THEN regexp_extract(split, '{T.SPLIT_SESSION}', 1) END, named, plain) AS BIGINT) AS session,
CASE WHEN split IS NOT NULL THEN CAST(regexp_extract(split, '{T.SPLIT_SESSION}', 2) AS BIGINT) END AS part, CASE WHEN split IS NOT NULL THEN CAST(regexp_extract(split, '{T.SPLIT_SESSION}', 3) AS BIGINT) END AS total FROM s""")
def i6_session_identity(spark, sf):
    return A.media_files(spark, sf).select("path", T.session_identity(F.col("path")).alias("s")).select("path", "s.session", "s.part", "s.total")


@query(f"""WITH {A.FILES} SELECT path, array_to_string({_KEYS.format("path")}, '|') AS keys, trim(regexp_replace(regexp_replace(lower({_STEM.format("path")}), '_', ' ', 'g'), '\\s+', ' ', 'g')) AS name FROM files""")
def i7_session_keys(spark, sf):
    f = A.media_files(spark, sf)
    return f.select("path", F.array_join(T.session_keys(F.col("path")), "|").alias("keys"), T.watch_name(T.stem(F.col("path"))).alias("name"))


@query("""SELECT event_id, CASE WHEN b < 1024 THEN printf('%.1f B', b) WHEN b < 1048576 THEN printf('%.1f KiB', b / 1024) WHEN b < 1073741824 THEN printf('%.1f MiB', b / 1048576) WHEN b < 1099511627776 THEN printf('%.1f GiB', b / 1073741824) ELSE printf('%.1f TiB', b / 1099511627776) END AS size
FROM (SELECT event_id, floor(value)::DOUBLE * floor(value) * floor(value) * floor(value) * (event_id % 97) AS b FROM events)""")
def i25_human_bytes(spark, sf):
    v = F.floor("value").cast("double")
    return table(spark, sf, "events").select("event_id", T.human_bytes(v * v * v * v * (F.col("event_id") % 97)).alias("size"))


@query(f"""WITH {A.FILES} SELECT path, bytes FROM files WHERE len(list_intersect(string_split(path, '/')[:-2], ['processed', 'quarantine', '.cache', 'outputs'])) = 0 AND regexp_matches(lower(path), '\\.(zip|wav|mp3|ogg|flac|m4a)$') AND NOT regexp_matches(path, '(^|/)track3\\.[^/]*$')""")
def c24_candidate_media(spark, sf):
    return D.candidate_media(A.media_files(spark, sf), ["track3.*"]).select("path", "bytes")


@query(f"""WITH {A.FILES} SELECT DISTINCT path AS source, 'archive' AS kind FROM files WHERE path LIKE '%.zip' AND regexp_matches({_STEM.format("path")}, '{T.SESSION}')
UNION SELECT 'in/' || split_part(path, '/', 2), 'folder' FROM files WHERE regexp_matches(lower(path), '\\.(wav|mp3|ogg|flac|m4a)$') AND len(string_split(path, '/')) > 2 AND regexp_matches(split_part(path, '/', 2), '{T.SESSION}')""")
def a16_session_sources(spark, sf):
    return D.session_sources(A.media_files(spark, sf), "in")


#: Every source with every transcript, and the points of each pair.
_POINTS = """n AS (SELECT *, list_distinct([lower(wanted), lower(replace(wanted, '_', ' ')), lower(replace(wanted, ' ', '_'))]) AS names, TRY_CAST(nullif(regexp_extract(wanted, '(?i)session[\\s_]*(\\d+)', 1), '') AS BIGINT) AS number FROM s),
t AS (SELECT path, lower(@STEM@) AS own, lower(split_part(path, '/', -1)) AS name, lower(split_part(path, '/', -2)) AS parent FROM transcripts),
u AS (SELECT *, TRY_CAST(coalesce(nullif(regexp_extract(own, 'session[\\s_]*(\\d+)', 1), ''), regexp_extract(own, '(\\d+)', 1)) AS BIGINT) AS on_, TRY_CAST(coalesce(nullif(regexp_extract(parent, 'session[\\s_]*(\\d+)', 1), ''), regexp_extract(parent, '(\\d+)', 1)) AS BIGINT) AS pn FROM t),
p AS (SELECT source, path, CASE WHEN path LIKE '%.jsonl' THEN 40.0 ELSE 20.0 END::DOUBLE - CASE WHEN contains(name, 'copy of') THEN 40 ELSE 0 END + CASE WHEN list_contains(names, own) THEN 200 ELSE 0 END + CASE WHEN list_contains(names, parent) THEN 120 ELSE 0 END + CASE WHEN on_ = number THEN 100 ELSE 0 END + CASE WHEN pn = number THEN 60 ELSE 0 END
  + 30 * len(list_filter(names, lambda x: contains(name, x))) + 20 * len(list_filter(names, lambda x: contains(parent, x))) AS points FROM n CROSS JOIN u)
SELECT source, arg_min(path, (-points, path)) AS transcript, max(points) AS points FROM p WHERE points >= 80 GROUP BY source""".replace("@STEM@", _STEM.format("path"))


@query(f"""WITH {A.FILES}, {A.TRANSCRIPTS}, s AS (SELECT DISTINCT path AS source, {_STEM.format("path")} AS wanted FROM files WHERE path LIKE '%.zip'), {_POINTS}""")
def a17_transcripts(spark, sf):
    sources = A.media_files(spark, sf).where("path like '%.zip'").select(F.col("path").alias("source")).distinct()
    return D.transcript_of(sources, A.transcripts(spark, sf))


@query(f"""WITH {A.FILES}, transcripts AS (SELECT CASE c_custkey % 3 WHEN 0 THEN 't/all of my talk ' || (c_custkey * 7) || ' here/on my talk ' || (c_custkey * 7) || '.jsonl' WHEN 1 THEN 't/My_Talk ' || (c_custkey * 7) || '/copy of xmy_talk ' || (c_custkey * 7) || 'y.jsonl' ELSE 't/x/a my talk ' || (c_custkey * 7) || '.txt' END AS path FROM customer),
s AS (SELECT DISTINCT path AS source, {_STEM.format("path")} AS wanted FROM files WHERE path LIKE '%.mp3'), {_POINTS}""")
def a17_transcripts_by_name(spark, sf):
    """Sources without a session number, and transcripts whose names or folders hold theirs somewhere."""
    n = (F.col("c_custkey") * 7).cast("string")
    path = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("t/all of my talk "), n, F.lit(" here/on my talk "), n, F.lit(".jsonl"))).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("t/My_Talk "), n, F.lit("/copy of xmy_talk "), n, F.lit("y.jsonl"))).otherwise(F.concat(F.lit("t/x/a my talk "), n, F.lit(".txt")))
    sources = A.media_files(spark, sf).where("path like '%.mp3'").select(F.col("path").alias("source")).distinct()
    return D.transcript_of(sources, table(spark, sf, "customer").select(path.alias("path")))


@query(f"""WITH {A.FILES}, w AS (SELECT DISTINCT path, {_STEM.format("path")} AS b FROM files WHERE path LIKE '%.wav'), l AS (SELECT DISTINCT '.outputs/track' || (c_custkey % 7) || '/track' || (c_custkey % 7) || CASE c_custkey % 3 WHEN 0 THEN '.jsonl' WHEN 1 THEN '.diarization.json' ELSE '.json' END AS a FROM customer WHERE c_custkey % 7 <> c_custkey % 3)
SELECT path, arg_min(a, k) AS artifact FROM (SELECT path, unnest([1, 2, 3]) AS k, '.outputs/' || b || '/' || b || unnest(['.jsonl', '.diarization.json', '.json']) AS a FROM w) JOIN l USING (a) GROUP BY path""")
def a18_segment_artifacts(spark, sf):
    k = F.concat(F.lit("track"), (F.col("c_custkey") % 7).cast("string"))
    end = F.when(F.col("c_custkey") % 3 == 0, ".jsonl").when(F.col("c_custkey") % 3 == 1, ".diarization.json").otherwise(".json")
    there = table(spark, sf, "customer").where("c_custkey % 7 <> c_custkey % 3").select(F.concat(F.lit(".outputs/"), k, F.lit("/"), k, end).alias("path")).distinct()
    return D.segment_artifacts(A.media_files(spark, sf).where("path like '%.wav'").select("path").distinct(), there)


@query(f"""WITH {A.SEGMENTS}, f AS (SELECT DISTINCT session, 'in/' || speaker || CASE WHEN session % 2 = 0 THEN '.wav' ELSE '.mp3' END AS audio FROM segments),
s AS (SELECT session, seg_idx, CASE seg_idx % 3 WHEN 0 THEN speaker || '.wav' WHEN 1 THEN speaker ELSE 'x/' || speaker || '.flac' END AS file FROM segments), a AS (SELECT DISTINCT audio FROM f)
SELECT session, seg_idx, file, audio FROM s JOIN a ON split_part(file, '/', -1) IN (split_part(audio, '/', -1), {_STEM.format("audio")}) OR {_STEM.format("file")} IN (split_part(audio, '/', -1), {_STEM.format("audio")})""")
def c15_segments_of_audio(spark, sf):
    s = A.segments(spark, sf)
    audio = s.select(F.concat(F.lit("in/"), "speaker", F.when(F.col("session") % 2 == 0, ".wav").otherwise(".mp3")).alias("path")).distinct()
    file = F.when(F.col("seg_idx") % 3 == 0, F.concat("speaker", F.lit(".wav"))).when(F.col("seg_idx") % 3 == 1, F.col("speaker")).otherwise(F.concat(F.lit("x/"), "speaker", F.lit(".flac")))
    return D.segments_of_audio(s.select("session", "seg_idx", file.alias("file")), audio).select("session", "seg_idx", "file", "audio")


@query(f"""WITH {A.FILES}, {A.TRANSCRIPTS}, i AS (SELECT DISTINCT path, {_KEYS.format("path")} AS keys, trim(regexp_replace(regexp_replace(lower({_STEM.format("path")}), '_', ' ', 'g'), '\\s+', ' ', 'g')) AS plain FROM files),
o AS (SELECT path AS done, {_KEYS.format("path")} AS keys, trim(regexp_replace(regexp_replace(lower({_STEM.format("path")}), '_', ' ', 'g'), '\\s+', ' ', 'g')) AS plain FROM transcripts),
ik AS (SELECT path, unnest(keys) AS k FROM i), ok AS (SELECT done, unnest(keys) AS k FROM o),
m AS (SELECT path, done FROM ik JOIN ok USING (k) UNION ALL SELECT path, done FROM i JOIN o USING (plain) WHERE len(i.keys) = 0)
SELECT path, min(done) AS done FROM m GROUP BY path""")
def k6_already_done(spark, sf):
    return D.already_done(A.media_files(spark, sf).select("path"), A.transcripts(spark, sf))


@query(f"""WITH {A.FILES}, i AS (SELECT DISTINCT path, {_STEM.format("path")} AS name, regexp_extract(path, '(\\.[^./]+)$', 1) AS kind FROM files WHERE path LIKE '%.wav'),
g AS (SELECT DISTINCT 'track' || (c_custkey % 4) AS name, CASE WHEN c_custkey % 5 = 0 THEN 1 ELSE c_custkey % 5 + 1 END AS number FROM customer),
p AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY path) AS place FROM i), u AS (SELECT name, list(DISTINCT number) AS used FROM g GROUP BY name),
f AS (SELECT path, name, kind, list_filter(generate_series(1, len(coalesce(used, [])) + place), lambda n: NOT list_contains(coalesce(used, []), n))[place] AS number FROM p LEFT JOIN u USING (name))
SELECT path, 'done/' || name || CASE WHEN number = 1 THEN '' ELSE '__' || number END || kind AS target FROM f""")
def k4_archive_moves(spark, sf):
    n = F.when(F.col("c_custkey") % 5 == 0, F.lit("")).otherwise(F.concat(F.lit("__"), (F.col("c_custkey") % 5 + 1).cast("string")))
    there = table(spark, sf, "customer").select(F.concat(F.lit("done/track"), (F.col("c_custkey") % 4).cast("string"), n, F.lit(".wav")).alias("path")).distinct()
    return D.archive_moves(A.media_files(spark, sf).where("path like '%.wav'").select("path"), there, "done")
