"""The library's tables made from the driver's, and the same as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parlance.functions.text import word_count
from parlance.session import table


def turn_records(spark: SparkSession, sf: str) -> DataFrame:
    """session, seg_idx, speaker, text, n_words, start, end: turns laid end to end, 0.35 s a word, 1 to 15 s."""
    t = table(spark, sf, "conversations").select(F.col("conv_id").alias("session"), F.col("turn").alias("seg_idx"), F.col("role").alias("speaker"), "text")
    t = t.withColumn("n_words", word_count(F.col("text")).cast("long"))
    t = t.withColumn("ms", F.least(F.lit(15000), F.greatest(F.lit(1000), 350 * F.col("n_words"))).cast("long"))
    w = Window.partitionBy("session").orderBy("seg_idx").rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("until", F.sum("ms").over(w))
    return t.select("session", "seg_idx", "speaker", "text", "n_words", ((F.col("until") - F.col("ms")) / 1000.0).alias("start"), (F.col("until") / 1000.0).alias("end"))


TURNS = r"""turns AS (
  SELECT session, seg_idx, speaker, text, n_words, (until - ms) / 1000.0::DOUBLE AS start, until / 1000.0::DOUBLE AS "end" FROM (
    SELECT *, sum(ms) OVER (PARTITION BY session ORDER BY seg_idx) AS until FROM (
      SELECT conv_id AS session, turn AS seg_idx, role AS speaker, text, n_words, least(15000, greatest(1000, 350 * n_words)) AS ms FROM (
        SELECT *, len(list_filter(string_split_regex(trim(coalesce(text, '')), '\s+'), lambda x: x <> '')) AS n_words FROM conversations))))"""


def segments(spark: SparkSession, sf: str) -> DataFrame:
    """session, seg_idx, start, end, speaker, speaker_raw from events; overlapping and gapped, as real turns are."""
    e = table(spark, sf, "events")
    start = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 / 200
    e = e.select(F.col("user_id").alias("session"), "event_id", "ts", start.alias("start"), F.col("event_type").alias("speaker"), "value")
    w = Window.partitionBy("session").orderBy("ts", "event_id")
    return e.select("session", (F.row_number().over(w) - 1).cast("long").alias("seg_idx"), "start", (F.col("start") + F.col("value")).alias("end"), "speaker", F.concat(F.lit("S"), (F.col("event_id") % 3).cast("string")).alias("speaker_raw"))


SEGMENTS = """segments AS (
  SELECT user_id AS session, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seg_idx,
         epoch_us(ts) / 1e6::DOUBLE / 200 AS start, epoch_us(ts) / 1e6::DOUBLE / 200 + value AS "end", event_type AS speaker, 'S' || (event_id % 3) AS speaker_raw
  FROM events)"""


def words(spark: SparkSession, sf: str) -> DataFrame:
    """session, seg_idx, word_idx, word, speaker, start, end: a turn's words spread evenly over it."""
    t = turn_records(spark, sf)
    w = F.filter(F.split(F.trim("text"), r"\s+"), lambda x: x != "")
    t = t.withColumn("w", w).select("session", "seg_idx", "speaker", "start", "end", F.size("w").alias("n"), F.posexplode("w").alias("word_idx", "word"))
    step = (F.col("end") - F.col("start")) / F.col("n")
    return t.select("session", "seg_idx", F.col("word_idx").cast("long").alias("word_idx"), "word", "speaker", (F.col("start") + F.col("word_idx") * step).alias("start"), (F.col("start") + (F.col("word_idx") + 1) * step).alias("end"))


WORDS = TURNS + r""", words AS (
  SELECT session, seg_idx, i - 1 AS word_idx, w[i] AS word, speaker, start + (i - 1) * (("end" - start) / n) AS start, start + i * (("end" - start) / n) AS "end"
  FROM (SELECT *, len(w) AS n, unnest(generate_series(1, len(w))) AS i FROM (
    SELECT *, list_filter(string_split_regex(trim(text), '\s+'), lambda x: x <> '') AS w FROM turns)))"""


def shifted_words(spark: SparkSession, sf: str) -> DataFrame:
    """What a recogniser might return for words(): times off by up to 0.4 s, every seventh word missing, some speakers swapped."""
    w = words(spark, sf)
    k = F.col("seg_idx") * 31 + F.col("word_idx")
    moved = (F.pmod(k, F.lit(9)) - 4) / 10.0
    other = F.when(F.pmod(k, F.lit(11)) == 0, F.when(F.col("speaker") == "user", "assistant").otherwise("user")).otherwise(F.col("speaker"))
    return w.where(F.pmod(k, F.lit(7)) != 0).select("session", "seg_idx", "word_idx", "word", other.alias("speaker"), (F.col("start") + moved).alias("start"), (F.col("end") + moved).alias("end"))


SHIFTED = WORDS + """, shifted AS (
  SELECT session, seg_idx, word_idx, word, CASE WHEN k % 11 = 0 THEN CASE WHEN speaker = 'user' THEN 'assistant' ELSE 'user' END ELSE speaker END AS speaker,
         start + ((k % 9) - 4) / 10.0::DOUBLE AS start, "end" + ((k % 9) - 4) / 10.0::DOUBLE AS "end"
  FROM (SELECT *, seg_idx * 31 + word_idx AS k FROM words) WHERE k % 7 <> 0)"""


def bank(spark: SparkSession, sf: str) -> DataFrame:
    """entry_idx, speaker, embedding: all vectors."""
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("entry_idx"), F.concat(F.lit("spk_"), F.col("label").cast("string")).alias("speaker"), "embedding")


def sessions_of_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """session, seg_idx, embedding, own: all vectors of bank(), each with its speaker so that a search can leave it out."""
    return bank(spark, sf).select((F.col("entry_idx") % 7).alias("session"), F.col("entry_idx").alias("seg_idx"), "embedding", F.col("speaker").alias("own"))


def queries(spark: SparkSession, sf: str) -> DataFrame:
    """The searches: vectors whose id is divisible by 100, against all others."""
    return sessions_of_vectors(spark, sf).where("seg_idx % 100 = 0")


BANK = """bank AS (SELECT vec_id AS entry_idx, 'spk_' || label AS speaker, embedding::DOUBLE[] AS v FROM embeddings),
queries AS (SELECT entry_idx % 7 AS session, entry_idx AS seg_idx, speaker AS own, v FROM bank WHERE entry_idx % 100 = 0)"""


def dataset(spark: SparkSession, sf: str) -> DataFrame:
    """row_id, label, domain, source, session, duration, dominant_share, active_speakers from lineitem."""
    line = table(spark, sf, "lineitem")
    return line.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id"),
        F.concat(F.lit("spk_"), (F.col("l_suppkey") % 6).cast("string")).alias("label"),
        F.col("l_linestatus").alias("domain"),
        F.when(F.col("l_returnflag") == "N", "mixed_raw").when(F.col("l_returnflag") == "A", "mixed_aug_total").otherwise("bank").alias("source"),
        F.concat(F.lit("Session "), (F.col("l_partkey") % 40).cast("string")).alias("session"),
        (F.col("l_quantity") / 10).alias("duration"),
        F.when(F.col("l_partkey") % 13 != 0, 1 - F.col("l_discount") * 4).alias("dominant_share"),
        (F.col("l_linenumber") - 2).alias("active_speakers"),
    )


DATASET = """dataset AS (
  SELECT l_orderkey * 10 + l_linenumber AS row_id, 'spk_' || (l_suppkey % 6) AS label, l_linestatus AS domain,
         CASE l_returnflag WHEN 'N' THEN 'mixed_raw' WHEN 'A' THEN 'mixed_aug_total' ELSE 'bank' END AS source, 'Session ' || (l_partkey % 40) AS session,
         l_quantity / 10 AS duration, CASE WHEN l_partkey % 13 <> 0 THEN 1 - l_discount * 4 END AS dominant_share, l_linenumber - 2 AS active_speakers
  FROM lineitem)"""


def media_files(spark: SparkSession, sf: str) -> DataFrame:
    """path, bytes: a listing of a watched folder, one file an event."""
    e = table(spark, sf, "events")
    user, n = F.col("user_id").cast("string"), F.col("event_id").cast("string")
    path = (
        F.when(F.col("event_type") == "click", F.concat(F.lit("in/Session "), user, F.when(F.col("event_id") % 2 == 0, F.concat(F.lit(" "), (F.col("event_id") % 3 + 1).cast("string"), F.lit("_3"))).otherwise(""), F.lit(".zip")))
        .when(F.col("event_type") == "view", F.concat(F.lit("in/session_"), user, F.lit("/track"), (F.col("event_id") % 5).cast("string"), F.lit(".wav")))
        .when(F.col("event_type") == "error", F.concat(F.lit("in/processed/old"), n, F.lit(".wav")))
        .when(F.col("event_type") == "signup", F.concat(F.lit("in/My_Talk "), n, F.lit(".mp3")))
        .otherwise(F.concat(F.lit("in/notes/"), user, F.lit(" copy.txt")))
    )
    return e.select(path.alias("path"), F.round(F.col("value") * 1000).cast("long").alias("bytes"))


FILES = """files AS (SELECT CASE event_type WHEN 'click' THEN 'in/Session ' || user_id || CASE WHEN event_id % 2 = 0 THEN ' ' || (event_id % 3 + 1) || '_3' ELSE '' END || '.zip'
  WHEN 'view' THEN 'in/session_' || user_id || '/track' || (event_id % 5) || '.wav' WHEN 'error' THEN 'in/processed/old' || event_id || '.wav' WHEN 'signup' THEN 'in/My_Talk ' || event_id || '.mp3'
  ELSE 'in/notes/' || user_id || ' copy.txt' END AS path, CAST(round(value * 1000) AS BIGINT) AS bytes FROM events)"""


def transcripts(spark: SparkSession, sf: str) -> DataFrame:
    """path: what is already written, one file a customer."""
    key = F.col("c_custkey").cast("string")
    path = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("out/session "), key, F.lit("/all.txt"))).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("out/Session"), key, F.lit(" 1_3.txt"))).otherwise(F.concat(F.lit("out/my talk "), key, F.lit(".txt")))
    return table(spark, sf, "customer").select(path.alias("path"))


TRANSCRIPTS = """transcripts AS (SELECT CASE c_custkey % 3 WHEN 0 THEN 'out/session ' || c_custkey || '/all.txt' WHEN 1 THEN 'out/Session' || c_custkey || ' 1_3.txt' ELSE 'out/my talk ' || c_custkey || '.txt' END AS path FROM customer)"""


def vector_segments(spark: SparkSession, sf: str) -> DataFrame:
    """session, seg_idx, start, end, speaker_raw, overlap_heavy, was_split: the segments that sessions_of_vectors() belong to."""
    i = F.col("vec_id")
    start = i * 0.5
    flags = [(i % 11 == 0).alias("overlap_heavy"), (i % 13 == 0).alias("was_split")]
    return table(spark, sf, "embeddings").select((i % 7).alias("session"), i.alias("seg_idx"), start.alias("start"), (start + 1 + (i * 37 % 50) / 10.0).alias("end"), F.concat(F.lit("S"), F.floor(i / 21 % 4).cast("string")).alias("speaker_raw"), *flags)


VECTOR_SEGMENTS = """vsegments AS (SELECT vec_id % 7 AS session, vec_id AS seg_idx, vec_id * 0.5::DOUBLE AS start, vec_id * 0.5::DOUBLE + 1 + (vec_id * 37 % 50) / 10.0::DOUBLE AS "end",
  'S' || (vec_id // 21 % 4) AS speaker_raw, vec_id % 11 = 0 AS overlap_heavy, vec_id % 13 = 0 AS was_split FROM embeddings)"""
