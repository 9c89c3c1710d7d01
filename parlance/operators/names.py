"""Matching file and speaker names to a mapping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.functions.text import simplified, stem


def choose_speaker(rows: DataFrame, key: str, name: str, mapping: DataFrame) -> DataFrame:
    """key, speaker: the mapping's value for the name, else its stem.

    Candidates are the stem, what follows its last hyphen, and the stem without a leading number. Equal keys (as they are or
    simplified) come before substrings either way, which need three characters and a letter. Order of mapping and
    candidates breaks ties.
    """
    base = stem(F.col(name))
    found = F.array(base, F.regexp_extract(base, r"([^-]*)$", 1), F.regexp_replace(base, r"^\d+-", ""))
    m = mapping.select("ord", "key", "value", simplified(F.col("key")).alias("simple"))
    c = rows.select(key, base.alias("stem"), F.posexplode(found).alias("place", "cand")).withColumn("cs", simplified(F.col("cand")))
    exact = (F.col("cand") == F.col("key")) | ((F.col("cs") == F.col("simple")) & (F.col("cs") != ""))
    long = lambda x: (F.length(x) >= 3) & x.rlike("[a-z]")
    part = long(F.col("simple")) & long(F.col("cs")) & (F.contains("cs", "simple") | F.contains("simple", "cs"))
    # every kind of hit has an equal key: the name, the simplified name, or the last three characters of the one that the other holds
    grams = lambda x: F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(x) - 2), lambda i: F.substr(x, i, F.lit(3)))))
    end = lambda df, x: df.where(long(F.col(x))).withColumn("_k", F.right(x, F.lit(3)))
    all_ = lambda df, x: df.where(long(F.col(x))).withColumn("_k", grams(F.col(x)))
    ways = [(c.withColumn("_k", F.col("cand")), m.withColumn("_k", F.col("key"))), (c.withColumn("_k", F.col("cs")), m.withColumn("_k", F.col("simple"))), (all_(c, "cs"), end(m, "simple")), (end(c, "cs"), all_(m, "simple"))]
    hits = None
    for x, y in ways:
        met = x.join(y, "_k").where(exact | part).select(x[key], "value", F.struct(F.when(exact, 1).otherwise(2).alias("pass"), "place", "ord").alias("o"))
        hits = met if hits is None else hits.unionByName(met)
    best = hits.groupBy(key).agg(F.min_by("value", "o").alias("value"))
    return rows.select(key, base.alias("stem")).join(best, key, "left").select(key, F.coalesce("value", "stem").alias("speaker"))


def resolved_labels(rows: DataFrame, key: str, name: str, mapping: DataFrame) -> DataFrame:
    """key, label, matched: the mapping's value for a raw label; the label itself, trimmed, where nothing fits; 'unknown' for a blank one."""
    raw = F.trim(F.coalesce(F.col(name), F.lit("")))
    some = rows.select(key, raw.alias("raw"))
    marked = mapping.select("ord", "key", F.concat(F.lit("\u0001"), F.col("value")).alias("value"))  # tells a match from a fallback
    found = choose_speaker(some, key, "raw", marked)
    matched = F.col("speaker").startswith("\u0001")
    out = some.join(found, key).withColumn("matched", matched)
    label = F.when(F.col("matched"), F.substring("speaker", 2, 1 << 20)).when(F.lower("raw").isin("", "unknown"), "unknown").otherwise(F.col("raw"))
    return out.select(key, label.alias("label"), "matched")
