"""URL filter: host and path rules, then a blocked Bloom filter of listed canonical URLs with an exact join behind it.

A list holds entries of three kinds: URLs (one page), hosts (with all their subdomains) and host labels (words between the dots and
hyphens of any host). Each is a key: the canonical URL, `//host`, `#label`. A page asks for its own URL, its host and each
domain above it, and the labels of its host.

Listed keys are hashed into blocks of 512 bits (eight 64-bit words, one bit in each). The filter is a table of
its non-empty blocks. Pages probe it by block number; possible hits alone go on to an exact join on the key itself, which
removes the false positives. The block table is broadcast only while the number of listed keys, counted first, keeps it
under `broadcast_limit` bytes; beyond that it is a shuffle join on the block number. Judged pages are written once, and each distinct
URL asks once, so a URL that a third of all pages share is one probe.

Built-in functions only.

Defined cases: a null url, or one without '://', has empty host and path, no rule, and is never listed;
empty lists block nothing; null entries are left out; repeated rows are judged one by one; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm.common import join_hot, materialize

#: Fixed rules: (verdict, host, path).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Fixed entries of the production list: host labels that name what a site is, by category. Nothing of the judged pages goes into it.
LISTED_LABELS = {
    "gambling": "bet bets betting bingo blackjack bookmaker casino casinos gamble gambling jackpot lottery poker roulette slots sportsbook wager",
    "adult": "adult cams escort escorts erotic hentai nude nudes porn porno sex sexy webcam xxx",
    "pharmacy": "cialis pharmacy pill pills viagra",
    "advertising and tracking": "ad ads adserver adservice adtech adtrack analytics banner banners beacon click clicks doubleclick pixel popunder popup sponsor telemetry track tracker tracking",
    "spam and fraud": "crack cracked keygen malware phishing replica scam spam spammer warez",
}
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = 8
KEYS_PER_BLOCK = 32


def host_of(url: Column) -> Column:
    """After the first '://' up to '/', '?', '#' or the end, A-Z lower-cased; empty without '://'."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without www. and default port, path without trailing slash or .html, query without tracking keys; null without '://'."""
    host = F.regexp_replace(F.regexp_replace(host_of(url), r":(80|443)$", ""), r"^www\.", "")
    path = F.regexp_replace(path_of(url), r"(\.html|/+)$", "")
    query = F.regexp_replace(F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1), r"(^|&)(utm_[a-z]+|ref)=[^&]*", "")
    query = F.regexp_replace(query, "^&", "")
    return F.when(F.instr(url, "://") > 0, F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting rule as struct(rule, verdict), null if none fits."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        found = F.coalesce(found, F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))))
    return found


def _bit(key: Column, word: int) -> Column:
    """One of 64 bits, from six bits of a second hash."""
    return F.expr("shiftleft(1L, cast(pmod({0}, 64) as int))".format(f"shiftright(h2, {6 * word})"))


def _hashed(df: DataFrame, blocks: int) -> DataFrame:
    """df with the block and the second hash of its key."""
    return df.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks))).withColumn("h2", F.xxhash64(F.lit(17), "key"))


def labels_of(host: Column) -> Column:
    return F.split(host, r"[.\-]")


def keys_of(url: Column) -> Column:
    """All keys under which a page may be listed."""
    host = F.regexp_replace(host_of(url), r":[0-9]+$", "")
    parts = F.split(host, r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(F.lit("//"), F.array_join(F.slice(parts, i, F.size(parts)), ".")))
    named = F.transform(labels_of(host), lambda x: F.concat(F.lit("#"), x))
    return F.when(F.instr(url, "://") > 0, F.array_distinct(F.concat(F.array(canonical(url)), above, named)))


def entry_key(kind: Column, value: Column) -> Column:
    """Key of a list entry: kind is url, host or label."""
    plain = F.translate(value, _UPPER, _LOWER)
    return F.when(kind == "url", canonical(value)).when(kind == "host", F.concat(F.lit("//"), plain)).when(kind == "label", F.concat(F.lit("#"), plain))


def production_list(spark: SparkSession) -> DataFrame:
    """kind, value: the fixed labels."""
    words = [w for line in LISTED_LABELS.values() for w in line.split()]
    return spark.createDataFrame([("label", w) for w in words], "kind string, value string")


def bloom_blocks(listed: DataFrame, blocks: int) -> DataFrame:
    """The non-empty blocks of the filter: block, w0 .. w7. listed: key, distinct."""
    return _hashed(listed, blocks).groupBy("block").agg(*[F.bit_or(_bit(F.col("h2"), i)).alias(f"w{i}") for i in range(WORDS)])


def possible_hits(asked: DataFrame, listed: DataFrame, blocks: int, bloom: DataFrame) -> DataFrame:
    """The rows of asked (key and more) that the filter lets pass: all listed keys, and false positives."""
    passes = F.lit(True)
    for i in range(WORDS):
        passes = passes & (F.col(f"w{i}").bitwiseAND(_bit(F.col("h2"), i)) != 0)
    return _hashed(asked, blocks).join(bloom, "block").where(passes).select(asked.columns)


def filter_urls(pages: DataFrame, listed: DataFrame, rules=RULES, broadcast_limit: int = 64 << 20) -> DataFrame:
    """page_id, host, path, rule, verdict, listed. listed: kind (url, host or label) and value; listed pages are blocked where no rule fits."""
    listed = materialize(listed.select(entry_key(F.col("kind"), F.col("value")).alias("key")).where("key is not null").distinct(), "listed")
    n = listed.count()
    blocks = max(1, n // KEYS_PER_BLOCK)
    bloom = bloom_blocks(listed, blocks)
    if blocks * 8 * (WORDS + 1) <= broadcast_limit:
        bloom = F.broadcast(bloom)
    u = F.col("url")
    judged = pages.select("page_id", "url", host_of(u).alias("host"), path_of(u).alias("path")).withColumn("r", rule_of(F.col("host"), F.col("path")))
    judged = materialize(judged, "judged")
    asked = judged.where("r is null and url is not null").select("url").distinct().select("url", F.explode(keys_of(u)).alias("key"))
    hits = possible_hits(asked, listed, blocks, bloom).join(listed, "key", "left_semi").select("url").distinct()
    hits = materialize(hits.withColumn("listed", F.lit(True)), "hits")
    rule, known = F.col("r.rule").alias("rule"), F.coalesce("listed", F.lit(False))
    verdict = F.coalesce(F.col("r.verdict"), F.when(known, "block").otherwise("allow")).alias("verdict")
    return join_hot(judged, hits, "url", "page_id", "left").select("page_id", "host", "path", rule, verdict, known.alias("listed"))
