"""Scalar text and time functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def word_count(text: Column) -> Column:
    """Words between white space; null and blank texts have none."""
    return F.size(F.filter(F.split(F.trim(F.coalesce(text, F.lit(""))), r"\s+"), lambda x: x != ""))


def clock(seconds: Column) -> Column:
    """HH:MM:SS, seconds cut off; hours may exceed 99."""
    s = F.floor(seconds)
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60), F.pmod(s, F.lit(60)))


def srt_clock(seconds: Column) -> Column:
    """HH:MM:SS,mmm with half-even milliseconds."""
    ms = F.bround(seconds * 1000).cast("long")
    part = lambda n, d: F.pmod(F.floor(ms / n), F.lit(d)).cast("long")
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(ms / 3_600_000), part(60_000, 60), part(1000, 60), F.pmod(ms, F.lit(1000)))


def clock_seconds(text: Column) -> Column:
    """Seconds of H:MM:SS."""
    p = F.split(text, ":")
    return p[0].cast("long") * 3600 + p[1].cast("long") * 60 + p[2].cast("long")


def simplified(key: Column) -> Column:
    """Lower case, letters a-z and digits only."""
    return F.regexp_replace(F.lower(key), "[^a-z0-9]+", "")


def stem(path: Column) -> Column:
    """File name without its last suffix."""
    return F.regexp_replace(F.regexp_replace(path, r"^.*/", ""), r"(?<=.)\.[^.]*$", "")


def blank_to_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def pair_key(a: Column, b: Column) -> Column:
    """least::greatest of two different non-blank labels, else null."""
    a, b = blank_to_null(a), blank_to_null(b)
    return F.when(a != b, F.concat_ws("::", F.least(a, b), F.greatest(a, b)))


def valid_label(label: Column) -> Column:
    return F.coalesce(~F.lower(F.trim(label)).isin("", "unknown", "<unmatched>"), F.lit(False))


def tagged(text: Column, tag: str) -> Column:
    """What the first <tag>...</tag> holds, trimmed; null without one."""
    return F.when(text.rlike(f"(?is)<{tag}>.*?</{tag}>"), F.trim(F.regexp_extract(text, f"(?is)<{tag}>(.*?)</{tag}>", 1)))


def session_number(text: Column) -> Column:
    """The number after 'session', else the first number."""
    named = F.regexp_extract(text, r"(?i)session[\s_]*(\d+)", 1)
    return F.coalesce(F.nullif(named, F.lit("")), F.nullif(F.regexp_extract(text, r"(\d+)", 1), F.lit(""))).cast("long")


#: Fixed shapes of a transcript line: speaker first, or time first.
SPEAKER_FIRST = r"^(.+?)\s+(\d{1,2}:\d{2}:\d{2})\s+(.+?)\s*$"
TIME_FIRST = r"^(\d{1,2}:\d{2}:\d{2})\s*:\s*([^:]+?)\s*:\s*(.+?)\s*$"


def transcript_line(line: Column) -> Column:
    """struct(speaker, start, text) of a timed transcript line, null if it has neither shape; a speaker and a text are needed."""
    a, b = [lambda i, p=p: F.regexp_extract(line, p, i) for p in (SPEAKER_FIRST, TIME_FIRST)]
    row = lambda s, t, x: F.struct(s.alias("speaker"), clock_seconds(t).cast("double").alias("start"), x.alias("text"))
    return F.when(line.rlike(SPEAKER_FIRST), row(a(1), a(2), a(3))).when(line.rlike(TIME_FIRST), row(b(2), b(1), b(3)))


#: Fixed shapes of session names: part k of n, a session, any number; and the keys by which files are matched.
SPLIT_SESSION = r"(?i)session[\s_-]*(\d+)[\s_-]+(\d+)_(\d+)"
SESSION = r"(?i)session[\s_-]*(\d+)"
PLAIN_NUMBER = r"(\d+)"
SESSION_KEY = r"(?i)session\s*([0-9]+(?:\s+[0-9]+_[0-9]+)?)"


def path_parts(path: Column) -> tuple[Column, Column, Column, Column]:
    """Stem, name, parent's name and grandparent's name, '' where there is none."""
    parts = F.split(path, "/")
    at = lambda i: F.coalesce(F.try_element_at(parts, F.lit(i)), F.lit(""))
    return stem(path), at(-1), at(-2), at(-3)


def session_identity(path: Column) -> Column:
    """struct(session, part, total) of a file; part and total only for a split session; null without any number in its name or those of its two folders."""
    names = path_parts(path)
    first = lambda p, i: F.coalesce(*[F.nullif(F.regexp_extract(n, p, i), F.lit("")) for n in names]).cast("long")
    split = F.coalesce(*[F.when(n.rlike(SPLIT_SESSION), n) for n in names])
    of = lambda i: F.regexp_extract(split, SPLIT_SESSION, i).cast("long")
    no = F.lit(None).cast("long")
    plain = F.coalesce(first(SESSION, 1), first(PLAIN_NUMBER, 1))
    row = lambda s, k, n: F.struct(s.alias("session"), k.alias("part"), n.alias("total"))
    return F.when(split.isNotNull(), row(of(1), of(2), of(3))).when(plain.isNotNull(), row(plain, no, no))


def session_keys(path: Column) -> Column:
    """The distinct 'session N' and 'session N k_n' keys in any part of a path, spaces made single."""
    found = F.flatten(F.transform(F.split(path, "/"), lambda p: F.regexp_extract_all(p, F.lit(SESSION_KEY), F.lit(1))))
    return F.array_distinct(F.transform(found, lambda k: F.concat(F.lit("session "), F.regexp_replace(k, r"\s+", " "))))


def watch_name(text: Column) -> Column:
    """Lower case, underscores and runs of white space as one space."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), "_", " "), r"\s+", " "))


def human_bytes(size: Column) -> Column:
    """One decimal and the largest unit up to TiB that leaves at least 1; 'n/a' for null."""
    units = ["B", "KiB", "MiB", "GiB", "TiB"]
    x = size.cast("double")
    out = F.lit("n/a")
    for i in reversed(range(len(units))):
        text = F.format_string(f"%.1f {units[i]}", F.bround(x / 1024.0**i, 1))
        out = F.when(x.isNull(), "n/a").when(x < 1024.0 ** (i + 1), text).otherwise(out) if i < 4 else F.when(x.isNotNull(), text).otherwise("n/a")
    return out


def stable_seed(*parts: Column) -> Column:
    """A seed that depends on the parts alone, whatever the order of rows or the number of tasks."""
    return F.xxhash64(*parts)


def slug(text: Column) -> Column:
    """Lower case, letters and digits, other runs as one hyphen."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")
