"""Fill-in-the-middle forms of whole texts, cut at token borders found by overlapping chunks.

A token is a run of white space with the word after it; white space at the end of a text is a token of its own. So a token ends where
a byte that is no white space is followed by white space or by the end of the text: a predicate on neighbouring bytes only
(all white space is ASCII, so no byte inside a longer character can be taken for it). The texts of an Arrow batch are cut into chunks of
`CHUNK` bytes that overlap by one byte; every chunk's token ends and code points are counted by itself, all chunks of
a slice at once. Prefix sums over the chunks give the tokens of each text and the chunk that owns each of its two cuts; these
chunks alone are scanned again to find the place within.

Spark deals the texts over tasks; a task holds a batch of texts and about `SLICE` bytes of temporary arrays, however long a text is. Texts are never
shuffled, and only three integers a text come back from Python: the forms are put together by Spark's own functions.

Texts too long for one row can be given as a table of pieces: `cut_pieces` counts each piece in its own task, adds the counts up in a window and
scans again only the pieces that own a cut.

Defined cases: null text is empty, has no tokens and stays plain, as does any text that holds a marker; a null doc_id draws as the empty
string would; repeated rows are worked out alike, each for itself; empty tables give no rows; further columns are kept by
`fill_in_middle`, whatever their names but those that it adds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of a chunk, and bytes of text whose temporary arrays are held at once.
CHUNK, SLICE = 4096, 4 << 20
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True


def ends(buf: np.ndarray, a: int, b: int, last: np.ndarray | int) -> np.ndarray:
    """Whether a token's word ends at each byte of buf[a:b]; reads one byte more. last: places in a:b (from 0) where a text ends."""
    word = ~_SPACE[buf[a : b + 1]]
    if len(word) == b - a:  # nothing follows the last byte
        word = np.append(word, False)
    out = word[:-1] & ~word[1:]
    out[last] = word[:-1][last]
    return out


def _starts(buf: np.ndarray) -> np.ndarray:
    """Whether a code point begins at each byte."""
    return (buf & 0xC0) != 0x80


def chunk_counts(buf: np.ndarray, bounds: np.ndarray, chunk: int = CHUNK) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first byte of each chunk, token ends, code points, first chunk of each text) of texts bounds[i]:bounds[i+1]."""
    n_chunks = -(-np.diff(bounds) // chunk)
    first = np.concatenate(([0], np.cumsum(n_chunks)))
    at = np.repeat(bounds[:-1], n_chunks) + chunk * (np.arange(first[-1]) - np.repeat(first[:-1], n_chunks))
    tokens, points = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    stops = np.append(at, bounds[-1])
    text_ends = bounds[1:][n_chunks > 0] - 1
    lo = 0
    while lo < len(at):
        hi = max(lo + 1, int(np.searchsorted(stops, stops[lo] + SLICE, "right")) - 1)
        a, b = stops[lo], stops[hi]
        mine = text_ends[np.searchsorted(text_ends, a) : np.searchsorted(text_ends, b)] - a
        tokens[lo:hi] = np.add.reduceat(ends(buf, a, b, mine), at[lo:hi] - a, dtype=np.int64)
        points[lo:hi] = np.add.reduceat(_starts(buf[a:b]), at[lo:hi] - a, dtype=np.int64)
        lo = hi
    return at, tokens, points, first


def _place(buf: np.ndarray, a: int, b: int, end: int, rank: int) -> int:
    """Byte after the rank-th (from 1) token end of the chunk a:b of a text that ends at end."""
    return a + int(np.flatnonzero(ends(buf, a, b, [b - a - 1] if b == end else []))[rank - 1]) + 1


def cut_texts(buf: np.ndarray, bounds: np.ndarray, draws: np.ndarray, wanted: np.ndarray, chunk: int = CHUNK) -> tuple[np.ndarray, np.ndarray]:
    """(tokens of each text, code points before its two cuts): a cut follows draw % (tokens + 1) tokens, the smaller first; only for wanted texts."""
    at, tokens, points, first = chunk_counts(buf, bounds, chunk)
    before, points_before = np.concatenate(([0], np.cumsum(tokens))), np.concatenate(([0], np.cumsum(points)))
    words = before[first[1:]] - before[first[:-1]]
    size = np.diff(bounds)
    tail = np.zeros(len(size), bool)
    full = np.flatnonzero(size > 0)
    tail[full] = _SPACE[buf[bounds[full + 1] - 1]]
    n = words + tail
    ranks = np.sort(draws % (n + 1)[:, None], axis=1)
    cuts = np.zeros(ranks.shape, np.int64)
    whole = points_before[first[1:]] - points_before[first[:-1]]
    for side in (0, 1):
        rank = ranks[:, side]
        cuts[:, side] = np.where(rank > words, whole, 0)  # after the white space at the end
        inner = np.flatnonzero(wanted & (rank > 0) & (rank <= words))
        goal = before[first[inner]] + rank[inner]
        for i, own, left in zip(inner, o := np.searchsorted(before, goal, "left") - 1, goal - before[o], strict=True):
            a, end = at[own], bounds[i + 1]
            place = _place(buf, a, min(a + chunk, end), end, left)
            cuts[i, side] = points_before[own] - points_before[first[i]] + np.count_nonzero(_starts(buf[a:place]))
    return n, cuts


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow array of strings without a copy, and the bounds of its texts."""
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return np.frombuffer(data if data is not None else b"", np.uint8), bounds


_CUT = "struct<n: bigint, a: bigint, b: bigint>"


def cuts(chunk: int = CHUNK):
    """The Arrow UDF (text, draw, draw, wanted) -> (n tokens, code points before the first cut, before the second)."""

    @F.arrow_udf(_CUT)
    def cut(text: pa.Array, one: pa.Array, two: pa.Array, wanted: pa.Array) -> pa.Array:
        if not len(text):
            return pa.array([], pa.struct([("n", pa.int64()), ("a", pa.int64()), ("b", pa.int64())]))
        buf, bounds = _bytes_of(text)
        n, c = cut_texts(buf, bounds, np.stack([one.to_numpy(), two.to_numpy()], axis=1), wanted.to_numpy(zero_copy_only=False), chunk)
        return pa.StructArray.from_arrays([pa.array(n), pa.array(c[:, 0]), pa.array(c[:, 1])], ["n", "a", "b"])

    return cut


def _draws(key: Column, seed: int) -> list[Column]:
    """The first four 8-digit groups of the hex sha256 of `seed:key`."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(h, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(docs: DataFrame, key: str = "doc_id", seed: int = 42, rate: int = 50, spm: int = 80, chunk: int = CHUNK) -> DataFrame:
    """docs with n (tokens), form (plain, psm, spm), prefix_chars, middle_chars and output. rate: percent that isn't plain; spm: percent of these."""
    text = F.coalesce(F.col("text"), F.lit(""))
    h = _draws(F.col(key), seed)
    marked = F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE))
    plain = (text == "") | marked | (h[2] % 100 >= rate)
    form = F.when(plain, "plain").when(h[3] % 100 < spm, "spm").otherwise("psm")
    cut = cuts(chunk)(text, h[0], h[1], ~plain)
    out = docs.select("*", form.alias("form"), cut.alias("_cut"))
    a, b, plain = F.col("_cut.a"), F.col("_cut.b"), F.col("form") == "plain"
    prefix, middle, suffix = F.substring(text, F.lit(1), a), F.substring(text, a + 1, b - a), F.substring(text, b + 1, F.length(text))
    psm, spm_ = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle), F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    return out.select(
        *docs.columns,
        F.col("_cut.n").alias("n"),
        "form",
        F.when(~plain, a).alias("prefix_chars"),
        F.when(~plain, b - a).alias("middle_chars"),
        F.when(plain, text).when(F.col("form") == "psm", psm).otherwise(spm_).alias("output"),
    )


def restored(output: Column, form: Column) -> Column:
    """The text from its output and form. Texts with markers are plain, and a marker begins with its only `<`, so the first of each kind is the real one."""
    whole = F.length(output)
    place = lambda m: F.instr(output, m)
    between = lambda a, b: F.substring(output, a + 3, b - a - 3)
    p, s, m = place(PREFIX), place(SUFFIX), place(MIDDLE)
    middle = F.substring(output, m + 3, whole)
    return F.when(form == "plain", output).when(form == "psm", F.concat(between(p, s), middle, between(s, m))).otherwise(F.concat(between(p, m), middle, between(s, p)))


def infill_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256 of every document."""
    out = fill_in_middle(docs.select("doc_id", "text"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


def cut_pieces(pieces: DataFrame, seed: int = 42) -> DataFrame:
    """doc_id, n and, for each cut, the piece that owns it and the code points of that piece before it. pieces: doc_id, piece (from 0), text, none of them empty.

    Each piece is counted where it is read. Windows over a document's pieces see three numbers a piece and no text: they mend the
    counts of words that go on in the next piece, and sum up. Of all pieces only the owners of a cut are fetched and scanned again.
    """
    space = r"[\x20\x09-\x0D]"
    w, whole = Window.partitionBy("doc_id").orderBy("piece"), Window.partitionBy("doc_id")
    counted = pieces.select("doc_id", "piece", F.regexp_count("text", F.lit(rf"[^\x20\x09-\x0D](?={space}|\z)")).alias("ends"), F.col("text").rlike(rf"\A{space}").alias("spaced"), F.col("text").rlike(rf"{space}\z").alias("open"))
    goes_on = ~F.col("open") & ~F.coalesce(F.lead("spaced").over(w), F.lit(True))
    sums = counted.withColumn("tokens", F.col("ends") - goes_on.cast("int")).withColumns({"upto": F.sum("tokens").over(w), "words": F.sum("tokens").over(whole), "last": F.col("piece") == F.max("piece").over(whole)})
    sums = sums.withColumn("n", F.col("words") + F.max((F.col("last") & F.col("open")).cast("int")).over(whole))
    h = _draws(F.col("doc_id"), seed)
    x, y = h[0] % (F.col("n") + 1), h[1] % (F.col("n") + 1)
    ranks = sums.withColumn("c", F.explode(F.array(F.struct(F.lit(1).alias("cut"), F.least(x, y).alias("rank")), F.struct(F.lit(2).alias("cut"), F.greatest(x, y).alias("rank")))))
    rank, inner = F.col("c.rank"), (F.col("c.rank") > F.col("upto") - F.col("tokens")) & (F.col("c.rank") <= F.col("upto"))
    owners = ranks.where(inner | ((rank == 0) & (F.col("piece") == 0)) | ((rank > F.col("words")) & F.col("last")))
    owners = owners.select("doc_id", "piece", "n", "c.cut", F.when(rank <= F.col("words"), rank - F.col("upto") + F.col("tokens")).alias("left"))

    def rescan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, bounds = _bytes_of(b.column("text"))
            chars = []
            for left, a, e in zip(b.column("left").to_pylist(), bounds[:-1], bounds[1:], strict=True):
                to = e if left is None else a if left <= 0 else _place(buf, a, e, e, left)
                chars.append(int(np.count_nonzero(_starts(buf[a:to]))))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n"), b.column("cut"), b.column("piece"), pa.array(chars, pa.int64())], ["doc_id", "n", "cut", "piece", "chars"])

    return owners.join(pieces.select("doc_id", "piece", "text"), ["doc_id", "piece"]).select("doc_id", "n", "cut", F.col("piece").cast("long").alias("piece"), "left", "text").mapInArrow(rescan, "doc_id long, n long, cut int, piece long, chars long")
