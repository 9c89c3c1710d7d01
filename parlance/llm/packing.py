"""Best-fit packing of token sequences by exact-complement hashing.

Only lengths matter to a packing, so the plan is made from the number of pieces of each length (at most
`capacity` counts, whatever the corpus). Bins are opened with the longest length left. Its gap is looked up in
hash indexes of single, pair and triple sums: a combination of available lengths that fills the gap exactly is
consumed as often as the counts allow, all at once. Where no such combination exists, the longest length that
fits is taken (best fit) and the remaining gap is looked up again. Every step uses up some length, so the plan
has a few thousand patterns at most, each with a multiplicity.

Pieces find their place by their rank within their length. Ranks come from counts per (length, salt) and a
row number inside each (length, salt), so a length shared by a third of all rows is spread over the salts.

Defined cases: null text is an empty document (one piece: the end token); an empty table gives no rows; repeated
rows are packed each; ties in length are broken by doc_id and piece, and equal rows among themselves by any
order; a text longer than the capacity is cut into full pieces but for its first; the text of a special token in a document is that token, as
`tokenizers` has it; a null doc_id is packed like any other; further columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlance.llm.common import materialize

CAPACITY = 2048
END_ID = 0
SALTS, MOST_SALTS, ROWS_PER_SALT = 64, 1024, 1_000_000
_ENCODERS: dict[int, Encoder] = {}
_BYTES: dict[str, int] = {}


def _bytes_of(token: str) -> bytes:
    """The bytes that a token of a byte-level vocabulary stands for: printable Latin-1 is itself, the others follow from 256 on."""
    if not _BYTES:
        own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        _BYTES.update({chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in own)})
    return bytes(_BYTES[c] for c in token)


class Encoder:
    """Token ids of a `tokenizers` JSON file (byte-level BPE), add_special_tokens=False.

    Most texts are encoded from the same vocabulary and split pattern by a faster library. Texts that hold an added token, or a run of
    white space so long that its backtracking would overflow, go to `tokenizers` itself; so ids are equal for every text.
    """

    def __init__(self, spec: str, pattern: str):
        import tiktoken
        from tokenizers import Tokenizer

        found = json.loads(spec)
        self.slow = Tokenizer.from_str(spec)
        ranks = {_bytes_of(t): i for t, i in found["model"]["vocab"].items()}
        self.fast = tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.odd = re.compile("|".join([*(re.escape(t["content"]) for t in found.get("added_tokens") or []), r"\s{1000}"]))

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if self.odd.search(text):
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()


def encoder(spec: str, pattern: str) -> Encoder:
    """Kept for the life of the Python worker."""
    key = hash((spec, pattern))
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(spec, pattern)
    return _ENCODERS[key]


def pieces_of(ids: bytes, capacity: int, end_id: int) -> Iterator[tuple[int, int, int, int]]:
    """(piece, start, length, crc32) of a document's ids and its end token."""
    ids += int(end_id).to_bytes(4, "little")
    n = len(ids) // 4
    first = (n - 1) % capacity + 1
    start, piece = 0, 0
    while start < n:
        length = first if not piece else capacity
        yield piece, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])
        start, piece = start + length, piece + 1


def token_pieces(docs: DataFrame, vocabulary: str, pattern: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: one row per piece of at most `capacity` tokens.

    vocabulary: path of the `tokenizers` JSON file. The driver reads it (a few MB) and broadcasts it; executors need no such file.
    """
    with open(vocabulary, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())

    def cut(batches):
        import pyarrow as pa

        encode = encoder(spec.value, pattern).ids
        for b in batches:
            ids, texts = b.column(0), b.column(1)
            for at in range(0, b.num_rows, 500):
                encoded = (encode(t) for t in texts.slice(at, 500).to_pylist())
                rows = [(i, *p) for i, e in zip(ids.slice(at, 500).to_pylist(), encoded, strict=True) for p in pieces_of(e, capacity, end_id)]
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (ids.type, pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def plan_patterns(counts: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """(multiplicity, lengths) of every pattern: all pieces are used exactly once."""
    have = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        have[length] = n
    lengths = sorted((k for k, n in counts.items() if n), reverse=True)

    def free(used: list[int], x: int) -> bool:
        return have[x] > used.count(x)

    def pair(gap: int, used: list[int]) -> list[int] | None:
        # sums of two: a and gap - a, the larger first
        a = np.arange(gap - 1, (gap - 1) // 2, -1) if gap > 1 else np.empty(0, np.int64)
        for x in a[(have[a] > 0) & (have[gap - a] > 0)]:
            got = [int(x), int(gap - x)]
            if all(have[y] >= used.count(y) + got.count(y) for y in got):
                return got
        return None

    def triple(gap: int, used: list[int]) -> list[int] | None:
        for x in np.flatnonzero(have[1:gap] > 0)[::-1] + 1 if gap > 2 else []:
            if 3 * x < gap:
                return None
            if free(used, int(x)) and (rest := pair(gap - int(x), [*used, int(x)])) and rest[0] <= x:
                return [int(x), *rest]
        return None

    plan = []
    for top in lengths:
        while have[top] > 0:
            bin_, gap = [top], capacity - top
            while gap > 0:
                if have[gap] > 0 and free(bin_, gap):
                    got = [gap]
                else:
                    got = pair(gap, bin_) or triple(gap, bin_)
                if got is None:
                    fits = [x for x in (np.flatnonzero(have[1:gap] > 0) + 1)[::-1] if free(bin_, int(x))] if gap > 1 else []
                    if not fits:
                        break
                    got = [int(fits[0])]
                bin_ += got
                gap -= sum(got)
            times = int(min(have[x] // bin_.count(x) for x in set(bin_)))
            for x in bin_:
                have[x] -= times
            plan.append((times, bin_))
    return plan


def slots_of(plan: list[tuple[int, list[int]]]) -> list[tuple[int, int, int, int]]:
    """(length, first rank, first sequence_id, offset): from that rank on, pieces of the length go to successive sequences."""
    taken: dict[int, int] = {}
    slots, sequence = [], 0
    for times, lengths in plan:
        offset = 0
        for x in lengths:
            slots.append((x, taken.get(x, 0), sequence, offset))
            taken[x] = taken.get(x, 0) + times
            offset += x
        sequence += times
    return slots


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The pieces (doc_id, piece, length and more; no names that begin with _) with sequence_id and offset. pieces must be cheap to read twice."""
    spark = pieces.sparkSession
    # more salts for more pieces, so that the row numbers of a common length stay small tasks
    salts = min(MOST_SALTS, max(SALTS, pieces.count() // ROWS_PER_SALT))
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    by_salt = materialize(salted.groupBy("length", "_salt").agg(F.count("*").alias("n")), "lengths")  # at most capacity x MOST_SALTS rows
    before = by_salt.select("length", "_salt", (F.sum("n").over(Window.partitionBy("length").orderBy("_salt")) - F.col("n")).alias("_before"))
    counts = {r["length"]: r["n"] for r in by_salt.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    slots = slots_of(plan_patterns(counts, capacity))
    table = spark.createDataFrame(slots, "length long, rank long, first_sequence long, offset long")
    # the slots of a length as one sorted array: at most a few thousand structs in all
    table = table.groupBy("length").agg(F.array_sort(F.collect_list(F.struct("rank", "first_sequence", "offset"))).alias("_slots"))
    ranked = (
        salted.join(F.broadcast(before), ["length", "_salt"])
        .withColumn("_rank", F.col("_before") + F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "piece")) - 1)
        .join(F.broadcast(table), "length")
        .withColumn("_slot", F.element_at(F.filter("_slots", lambda s: s["rank"] <= F.col("_rank")), -1))
    )
    place = (F.col("_slot.first_sequence") + F.col("_rank") - F.col("_slot.rank")).alias("sequence_id")
    return ranked.select(*pieces.columns, place, F.col("_slot.offset").alias("offset"))


def pack_documents(docs: DataFrame, vocabulary: str, pattern: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Tokenize whole documents, cut those over the capacity, and pack all pieces."""
    return pack(materialize(token_pieces(docs, vocabulary, pattern, capacity, end_id), "pieces"), capacity)
