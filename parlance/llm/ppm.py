"""Language-model scores by prediction by partial matching (PPM), with an add-one unigram base beside it.

The model is a trie of byte contexts up to three bytes (a text starts after three pad bytes and closes with
an end symbol; both are bytes that UTF-8 never uses). Escape estimation is method C: a context with T
occurrences and D distinct symbols escapes with D / (T + D). After an escape, the symbols of the longer
context are excluded from the shorter one's counts. Below order zero the symbols not yet seen are equally likely.

Training counts byte four-grams and words in one distributed pass (pre-aggregated per task, then summed by key). Four-gram counts
determine the whole trie. Its orders up to two are broadcast; a byte alphabet bounds them (2^24 entries; a few hundred thousand in text). Of order
three the commonest contexts are broadcast, up to `head_grams` entries. Word counts grow with the corpus: the `head` most frequent are
broadcast. What a task finds in neither head (words; contexts of order three) leaves it by key, once a document with its number of times,
and is joined with the full counts. So both heads are of fixed size, nothing is left out, and no result depends on where a head ends.

Defined cases: null text is empty: one end token; with no training rows N and V are 0 and every byte is
equally likely; repeated rows are scored each (and trained on each); empty tables give no rows; further columns are
ignored; ties at a head's edge are broken by key and don't change results; a null doc_id is scored and (where its fold is null) learned from.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import materialize
from parlance.llm.wordhash import chunks, word_hashes

PAD, END = 0xFF, 0xFE
#: The symbols that can be coded: all bytes but the pad.
ALPHABET = 255
#: Key of the end token among word hashes.
END_WORD = np.int64(-1)
HEAD = 1 << 17
#: Entries of a task's counts after which they are handed on.
FLUSH = 2_000_000
#: Entries of the order-three contexts that are broadcast (12 bytes each).
HEAD_GRAMS = 1 << 20


def fold_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(modulus))


def framed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the texts, each after three pads and before an end, and the bounds of the texts' symbols to code."""
    buf = np.frombuffer(b"".join(b"\xff\xff\xff" + t + b"\xfe" for t in texts), np.uint8)
    ends = np.cumsum([len(t) + 4 for t in texts])
    return buf, ends


def four_grams(buf: np.ndarray) -> np.ndarray:
    """Context and symbol of every coded position."""
    b = buf.astype(np.uint32)
    keys = (b[:-3] << 24) | (b[1:-2] << 16) | (b[2:-1] << 8) | b[3:]
    return keys[buf[3:] != PAD]


class Counter:
    """Counts by key, merged array by array; yields them when they grow beyond FLUSH entries."""

    def __init__(self):
        self.keys, self.n, self.pending = np.empty(0, np.int64), np.empty(0, np.int64), []

    def add(self, keys: np.ndarray) -> None:
        if len(keys):
            self.pending.append(np.unique(keys, return_counts=True))
            if sum(len(k) for k, _ in self.pending) > max(500_000, len(self.keys)):
                self.merge()

    def merge(self) -> None:
        keys = np.concatenate([self.keys, *[k.view(np.int64) if k.dtype == np.uint64 else k.astype(np.int64) for k, _ in self.pending]])
        n = np.concatenate([self.n, *[n for _, n in self.pending]])
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], n[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
        self.keys, self.n = keys[first], np.add.reduceat(n, first) if len(first) else n
        self.pending = []

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        self.merge()
        out = self.keys, self.n
        self.keys, self.n = np.empty(0, np.int64), np.empty(0, np.int64)
        return out


def corpus_counts(training: DataFrame) -> DataFrame:
    """kind (0 word, 1 four-gram), key, n over all rows of training (text)."""

    def count(batches):
        import pyarrow as pa

        words, grams = Counter(), Counter()

        def rows(kind: int, c: Counter):
            keys, n = c.take()
            for at in range(0, len(keys), 100_000):
                k = keys[at : at + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int32)), pa.array(k), pa.array(n[at : at + 100_000])], names=["kind", "key", "n"])

        for b in batches:
            for _, some in chunks(b.column(0).cast(pa.binary()).to_pylist()):
                h, _ = word_hashes(some)
                words.add(h)
                words.add(np.full(len(some), END_WORD))
                grams.add(four_grams(framed(some)[0]))
                if len(words.keys) > FLUSH:
                    yield from rows(0, words)
                if len(grams.keys) > FLUSH:
                    yield from rows(1, grams)
        yield from rows(0, words)
        yield from rows(1, grams)

    return training.select("text").mapInArrow(count, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


@dataclass
class _Order:
    """Contexts of one order, sorted: totals, distinct symbols, and the next shorter order's denominator after exclusion."""

    keys: np.ndarray
    n: np.ndarray
    contexts: np.ndarray
    total: np.ndarray
    distinct: np.ndarray
    after: np.ndarray | None = None


def _after(short: _Order, j: int, keys: np.ndarray, contexts: np.ndarray, distinct: np.ndarray) -> np.ndarray:
    """Denominators of the contexts' suffixes once the symbols of `contexts` (order j, entries `keys`, sorted) are excluded."""
    mask = (1 << (8 * (j - 1))) - 1
    shared = short.n[np.searchsorted(short.keys, keys & ((mask << 8) | 0xFF))]
    used = np.bincount(np.searchsorted(contexts, keys >> 8), weights=shared, minlength=len(contexts))
    at = np.searchsorted(short.contexts, contexts & mask)
    return short.total[at] + short.distinct[at] - used - distinct


class Lower:
    """Orders two to zero of the static PPM model, from three-gram counts."""

    def __init__(self, keys: np.ndarray, n: np.ndarray):
        order = np.argsort(keys)
        keys, n = keys[order].astype(np.int64), n[order].astype(np.float64)
        self.orders: list[_Order] = []  # order 2 first
        for j in (2, 1, 0):
            if j < 2:
                keys, back = np.unique(keys & ((1 << (8 * (j + 1))) - 1), return_inverse=True)
                n = np.bincount(back, weights=n, minlength=len(keys))
            context = keys >> 8
            first = np.flatnonzero(np.append(True, context[1:] != context[:-1])) if len(keys) else np.empty(0, np.int64)
            total = np.add.reduceat(n, first) if len(first) else np.empty(0)
            self.orders.append(_Order(keys, n, context[first], total, np.diff(np.append(first, len(keys))).astype(np.float64)))
        for j, long, short in zip((2, 1), self.orders, self.orders[1:], strict=False):
            if len(long.keys):
                long.after = _after(short, j, long.keys, long.contexts, long.distinct)

    def code(self, keys: np.ndarray, denominator: np.ndarray, gone: np.ndarray) -> np.ndarray:
        """log10 probability of the last byte of each key after its context of two and shorter ones.

        denominator: of order two once the symbols of a longer context are excluded, nan if there are none; gone: how many symbols those are.
        """
        out = np.zeros(len(keys))
        open_ = np.arange(len(keys))
        for j, o in zip((2, 1, 0), self.orders, strict=True):
            if not len(open_) or not len(o.contexts):
                continue
            key = keys[open_] & ((1 << (8 * (j + 1))) - 1)
            at = np.minimum(np.searchsorted(o.contexts, key >> 8), len(o.contexts) - 1)
            known = o.contexts[at] == key >> 8
            whole = np.where(np.isnan(denominator), o.total[at] + o.distinct[at], denominator)
            i = np.minimum(np.searchsorted(o.keys, key), len(o.keys) - 1)
            hit = known & (o.keys[i] == key)
            out[open_[hit]] += np.log10(o.n[i[hit]] / whole[hit])
            new = o.distinct[at] - gone
            leaves = known & ~hit & (whole > 0)  # a context whose symbols are all excluded costs nothing
            out[open_[leaves]] += np.log10(new[leaves] / whole[leaves])
            stay = ~hit
            denominator = np.where(known, o.after[at] if o.after is not None else np.nan, np.nan)[stay]
            gone = np.where(known, o.distinct[at], 0.0)[stay]
            open_ = open_[stay]
        seen = self.orders[2].distinct[0] if len(self.orders[2].distinct) else 0
        out[open_] -= np.log10(ALPHABET - seen)
        return out


class Top:
    """Contexts of three bytes, from all their four-gram counts: which symbols each has, as a bit set, and where its entries begin."""

    def __init__(self, lower: Lower, keys: np.ndarray, n: np.ndarray):
        order = np.argsort(keys)
        keys, n = keys[order].astype(np.int64), n[order].astype(np.float64)
        contexts, first, size = np.unique(keys >> 8, return_index=True, return_counts=True)
        self.lower, m = lower, len(contexts)
        total = np.add.reduceat(n, first) if m else np.empty(0)
        self.distinct = np.append(0.0, size)  # index 0: no such context
        self.after = np.append(np.nan, _after(lower.orders[0], 3, keys, contexts, self.distinct[1:]) if m else [])
        at = np.repeat(np.arange(1, m + 1), size)
        self.hit = np.log10(n / (total[at - 1] + size[at - 1])) if m else np.empty(0)
        self.escape = np.append(0.0, np.log10(size / (total + size)))
        symbol, word = keys & 0xFF, (keys & 0xFF) >> 6
        self.bits = np.zeros((m + 1, 4), np.uint64)
        np.bitwise_or.at(self.bits, (at, word), np.uint64(1) << (symbol & 63).astype(np.uint64))
        before = np.cumsum(np.bitwise_count(self.bits), axis=1, dtype=np.int64)
        self.begin = (np.append(0, first)[:, None] + np.concatenate([np.zeros((m + 1, 1), np.int64), before[:, :3]], axis=1)).astype(np.int32)
        # from a context to its number, by its first two bytes and its third
        pairs, pair_at = np.unique(contexts >> 8, return_inverse=True)
        self.two = np.zeros(1 << 16, np.int32)
        self.two[pairs] = np.arange(1, len(pairs) + 1)
        self.three = np.zeros((len(pairs) + 1, 256), np.int32)
        self.three[pair_at + 1, contexts & 0xFF] = np.arange(1, m + 1)

    def code(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log10 probability of each four-gram's last byte after the others, whether its context is here); others are coded from order two."""
        context = self.three[self.two[keys >> 16], (keys >> 8) & 0xFF]
        word, place = (keys >> 6) & 3, (keys & 63).astype(np.uint64)
        bits = self.bits[context, word]
        hit = (bits >> place) & np.uint64(1) == 1
        out = np.zeros(len(keys))
        entry = self.begin[context, word] + np.bitwise_count(bits & ((np.uint64(1) << place) - np.uint64(1)))
        out[hit] = self.hit[entry[hit]]
        miss = np.flatnonzero(~hit)
        c = context[miss]
        out[miss] = self.escape[c] + self.lower.code(keys[miss] & 0xFFFFFF, self.after[c], self.distinct[c])
        return out, context > 0


def _lower(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Three-gram counts: at most 2^24 rows."""
    t = counts.where("kind = 1").groupBy(F.expr("key & 16777215").alias("key")).agg(F.sum("n").alias("n")).toPandas()
    return t["key"].to_numpy(), t["n"].to_numpy()


def _contexts(counts: DataFrame) -> DataFrame:
    """context, total, entries (key, n; at most 255): the order-three contexts."""
    grams = counts.where("kind = 1").groupBy(F.expr("key >> 8").alias("context"))
    return materialize(grams.agg(F.sum("n").alias("total"), F.collect_list(F.struct("key", "n")).alias("entries")), "contexts")


def _head(contexts: DataFrame, most: int) -> tuple[pd.DataFrame, DataFrame]:
    """(entries of the commonest contexts, at most `most` in all; the other contexts)."""
    top = contexts.select("context", "total", F.size("entries").alias("n")).orderBy(F.desc("total"), "context").limit(most).toPandas()
    some = top[np.cumsum(top["n"].to_numpy()) <= most]
    if not len(some):
        return pd.DataFrame({"key": np.empty(0, np.int64), "n": np.empty(0, np.int64)}), contexts
    total, context = int(some["total"].iloc[-1]), int(some["context"].iloc[-1])
    inside = (F.col("total") > total) | ((F.col("total") == total) & (F.col("context") <= context))
    return contexts.where(inside).select(F.inline("entries")).toPandas(), contexts.where(~inside)


def _once(doc: np.ndarray, key: np.ndarray, m: int):
    """(Arrow list a document of structs key, times) for keys sorted into documents."""
    import pyarrow as pa

    by = np.lexsort((key, doc))
    doc, key = doc[by], key[by]
    first = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (key[1:] != key[:-1]))) if len(key) else np.empty(0, np.int64)
    times = np.diff(np.append(first, len(key)))
    offsets = np.searchsorted(doc[first], np.arange(m + 1))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(key[first], pa.int64()), pa.array(times, pa.int64())], names=["key", "times"]))


def _tail_codes(scored: DataFrame, tail: DataFrame, lower) -> DataFrame:
    """key, code: log10 probabilities of the distinct four-grams whose contexts aren't in the head; lower: broadcast three-gram counts."""
    asked = scored.select(F.explode("grams.key").alias("key")).distinct().withColumn("context", F.expr("key >> 8"))

    def code(batches):
        model = Lower(*lower.value)
        for b in batches:
            known = b["entries"].map(lambda e: e is not None and len(e) > 0).to_numpy(bool)
            keys = b["key"].to_numpy()
            out = np.zeros(len(b))
            out[~known] = model.code(keys[~known] & 0xFFFFFF, np.full((~known).sum(), np.nan), np.zeros((~known).sum()))
            entries = {e[0]["key"] >> 8: e for e in b["entries"][known]}
            if entries:
                grams = [x for e in entries.values() for x in e]
                out[known] = Top(model, np.array([x["key"] for x in grams]), np.array([x["n"] for x in grams])).code(keys[known])[0]
            yield pd.DataFrame({"key": keys, "code": out})

    return asked.join(tail, "context", "left").select("key", "entries").mapInPandas(code, "key long, code double")


def score_documents(docs: DataFrame, held_out: Column, head: int = HEAD, head_grams: int = HEAD_GRAMS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. Rows with held_out are not learned from."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    counts = materialize(corpus_counts(rows.where("not held_out")), "counts")
    words = counts.where("kind = 0").select("key", "n")
    total, distinct, end_n = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.coalesce(F.sum(F.when(F.col("key") == int(END_WORD), F.col("n"))), F.lit(0))).first()
    common = words.orderBy(F.desc("n"), "key").limit(head).toPandas()  # a fixed number of rows
    grams, tail = _head(_contexts(counts), head_grams)
    order = np.argsort(common["key"].to_numpy())
    model = spark.sparkContext.broadcast((common["key"].to_numpy()[order], common["n"].to_numpy()[order], grams["key"].to_numpy(), grams["n"].to_numpy()))
    lower = spark.sparkContext.broadcast(_lower(counts))
    log_of = lambda c: np.log10((c + 1.0) / (total + distinct + 1.0))

    def score(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        keys, n, gram_keys, gram_n = model.value
        top = Top(Lower(*lower.value), gram_keys, gram_n)
        at_row = TaskContext.get().partitionId() << 40
        for b in batches:
            for at, some in chunks(b.column(1).cast(pa.binary()).to_pylist()):
                m = len(some)
                h, bound = word_hashes(some)
                h = h.view(np.int64)
                i = np.minimum(np.searchsorted(keys, h), max(0, len(keys) - 1))
                known = keys[i] == h if len(keys) else np.zeros(len(h), bool)
                doc = np.repeat(np.arange(m), np.diff(bound))
                base = np.bincount(doc[known], weights=log_of(n[i[known]]), minlength=m) + log_of(end_n)
                n_known = np.bincount(doc[known], minlength=m) + (end_n > 0)
                buf, ends = framed(some)
                coded = np.flatnonzero(buf[3:] != PAD)
                grams_of = np.searchsorted(ends - 3, coded, side="right")
                key = four_grams(buf).astype(np.int64)
                p, here = top.code(key)
                score = np.bincount(grams_of[here], weights=p[here], minlength=m).astype(float)
                cols = [pa.array(np.arange(at_row, at_row + m)), b.column(0).slice(at, m), b.column(2).slice(at, m), pa.array(np.diff(bound) + 1), pa.array(n_known.astype(np.int64)), pa.array(base), pa.array(score), _once(doc[~known], h[~known], m), _once(grams_of[~here], key[~here], m)]
                at_row += m
                yield pa.RecordBatch.from_arrays(cols, names=["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "words", "grams"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    pairs = "array<struct<key:long,times:long>>"
    scored = materialize(rows.select("doc_id", "text", "held_out").mapInArrow(score, f"row long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base double, score double, words {pairs}, grams {pairs}"), "scored")
    rest = scored.select("row", F.inline("words")).join(words, "key", "left")
    c = F.coalesce(F.col("n"), F.lit(0))
    rest = rest.groupBy("row").agg(
        F.sum(F.col("times") * F.log10((c + 1) / F.lit(float(total + distinct + 1)))).alias("more"),
        F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("more_known"),
    )
    codes = _tail_codes(scored, tail, lower)
    deep = scored.select("row", F.inline("grams")).join(codes, "key").groupBy("row").agg(F.sum(F.col("times") * F.col("code")).alias("deep"))
    return scored.join(rest, "row", "left").join(deep, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("deep", F.lit(0.0))).alias("score"),
    )
