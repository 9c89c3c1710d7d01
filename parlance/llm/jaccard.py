"""Exact n-gram Jaccard linking with PartEnum signatures.

Texts with equal shingle sets are one node. Nodes are banded by set size so that two sets which may link
share an instance. An instance with at most k differing shingles hashes the shingle domain into k + 1 + spare
partitions; sets that link agree on at least 1 + spare of them, so equal partition contents (signatures) find
every link. Thresholds under about 0.77, whose partitions would hold fewer than two and a half shingles, use the second level
too: half the partitions, three parts each, and signatures of every two parts. Signatures of fewer than `least` shingles would be made of passages that many documents share.
They are left out, except by sets with more than `spare` such partitions: two sets that agree on nothing else both
have, so no link is lost.

Nodes that share a signature are candidates. Two rounds compare each with one pseudo-random hub per signature
(the closest by sketch is checked exactly) and merge what links. A last step takes every signature that
still holds several components, in blocks of bounded size, and compares the sketches of its members within the block; only
pairs of two components that a sketch can't reject leave it, and are compared on whole sets. A sketch (parities of hashed
shingles) bounds the symmetric difference from below. So every candidate pair between components is
examined, whatever the rounds before found, and the components are exact. Of a group only the pairs of different components that their sketches can't tell apart from links are listed.

Words, shingles and sets are known by 64-bit hashes (a chance of about 3e-20 for each pair of different ones).

Defined cases: null text and texts without words have no shingles, n_shingles 0 and link with nothing; a text of
fewer than k words is one shingle; repeated rows with one doc_id are one document; rows with a null doc_id link with nothing
(component_id null) and stay in one_of_each; empty tables give no rows; further columns are ignored. Ties: the smallest
doc_id names the component.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import connected_components, drop, join_hot, materialize
from parlance.llm.wordhash import chunks, mix, shingles, word_hashes

#: Members of a signature that are compared at once; larger signatures are cut into pairs of such blocks.
BLOCK = 4096
#: Bytes of the sketches of a block: very long texts make smaller blocks.
BLOCK_BYTES = 16 << 20
#: Ids up to which documents are picked or left out by a broadcast join (16 bytes each).
BROADCAST_NODES = 2_000_000


def _few(mean: float, least: int) -> float:
    """P(a Poisson number of shingles is under least)."""
    return float(np.exp(-mean) * sum(mean**i / (1, 1, 2)[i] for i in range(least)))


def _spare(base: int, low: int, part: float, ways: int, least: int) -> int | None:
    """Partitions beyond `base` so that a set of `low` shingles rarely has more weak ones; None if that takes too many."""
    for spare in range(1, base * 3 // 10 + 3):
        n = base + spare
        weak = n * min(1.0, ways * _few(part * low / n, least))
        if weak + 3 * weak**0.5 <= spare:
            return spare
    return None


@lru_cache(maxsize=64)
def bands(percent: int, most: int) -> list[tuple[int, int, int, int, int, bool]]:
    """(smallest size, largest size, partitions, spare, least, two levels) of each instance, for sets of up to `most` shingles.

    Instance j serves pairs whose smaller set is in band j; the larger one has at most size / threshold. With at most k
    differing shingles, k + 1 partitions have an equal one. On two levels each partition has three parts, and its
    signatures leave out one part each: k // 2 + 1 partitions have one with at most one differing part. Low
    thresholds, whose partitions would hold few shingles, take two levels. No partitions: only equal sets can link.
    """
    out, low = [], 1
    while low <= most:
        high = max(low, -(-low * 100 // percent) - 1)
        top = high * 100 // percent
        k = (100 - percent) * (high + top) // (100 + percent)
        two = k >= 4 and 2 * low < 5 * k
        base, part, ways = (k // 2 + 1, 2 / 3, 3) if two else (k + 1, 1.0, 1)
        tried = [(_spare(base, low, part, ways, least), least) for least in (2, 1)]
        spare, least = next((x for x in tried if x[0] is not None), (1, 1))
        out.append((low, top, base + spare if k else 0, spare, least, two))
        low = high + 1
    return out


@lru_cache(maxsize=8)
def _band_arrays(percent: int, most: int):
    b = bands(percent, most)
    return b, np.array([x[0] for x in b])


def signatures(s: np.ndarray, percent: int, most: int) -> np.ndarray:
    """The signatures of one sorted shingle set (uint64)."""
    b, lows = _band_arrays(percent, most)
    j = int(np.searchsorted(lows, len(s), side="right")) - 1
    out = []
    with np.errstate(over="ignore"):
        content = mix(s ^ np.uint64(0x5851F42D4C957F2D))
        for i in (j, j - 1):
            if i < 0 or not b[i][2] or len(s) > b[i][1]:
                continue
            _, _, n, spare, least, two = b[i]
            part = (((s >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int64)
            parts = 3 if two else 1
            cell = part * parts + (content % np.uint64(3)).astype(np.int64) if two else part
            total = np.zeros(n * parts, np.uint64)
            np.add.at(total, cell, content)
            size = np.bincount(cell, minlength=n * parts)
            if two:  # what is left without each part
                total, size = total.reshape(n, 3), size.reshape(n, 3)
                total, size = (total.sum(1, keepdims=True, dtype=np.uint64) - total).ravel(), (size.sum(1, keepdims=True) - size).ravel()
            strong = size >= least
            # with more weak partitions than spare ones, all are used
            use = np.arange(n * parts) if int((~strong.reshape(n, parts)).any(1).sum()) > spare else np.flatnonzero(strong)
            # 48 bits are enough for candidates (a chance agreement is compared and rejected) and a quarter less to shuffle
            out.append(mix(total[use] ^ mix(use.astype(np.uint64) + np.uint64((i + 1) << 32))) >> np.uint64(16))
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def sketch(s: np.ndarray) -> np.ndarray:
    """Parity of the number of shingles that hash to each bit; at least four bits a shingle."""
    bits = max(64, 1 << (4 * len(s) - 1).bit_length())
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _sets(docs: DataFrame, k: int, make, names: str, extra: list[str] | None = None) -> DataFrame:
    """Rows that make(key, sets) yields as Arrow columns, for runs of whole texts; key: column 0 of docs."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            ids, texts = b.column(0), b.column(1).cast(pa.binary()).to_pylist()
            for at, some in chunks(texts):
                h, bound = word_hashes(some)
                cols = make(ids.slice(at, len(some)), [shingles(h[bound[i] : bound[i + 1]], k) for i in range(len(some))])
                yield pa.RecordBatch.from_pydict(cols)

    return docs.mapInArrow(run, names)


def _node(s: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        return int(mix(mix(s).sum(dtype=np.uint64) + np.uint64(len(s))).astype(np.int64)) if len(s) else 0


def _document_rows(ids, sets):
    import pyarrow as pa

    return {"doc_id": ids, "n_shingles": pa.array([len(s) for s in sets], pa.int64()), "node": pa.array([_node(s) for s in sets], pa.int64())}


def _signature_rows(percent: int, most: int):
    seen: set[int] = set()

    def rows(ids, sets):
        import pyarrow as pa

        sig, node = [], []
        for s in sets:
            if not len(s) or (v := _node(s)) in seen:
                continue  # a copy met by this task adds nothing
            if len(seen) < 1_000_000:
                seen.add(v)
            x = signatures(s, percent, most)
            sig.append(x.view(np.int64))
            node.append(np.full(len(x), v, np.int64))
        cat = lambda x: pa.array(np.concatenate([np.empty(0, np.int64), *x]), pa.int64())
        return {"sig": cat(sig), "node": cat(node)}

    return rows


def _sketch_rows(ids, sets):
    import pyarrow as pa

    return {"node": ids, "n": pa.array([len(s) for s in sets], pa.int64()), "sketch": pa.array([sketch(s) if len(s) else np.empty(0, np.int64) for s in sets], pa.list_(pa.int64()))}


def _set_rows(ids, sets):
    import pyarrow as pa

    return {"node": ids, "n": pa.array([len(s) for s in sets], pa.int64()), "shingles": pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))}


def _small(ids: DataFrame) -> DataFrame:
    """ids (a table of a few longs a row), to be broadcast if they are counted to be few."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_NODES else ids


class _Texts:
    """One document's text for each node, found again whenever sets are needed; only sketches are kept."""

    def __init__(self, texts: DataFrame, first: DataFrame, k: int, once: bool):
        self.texts, self.first, self.k, self.once = texts, first, k, once

    def rows(self, nodes: DataFrame, make, kind: str) -> DataFrame:
        """make's rows for the distinct nodes, as a table."""
        wanted = materialize(nodes.distinct().join(self.first, "node").select(F.col("first").alias("doc_id"), "node"), "wanted")
        few = _small(wanted)
        chosen = self.texts.join(few, "doc_id")
        chosen = chosen if self.once else chosen.dropDuplicates(["doc_id"])
        return materialize(_sets(chosen.select("node", "text"), self.k, make, kind), "sets")


def _distance_bound(x: Column, y: Column) -> Column:
    """Set bits of the difference of two sketches, the larger folded to the smaller: at most the symmetric difference."""

    def fold(a: Column, b: Column) -> Column:
        n = F.size(b)
        more = F.sequence(F.lit(1), F.floor(F.size(a) / n).cast("int") - 1)
        folded = F.aggregate(more, F.slice(a, F.lit(1), n), lambda s, i: F.zip_with(s, F.slice(a, i * n + 1, n), lambda p, q: p.bitwiseXOR(q)))
        return F.when(F.size(a) <= n, a).otherwise(folded)

    return F.aggregate(F.zip_with(fold(x, y), fold(y, x), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda a, b: a + b)


def _near(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """pairs (a, b) that their sketches can't reject, with the bound."""
    s = sets.select("node", "n", "sketch")
    return (
        pairs.join(s.toDF("a", "na", "sa"), "a")
        .join(s.toDF("b", "nb", "sb"), "b")
        .withColumn("bound", _distance_bound(F.col("sa"), F.col("sb")))
        .where(((100 + percent) * F.col("bound") <= (100 - percent) * (F.col("na") + F.col("nb"))) & _sizes_fit(F.col("na"), F.col("nb"), percent))
        .select("a", "b", "bound")
    )


def _linked(pairs: DataFrame, texts: _Texts, percent: int) -> DataFrame:
    """pairs (a, b), a table, whose whole sets reach the threshold."""
    nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node")))
    s = texts.rows(nodes, _set_rows, "node long, n long, shingles array<long>")
    both = pairs.join(s.toDF("a", "na", "sa"), "a").join(s.toDF("b", "nb", "sb"), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    out = both.withColumn("common", common).where(100 * F.col("common") >= percent * (F.col("na") + F.col("nb") - F.col("common"))).select("a", "b")
    out = materialize(out, "links")
    drop(s)
    return out


def _folded(sketches: list[np.ndarray]) -> np.ndarray:
    """Sketches of one length: longer ones are folded to the shortest."""
    n = min(map(len, sketches))
    return np.stack([x if len(x) == n else np.bitwise_xor.reduce(x.reshape(-1, n)) for x in sketches]).view(np.uint64)


def _block_pairs(node, c, n, side, across: bool, sketches, percent: int):
    """Index pairs of one block (or of two, if across) in different components that sizes and sketches allow."""
    k, m = _folded(sketches), len(node)
    step = max(1, 4_000_000 // (m * k.shape[1]))
    for at in range(0, m, step):
        r = slice(at, at + step)
        d = np.bitwise_count(k[r, None, :] ^ k[None, :, :]).sum(2, dtype=np.int64)
        fits = (c[r, None] != c[None, :]) & ((100 + percent) * d <= (100 - percent) * (n[r, None] + n[None, :])) & (100 * np.minimum(n[r, None], n[None, :]) >= percent * np.maximum(n[r, None], n[None, :]))
        fits &= (side[r, None] < side[None, :]) if across else (np.arange(m)[r, None] < np.arange(m)[None, :])
        a, b = np.nonzero(fits)
        yield a + at, b


def _near_in_blocks(rest: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a, b) of rest (sig, node, c, blocks) that their sketches can't reject."""
    block = F.pmod(F.xxhash64("node"), F.col("blocks"))
    dealt = rest.select("sig", "node", "c", block.alias("mine"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("sig", "node", "c", "mine", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j")).join(sets.select("node", "n", "sketch"), "node")
    dealt = dealt.repartition("sig", "i", "j").sortWithinPartitions("sig", "i", "j").select("sig", "i", "j", "node", "c", "n", "mine", "sketch")

    def pairs(batches):
        import pyarrow as pa

        kept, seen = None, set()

        def compare(t):
            sig, i, j, node, c, n, side = (t.column(x).to_numpy() for x in range(7))
            values, offsets = t.column(7).combine_chunks().flatten().to_numpy(), t.column(7).combine_chunks().offsets.to_numpy()
            offsets = offsets - offsets[0]
            first = np.flatnonzero(np.append(True, (sig[1:] != sig[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])))
            new = []
            for lo, hi in zip(first, [*first[1:], len(sig)], strict=True):
                g = slice(lo, hi)
                if (c[g] == c[lo]).all():
                    continue
                sketches = [values[offsets[x] : offsets[x + 1]] for x in range(lo, hi)]
                for a, b in _block_pairs(node[g], c[g], n[g], side[g], i[lo] != j[lo], sketches, percent):
                    for x, y in zip(node[g][a].tolist(), node[g][b].tolist(), strict=True):
                        p = (x, y) if x < y else (y, x)
                        if p not in seen:
                            if len(seen) < 1_000_000:
                                seen.add(p)
                            new.append(p)
            return pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in new], pa.int64()), "b": pa.array([y for _, y in new], pa.int64())})

        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if kept is None else pa.concat_tables([kept, t])
            if not len(t):
                continue
            sig, i, j = (t.column(x).to_numpy() for x in range(3))
            last = np.flatnonzero((sig != sig[-1]) | (i != i[-1]) | (j != j[-1]))
            cut = int(last[-1]) + 1 if len(last) else 0  # the last group may go on in the next batch
            if cut:
                yield compare(t.slice(0, cut))
            kept = t.slice(cut)
        if kept is not None and len(kept):
            yield compare(kept)

    return dealt.mapInArrow(pairs, "a long, b long").distinct()


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, node, component_id; documents link when 100 * |A and B| >= percent * |A or B|."""
    members = materialize(_sets(docs.select("doc_id", "text"), k, _document_rows, "doc_id long, n_shingles long, node long"), "members")
    texts = docs.select("doc_id", "text").where("doc_id is not null")
    most = members.agg(F.max("n_shingles")).first()[0] or 1
    most = 1 << int(most).bit_length()
    nodes = members.where("n_shingles > 0 and doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("first"))
    # one shuffle of the signatures, read twice: for those of several nodes, and for their members
    sigs = _sets(texts, k, _signature_rows(percent, most), "sig long, node long").repartition("sig")
    shared = sigs.groupBy("sig").agg(F.min("node").alias("x"), F.max("node").alias("y")).where("x <> y").select("sig")
    bucket = materialize(sigs.join(shared.hint("shuffle_hash"), "sig").distinct(), "buckets")
    again = _Texts(texts, nodes, k, not _repeats(members))
    sketches = again.rows(bucket.select("node"), _sketch_rows, "node long, n long, sketch array<long>")

    edges = None
    component = None  # node, component of nodes that have links so far
    for turn in range(2):
        now = _with_component(bucket, component)
        order = F.xxhash64(F.lit(turn), "sig", "node")  # another hub for each signature, so a node meets many
        hub = now.groupBy("sig").agg(F.min_by(F.struct("node", "c"), order).alias("hub"), F.min("c").alias("x"), F.max("c").alias("y")).where("x <> y")
        pairs = now.join(hub, "sig").where(F.col("c") != F.col("hub.c"))
        near = _near(pairs.select(F.col("node").alias("a"), F.col("hub.node").alias("b")).distinct(), sketches, percent)
        best = materialize(near.groupBy("a").agg(F.min_by("b", F.struct("bound", "b")).alias("b")), "best")
        found = _linked(best, again, percent)
        edges, component = _merge(edges, found, component)
        drop(best)

    open_ = materialize(_with_component(bucket, component), "open")
    size = sketches.select("node", (8 * F.size("sketch")).alias("bytes"))
    mixed = open_.groupBy("sig").agg(F.min("c").alias("x"), F.max("c").alias("y")).where("x <> y").select("sig")
    rest = materialize(open_.join(mixed, "sig").join(size, "node"), "rest")
    blocks = rest.groupBy("sig").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("bytes") / BLOCK_BYTES)).alias("blocks"))
    near = materialize(_near_in_blocks(rest.join(blocks, "sig"), sketches, percent), "near")
    _, component = _merge(edges, _linked(near, again, percent), component)
    for used in (bucket, sketches, open_, rest, near):
        drop(used)

    # one component, or the copies of one text, may hold a third of all rows
    linked = materialize(component.join(nodes, "node"), "linked")
    named = join_hot(linked, linked.groupBy("component").agg(F.min("first").alias("component_id")), "component", "node").select("node", "component_id")
    named = nodes.join(named, "node", "left").select("node", F.coalesce("component_id", "first").alias("component_id"))
    whole = join_hot(members, named, "node", "doc_id", "left")
    linkable = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    return whole.select("doc_id", "n_shingles", F.when(linkable, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "node")


def _repeats(members: DataFrame) -> bool:
    return not members.groupBy("doc_id").count().where("count > 1").isEmpty()


def _sizes_fit(a: Column, b: Column, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _with_component(bucket: DataFrame, component: DataFrame | None) -> DataFrame:
    if component is None:
        return bucket.withColumn("c", F.col("node"))
    return bucket.join(component, "node", "left").withColumn("c", F.coalesce("component", "node")).drop("component")


def _merge(edges: DataFrame | None, found: DataFrame, component: DataFrame | None):
    """All edges so far and the components they make; the earlier components stand in for earlier edges."""
    if found.isEmpty() and component is not None:
        return edges, component
    # earlier members hang on their component's smallest node
    known = found if component is None else found.unionByName(component.select(F.col("node").alias("a"), F.col("component").alias("b")))
    return known, connected_components(known)


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The documents of the smallest doc_id in each component, and those with a null doc_id.

    The ids of the others are counted; while they are few, texts aren't shuffled to leave them out.
    """
    gone = materialize(jaccard_components(docs, k, percent).where("doc_id <> component_id").select("doc_id").distinct(), "copies")
    return docs.join(_small(gone), "doc_id", "left_anti").select(docs.columns)
