"""Near-duplicate embeddings by product quantisation: inverted lists, residual codes, table distances, exact rerank.

Equal vectors of one label are one class with a multiplicity, so groups of copies cost one vector. Coarse lists
and codebooks are fitted on at most `sample_rows` classes (the smallest by hash; a documented bound); every class
is indexed. A class is a member of its nearest list and queries every list whose border lies within `reach` of it
(half of the largest distance that a link allows: the border distances of a linked pair add up to at most its distance, so one of the two asks the
other's list, and no link is lost). Members are coded as residuals by subspace;
a query's table of subspace distances gives its distance to each code. That distance exceeds the true one by at most the member's
own coding error, which is kept, so the cut on it loses nothing; what passes is compared exactly in double precision.

Lists are worked through in blocks of members and queries, so no task holds a whole list, however many vectors it has. A block returns per class
the number of links and a root within the block, never pairs. The number of blocks of a list comes to its vectors by a broadcast of counted size.

Defined cases: vectors that are null, zero, or hold null or non-finite components, and those with a null
label, link with nothing (n_links 0, own component); vectors of different length never link (each of the `MOST_LENGTHS` commonest lengths has its
own lists; the vectors of another length are one list, which is compared without codes); repeated vec_ids are vectors of their own, but name one node, so what links to
one of them has the component of all; empty tables give no rows; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import connected_components, join_hot, materialize

SAMPLE_ROWS = 20_000
PER_LIST = 300
MOST_LISTS = 4096
SUBSPACES = 16
CODES = 256
MEMBERS, QUERIES = 1024, 2048
#: Vector lengths that have lists and codebooks of their own.
MOST_LENGTHS = 32
#: Lists whose numbers of blocks are broadcast (40 bytes each).
BROADCAST_LISTS = 1_000_000


def kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 8) -> np.ndarray:
    """Centres by Lloyd's rounds from a seeded draw of rows; empty ones stay where they were."""
    centres = x[np.random.default_rng(seed).permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = np.argmax(x @ centres.T - 0.5 * (centres**2).sum(1), axis=1)
        n = np.bincount(near, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        centres[n > 0] = total[n > 0] / n[n > 0, None]
    return centres


def fit(sample: np.ndarray, lists: int) -> tuple[np.ndarray, list[tuple[int, int]], list[np.ndarray]]:
    """(list centres, subspace bounds, codebooks of residuals) of unit vectors."""
    centres = kmeans(sample, min(lists, len(sample)), 1)
    residual = sample - centres[np.argmax(sample @ centres.T - 0.5 * (centres**2).sum(1), axis=1)]
    cuts = np.linspace(0, sample.shape[1], min(SUBSPACES, sample.shape[1]) + 1).astype(int)
    bounds = list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
    return centres, bounds, [kmeans(residual[:, a:b], min(CODES, len(sample)), 2 + a) for a, b in bounds]


def one_list(dim: int):
    """The model of a rare length: one list and codes that say nothing, so that all is compared exactly."""
    return np.zeros((1, dim)), [(0, dim)], [np.zeros((1, dim))]


def encode(x: np.ndarray, model, reach: float):
    """(list, probed lists, codes, coding error) of each unit vector."""
    centres, bounds, books = model
    size = (centres**2).sum(1)
    square = 1 - 2 * (x @ centres.T) + size
    own = np.argmin(square, axis=1)
    probes: list = [None] * len(x)
    for o in np.unique(own):
        d = np.sqrt(np.maximum(size + size[o] - 2 * (centres @ centres[o]), 1e-12))
        mine = np.flatnonzero(own == o)
        # how far each vector is from the border between its own list and every other
        for i, near in zip(mine, square[mine] - square[mine, o][:, None] <= 2 * reach * d + 1e-9, strict=True):
            probes[i] = np.flatnonzero(near)
    r = x - centres[own]
    codes = np.stack([np.argmax(r[:, a:b] @ c.T - 0.5 * (c**2).sum(1), axis=1) for (a, b), c in zip(bounds, books, strict=True)], axis=1)
    error = np.sqrt(sum(((r[:, a:b] - c[codes[:, s]]) ** 2).sum(1) for s, ((a, b), c) in enumerate(zip(bounds, books, strict=True))))
    return own, probes, codes.astype(np.uint8), error


def table_distances(queries: np.ndarray, codes: np.ndarray, centre: np.ndarray, bounds, books) -> np.ndarray:
    """Squared distance of each query to each coded member of one list, by table lookup."""
    r = queries - centre
    out = np.zeros((len(r), len(codes)), np.float32)
    for s, ((a, b), c) in enumerate(zip(bounds, books, strict=True)):
        table = ((r[:, a:b] ** 2).sum(1)[:, None] - 2 * r[:, a:b] @ c.T + (c**2).sum(1)).astype(np.float32)
        out += table[:, codes[:, s]]
    return out


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index reachable from each of n nodes over links (a, b)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def near_duplicates(vectors: DataFrame, cosine: float = 0.98, sample_rows: int = SAMPLE_ROWS, reach: float = 0.5) -> DataFrame:
    """vec_id, n_links, component_id, kept. reach: share of the largest link distance by which lists are probed."""
    spark = vectors.sparkSession
    far = float(np.sqrt(2 - 2 * cosine))
    e = F.col("embedding")
    odd = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | ~F.exists(e, lambda x: x != 0)
    rows = vectors.select("vec_id", "label", "embedding", F.coalesce(F.col("label").isNotNull() & e.isNotNull() & ~odd, F.lit(False)).alias("ok"))
    key = F.struct(F.xxhash64("label", "embedding").alias("x"), F.xxhash64(F.lit(1), "embedding", "label").alias("y"))
    rows = rows.withColumn("key", F.when(F.col("ok"), key))
    classes = materialize(rows.where("ok").groupBy("key").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("embedding").alias("embedding")), "classes")
    models = {}
    for dim, n in classes.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").limit(MOST_LENGTHS).collect():
        part = classes.where(F.size("embedding") == dim)
        drawn = np.array([r[0] for r in part.orderBy(F.xxhash64(F.lit(3), "id"), "id").limit(sample_rows).select("embedding").collect()], np.float64)
        models[dim] = fit(drawn / np.linalg.norm(drawn, axis=1, keepdims=True), int(np.clip(n // PER_LIST, 1, MOST_LISTS)))
    shared = spark.sparkContext.broadcast(models)  # at most MOST_LISTS centres and SUBSPACES codebooks for each length

    def assign(batches):
        import pandas as pd

        for b in batches:
            for dim, part in b.groupby(b["embedding"].map(len)):
                for at in range(0, len(part), 2000):
                    some = part.iloc[at : at + 2000]
                    x = np.stack(some["embedding"].to_numpy()).astype(np.float64)
                    x /= np.linalg.norm(x, axis=1, keepdims=True)
                    own, probes, codes, error = encode(x, shared.value.get(dim) or one_list(dim), reach * far)
                    yield pd.DataFrame({"id": some["id"].to_numpy(), "copies": some["copies"].to_numpy(), "label": some["label"].astype(str).to_numpy(), "dim": dim, "v": list(x), "list": own.astype(np.int32), "probes": [p.astype(np.int32) for p in probes], "codes": [c.tobytes() for c in codes], "error": error})

    kind = "id long, copies long, label string, dim int, v array<double>, list int, probes array<int>, codes binary, error double"
    coded = materialize(classes.select("id", "copies", "label", "embedding").mapInPandas(assign, kind), "codes")
    queries = coded.withColumn("list_asked", F.explode("probes"))
    place = ["label", "dim", "list"]
    blocks = (
        coded.groupBy(*place).agg(F.count("*").alias("members"))
        .join(queries.groupBy("label", "dim", F.col("list_asked").alias("list")).agg(F.count("*").alias("asked")), place)
        .select(*place, F.ceil(F.col("members") / MEMBERS).cast("long").alias("mn"), F.ceil(F.col("asked") / QUERIES).cast("long").alias("qn"))
    )
    blocks = materialize(blocks, "blocks")
    blocks = F.broadcast(blocks) if blocks.count() <= BROADCAST_LISTS else blocks
    fields = ["label", "dim", "list", "id", "copies", "v", "home", "probes", "codes", "error"]
    members = coded.withColumn("home", F.col("list")).join(blocks, place).withColumn("mb", F.pmod(F.xxhash64("id"), F.col("mn"))).withColumn("qb", F.explode(F.sequence(F.lit(0).cast("long"), F.col("qn") - 1)))
    asks = queries.withColumn("home", F.col("list")).drop("list").withColumnRenamed("list_asked", "list").join(blocks, place).withColumn("qb", F.pmod(F.xxhash64(F.lit(5), "id"), F.col("qn"))).withColumn("mb", F.explode(F.sequence(F.lit(0).cast("long"), F.col("mn") - 1)))
    asks = asks.withColumn("codes", F.lit(None).cast("binary"))
    dealt = members.select(*fields, "mb", "qb").unionByName(asks.select(*fields, "mb", "qb"))

    def compare(key, rows):
        import pandas as pd

        _, dim, where, _, _ = key
        centres, bounds, books = shared.value.get(dim) or one_list(dim)
        m, q = rows[rows["codes"].notna()].reset_index(drop=True), rows[rows["codes"].isna()].reset_index(drop=True)
        out = pd.DataFrame({"id": [], "links": [], "root": []}).astype(np.int64)
        if not len(m) or not len(q):
            return out
        mv, qv = np.stack(m["v"].to_numpy()), np.stack(q["v"].to_numpy())
        codes = np.frombuffer(b"".join(m["codes"]), np.uint8).reshape(len(m), -1)
        limit = ((far + m["error"].to_numpy()) * 1.001 + 1e-3) ** 2
        a, b = np.nonzero(table_distances(qv, codes, centres[where], bounds, books) <= limit[None, :].astype(np.float32))
        keep = np.zeros(len(a), bool)
        for at in range(0, len(a), 200_000):
            s = slice(at, at + 200_000)
            keep[s] = (qv[a[s]] * mv[b[s]]).sum(1) >= cosine
        a, b = a[keep], b[keep]
        qi, mi = q["id"].to_numpy(), m["id"].to_numpy()
        other = qi[a] != mi[b]
        a, b = a[other], b[other]
        if not len(a):
            return out
        # a link counts for its query; for its member only if that doesn't ask the query's own list itself
        home, home_of = np.unique(q["home"].to_numpy(), return_inverse=True)
        asks_back = np.stack([np.isin(home, p) for p in m["probes"]])
        silent = ~asks_back[b, home_of[a]]
        qc, mc = q["copies"].to_numpy(), m["copies"].to_numpy()
        ids = np.unique(np.concatenate([qi[a], mi[b]]))
        x, y = np.searchsorted(ids, qi[a]), np.searchsorted(ids, mi[b])
        links = np.bincount(x, weights=mc[b], minlength=len(ids)) + np.bincount(y[silent], weights=qc[a[silent]], minlength=len(ids))
        return pd.DataFrame({"id": ids, "links": links.astype(np.int64), "root": ids[_roots(len(ids), x, y)]})

    found = materialize(dealt.groupBy("label", "dim", "list", "mb", "qb").applyInPandas(compare, "id long, links long, root long"), "found")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    component = connected_components(found.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")))
    # a vector that a third of all rows repeat is one class: its rows are dealt over many tasks
    named = classes.select("key", "id", "copies").join(links, "id", "left").join(component.withColumnRenamed("node", "id"), "id", "left")
    named = named.select("key", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    out = join_hot(materialize(rows.select("vec_id", "key"), "keyed"), named, "key", "vec_id", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"), F.coalesce(F.col("component_id") == F.col("vec_id"), F.lit(True)).alias("kept"))
