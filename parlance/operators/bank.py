"""The vector bank: centroids, matching, score normalisation, whitening, clusters."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions.vectors import distance, dot, doubles, norm, unit, vector_parts
from parlance.tables import materialize

#: Largest bank side (clusters times vector length, in doubles) that is broadcast.
BROADCAST_VALUES = 4_000_000
#: Vectors of each side that one task compares.
BLOCK = 2048
#: Values (vectors times their length) of a side that one task compares when it looks for neighbours, and the parts that a side has at least, if they aren't shorter than BLOCK.
WIDE_VALUES, PARTS = 32_768 * 64, 8
#: Products that a task holds at once, and pairs that it sums again.
_SCORES, _PAIRS = 8_000_000, 500_000


def unit_rows(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """v: the unit vector; zero and null vectors are left out."""
    return df.where(norm(doubles(F.col(vector))) > 0).withColumn("v", unit(doubles(F.col(vector))))


def clusters_by_speaker(bank: DataFrame) -> DataFrame:
    """speaker, cluster_id, centroid, variance (mean squared distance to the unit centroid), members: one cluster a speaker."""
    from parlance.operators.clusters import clusters_of, members

    return clusters_of(members(bank))


def _small(df: DataFrame) -> DataFrame | None:
    """df, a table, to be broadcast if its size, counted, is within bounds; None beyond."""
    n, width = df.agg(F.count("*"), F.coalesce(F.max(F.size("centroid")), F.lit(0))).first()
    return F.broadcast(df) if n * width <= BROADCAST_VALUES else None


def _meet(queries: DataFrame, clusters: DataFrame, also: Column | None = None, salts: int = 256) -> DataFrame:
    """Every query beside every cluster of its length: by a broadcast of the clusters or, where they are too many, by `salts` parts of the queries
    that each meet a copy of them (the length alone would be one key for all rows)."""
    fits = F.size("v") == F.size("centroid")
    fits = fits if also is None else fits & also
    small = _small(clusters)
    if small is not None:
        return queries.join(small, fits)
    q = queries.withColumn("_part", F.pmod(F.xxhash64("session", "seg_idx"), F.lit(salts)))
    c = clusters.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return q.join(c, "_part").where(fits).drop("_part")


def top_rows(rows: DataFrame, keys: list[str], order: list[Column], k: int, spread: str, salts: int = 32) -> DataFrame:
    """The first k rows of each key, with place (from 0). Each of `salts` parts of a key keeps k of its own first, so no task orders a whole key."""
    part = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)))
    part = part.withColumn("place", F.row_number().over(Window.partitionBy(*keys, "_salt").orderBy(*order))).where(F.col("place") <= k).drop("_salt")
    return part.withColumn("place", (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).cast("long")).where(F.col("place") < k)


def prototypes(bank: DataFrame, clusters: DataFrame, k: int, method: str = "central") -> DataFrame:
    """speaker, cluster_id, place, entry_idx, v, variance: the k entries that stand for each speaker. clusters: of clusters_by_speaker()."""
    from parlance.operators.clusters import members, prototypes_of

    return prototypes_of(members(bank), clusters, k, method)


def bank_scores(queries: DataFrame, clusters: DataFrame, radius: float = 2.5, examples: DataFrame | None = None) -> DataFrame:
    """Candidates of each query: the best vector of the best cluster per speaker within radius deviations, ranked by score, with its cluster_id.

    Every query meets every cluster: that is the operator. The cluster side is a few rows per speaker and is broadcast after its size
    is checked, or copied to parts of the queries. A cluster is known by its centroid and, with examples (prototypes()), by those entries too; a query never meets itself
    among them. Queries with a column own_cluster, the cluster_id of the entry that they are, or own, its speaker (of one cluster), meet that cluster without themselves.
    Equal scores of a speaker go to the centroid, then to the nearer prototype, then to the first cluster_id; speakers of equal scores stand in the order of the bank.
    """
    own, of = next(((c, of) for c, of in (("own_cluster", "cluster_id"), ("own", "speaker")) if c in queries.columns), (None, None))
    q = unit_rows(queries).select("session", "seg_idx", "v", *[own] * bool(own))
    clusters = materialize(clusters, "clusters")  # made once, though they are counted, joined and put in order
    pairs = _meet(q, clusters.select("speaker", "cluster_id", "centroid", "variance", *["members"] * bool(own)))
    if own:
        # the members are unit vectors, so their sum's length follows from the variance, and the others' variance from their sum's length
        length, mine, n = F.col("members") * (1 - F.col("variance") / 2), F.col(own).eqNullSafe(F.col(of)), F.col("members") - 1
        pairs = pairs.where(~mine | (n > 0)).withColumn("others", F.when(mine, F.zip_with("centroid", "v", lambda c, x: c * length - x)))
        pairs = pairs.withColumn("variance", F.when(mine, F.greatest(F.lit(0.0), 2 - 2 * F.try_divide(norm(F.col("others")), n))).otherwise(F.col("variance")))
        pairs = pairs.withColumn("centroid", F.when(mine, unit(F.col("others"))).otherwise(F.col("centroid")))
    met = pairs.select("session", "seg_idx", "speaker", "cluster_id", "v", F.col("centroid").alias("w"), "variance", F.lit(-1).cast("long").alias("place"))
    if examples is not None:
        e = materialize(examples.select("speaker", "cluster_id", "place", "entry_idx", F.col("v").alias("centroid"), "variance"), "examples")
        near = _meet(q, e, F.col("seg_idx") != F.col("entry_idx"))
        met = met.unionByName(near.select("session", "seg_idx", "speaker", "cluster_id", "v", F.col("centroid").alias("w"), "variance", "place"))
    far = distance(F.col("v"), F.col("w"))
    inside = (F.col("variance") <= 0) | (far <= F.greatest(F.sqrt("variance") * radius, F.lit(1e-4)))
    scored = met.withColumn("distance", far).where(inside).withColumn("score", dot(F.col("v"), F.col("w")))
    best = scored.groupBy("session", "seg_idx", "speaker").agg(F.min_by(F.struct("score", "distance", "variance", "place", "cluster_id"), F.struct(-F.col("score"), "place", "cluster_id")).alias("b"))
    first = clusters.groupBy("speaker").agg(F.min("first_entry").alias("first_entry")) if "first_entry" in clusters.columns else None
    best = best.withColumn("first_entry", F.lit(0)) if first is None else best.join(first, "speaker", "left")
    rank = F.row_number().over(Window.partitionBy("session", "seg_idx").orderBy(F.desc("b.score"), "first_entry", "speaker"))
    source = F.when(F.col("b.place") < 0, "centroid").otherwise("prototype")
    return best.select("session", "seg_idx", rank.cast("long").alias("rank"), "speaker", "b.score", "b.distance", source.alias("source"), "b.cluster_id")


def add_entries(bank: DataFrame, new: DataFrame) -> DataFrame:
    """The bank with further entries (entry_idx, speaker, embedding), as unit vectors; an entry without direction is an error."""
    odd = new.where("embedding is null").unionByName(new.where(norm(doubles(F.col("embedding"))) <= 0))
    if not odd.isEmpty():
        raise ValueError("an entry of the bank needs a vector that isn't zero")
    known = lambda df: df.select("entry_idx", "speaker", doubles(F.col("embedding")).alias("embedding"))
    return known(bank).unionByName(unit_rows(new).select("entry_idx", "speaker", F.col("v").alias("embedding")))


def match(queries: DataFrame, bank: DataFrame, threshold: float, margin: float = 0.0, radius: float = 2.5, examples: int = 0) -> DataFrame:
    """Score and accept in one call, by centroids and `examples` prototypes a speaker."""
    clusters = clusters_by_speaker(bank)
    return accepted(bank_scores(queries, clusters, radius, prototypes(bank, clusters, examples) if examples else None), threshold, margin)


def accepted(candidates: DataFrame, threshold: float, margin: float) -> DataFrame:
    """Per query: best, second (0 if none), margin, and whether both bars are met."""
    top = candidates.where("rank <= 2").groupBy("session", "seg_idx").agg(F.min_by("speaker", "rank").alias("speaker"), F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("score"), F.coalesce(F.max(F.when(F.col("rank") == 2, F.col("score"))), F.lit(0.0)).alias("second"))
    top = top.withColumn("margin", F.col("score") - F.col("second"))
    return top.withColumn("matched", (F.col("score") >= threshold) & (F.col("margin") >= max(margin, 0.0)))


def _best_others(vectors: DataFrame, bank: DataFrame, cohort: int) -> DataFrame:
    """id, near: the best (score, speaker) of each vector in order, until `cohort` of them lie outside the speaker that is commonest among them; the vector's own entry left out.

    Whatever speaker is then left out, the cohort best of the others are still among them. vectors: id, entry (its own, or null), v.
    """
    e = unit_rows(bank).select(F.lit(0).alias("session"), F.col("entry_idx").alias("dst"), "v", F.col("speaker").alias("kind"))
    q = vectors.select(F.lit(0).alias("session"), F.col("id").alias("src"), "v", "entry")
    near = nearest_entries(q, e, cohort).where(~F.col("dst").eqNullSafe(F.col("entry")))
    order = [F.desc("w"), F.col("dst")]
    near = near.withColumn("r", F.row_number().over(Window.partitionBy("src").orderBy(*order))).withColumn("own", F.row_number().over(Window.partitionBy("src", "kind").orderBy(*order)))
    before = Window.partitionBy("src").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    near = near.withColumn("most", F.coalesce(F.max("own").over(before), F.lit(0))).where(F.col("r") - 1 - F.col("most") < cohort)
    return near.groupBy(F.col("src").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("r", F.col("w").alias("s"), "kind"))), lambda x: F.struct(x["s"].alias("s"), x["kind"].alias("kind"))).alias("near"))


def _cohort(near: Column, speaker: Column, cohort: int) -> Column:
    """struct(mean, std) of the cohort best scores of other speakers' entries; null without any."""
    s = F.transform(F.slice(F.filter(near, lambda x: x["kind"] != speaker), 1, cohort), lambda x: x["s"])
    n = F.size(s)
    mean = F.aggregate(s, F.lit(0.0), lambda a, x: a + x) / n
    std = F.sqrt(F.aggregate(s, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / n)
    return F.when(n > 0, F.struct(mean.alias("mean"), F.greatest(std, F.lit(1e-6)).alias("std")))


def normalised_scores(queries: DataFrame, bank: DataFrame, clusters: DataFrame, cohort: int = 50, radius: float = 1e9) -> DataFrame:
    """Adaptive symmetric score normalisation of each (query, speaker); the raw score where there is no cohort.

    Each query meets each entry once, in blocks; leaving a speaker out is a matter of the short lists that remain. Queries that are entries of
    the bank (seg_idx = entry_idx) don't meet themselves.
    """
    raw = bank_scores(queries, clusters, radius).select("session", "seg_idx", "speaker", F.col("score").alias("raw_score"))
    q = unit_rows(queries).select(F.col("seg_idx").alias("id"), F.col("seg_idx").alias("entry"), "v")
    c = clusters.select("speaker", F.xxhash64("speaker").alias("id"), F.lit(None).cast("long").alias("entry"), F.col("centroid").alias("v"))
    of_query = _best_others(q, bank, cohort).select(F.col("id").alias("seg_idx"), F.col("near").alias("q_near"))
    of_cluster = c.select("speaker", "id").join(_best_others(c, bank, cohort), "id").select("speaker", _cohort(F.col("near"), F.col("speaker"), cohort).alias("c"))
    out = raw.join(of_query, "seg_idx", "left").join(of_cluster, "speaker", "left").withColumn("q", _cohort(F.col("q_near"), F.col("speaker"), cohort))
    z = 0.5 * ((F.col("raw_score") - F.col("c.mean")) / F.col("c.std") + (F.col("raw_score") - F.col("q.mean")) / F.col("q.std"))
    return out.select("session", "seg_idx", "speaker", "raw_score", F.coalesce(z, "raw_score").alias("score"))


def _candidates(x: np.ndarray, y: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of pairs among which are, for each row of x, the k + 1 columns of the highest product with it, with all that tie, if it is at least `least`.

    Products in single precision screen, then those in double where copies leave too many; what rounding may be off is allowed for. x and y are unit vectors.
    """
    for kind, slack in ((np.float32, 4e-7 * (x.shape[1] + 8)), (np.float64, 1e-15 * (x.shape[1] + 8))):
        s = x.astype(kind) @ y.astype(kind).T
        groups = s.shape[1] // 32
        bar = np.full(len(x), least)
        if groups > k:  # the k + 1 best of disjoint groups' maxima are all in different columns
            most = s[:, : groups * 32].reshape(len(x), 32, groups).max(1)
            bar = np.maximum(bar, np.partition(most, groups - k - 1, axis=1)[:, groups - k - 1])
        row, col = np.divmod(np.flatnonzero(s >= (bar - slack).astype(kind)[:, None] - kind(slack)), s.shape[1])
        if len(row) <= 64 * (k + 1) * len(x):
            break
    return row, col


def _block_nearest(x: np.ndarray, y: np.ndarray, src: np.ndarray, dst: np.ndarray, kind: np.ndarray | None, k: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, cosine) of the best columns of each row by (cosine descending, dst): k of them or, with kinds, until k lie outside the commonest kind; summed component by component, so equal vectors tie.

    dst ascends. Vectors that aren't finite have no neighbours.
    """
    number = np.zeros(len(y), np.int64) if kind is None else np.unique(kind, return_inverse=True)[1].reshape(-1)
    fit, able = np.flatnonzero(np.isfinite(y).all(1)), np.flatnonzero(np.isfinite(x).all(1))
    # of equal vectors (of one kind) only the first k + 1 can count
    if len(fit):
        _, copy = np.unique(np.ascontiguousarray(y[fit]).view(f"V{y.itemsize * y.shape[1]}").ravel(), return_inverse=True)
        fit = fit[_place(copy.reshape(-1), number[fit]) <= k]
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    step = max(16, _SCORES // max(len(fit), 1))
    yt = np.ascontiguousarray(y[fit].T)
    for at in range(0, len(able) if len(fit) else 0, step):
        rows, m = able[at : at + step], k if kind is None else 2 * k
        while len(rows):
            near, r, c = [], *_candidates(x[rows], y[fit], m, least)
            for p in range(0, len(r), _PAIRS):
                i, j = r[p : p + _PAIRS], c[p : p + _PAIRS]
                w = np.zeros(len(i))
                for d in range(x.shape[1]):
                    w += x[rows[i], d] * yt[d, j]
                ok = (w >= least) & (src[rows[i]] != dst[fit[j]])
                near.append((i[ok], fit[j[ok]], w[ok]))
            r, c, w = (np.concatenate(a) for a in zip(*near, strict=True)) if near else found[0]
            order = np.lexsort((c, -w, r))
            r, c, w = r[order], c[order], w[order]
            if kind is None:
                best = _place(r) < k
                found.append((rows[r[best]], c[best], w[best]))
                break
            short, start = [], np.searchsorted(r, np.arange(len(rows) + 1))
            for i in range(len(rows)):
                seen: dict[int, int] = {}
                most = n = 0
                near_kinds = number[c[start[i] : start[i + 1]]].tolist()
                for q in near_kinds[: len(near_kinds) if m >= len(fit) else m]:
                    if n - most >= k:
                        break
                    n += 1
                    seen[q] = seen.get(q, 0) + 1
                    most = max(most, seen[q])
                if n - most < k and m < len(fit):  # too many of one kind among the m best: ask for more
                    short.append(i)
                else:
                    part = slice(start[i], start[i] + n)
                    found.append((np.full(n, rows[i]), c[part], w[part]))
            rows, m = rows[short], 4 * m
    return tuple(np.concatenate(a) for a in zip(*found, strict=True))


def _place(*keys: np.ndarray) -> np.ndarray:
    """Place of each row (from 0) among those of equal keys, in the order they stand."""
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
    first = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    out = np.empty(len(order), np.int64)
    out[order] = np.arange(len(order)) - first
    return out


def nearest_entries(queries: DataFrame, entries: DataFrame, k: int, least: float = -2.0) -> DataFrame:
    """(session, src, dst, w): the k entries of the query's session with the highest cosine, at least `least`; ties to the smaller dst, never to itself.

    queries: session, src, v; entries: session, dst, v; unit vectors. If entries have a kind, each block gives the best rows until k lie outside the commonest kind among them (so whatever kind is
    left out, its k best of the others are there), and kind is returned; a query with a column entry may be that entry, and both are then left to the caller. A task compares one block
    of queries with one block of entries by products of matrices and keeps a few rows a query, so no task holds a session and no list of pairs is written. Blocks grow with the
    sessions up to a bound, so vectors are copied a few times only.
    """
    place, kinds, entry = ["session", "dim"], "kind" in entries.columns, "entry" in queries.columns
    no = F.lit(None).cast("long")
    q = queries.select("session", F.size("v").alias("dim"), F.col("src").alias("id"), "v", F.lit("").alias("kind"), (F.col("entry") if entry else no).alias("entry"))
    e = entries.select("session", F.size("v").alias("dim"), F.col("dst").alias("id"), "v", (F.col("kind") if kinds else F.lit("")).alias("kind"), no.alias("entry"))
    size = F.least(F.greatest(F.count("*") / PARTS, F.lit(BLOCK)), F.greatest(F.lit(WIDE_VALUES) / F.greatest("dim", F.lit(1)), F.lit(256)))
    counts = lambda df, n: df.groupBy(*place).agg(F.ceil(F.count("*") / size).cast("long").alias(n))
    blocks = F.broadcast(counts(q, "qn").join(counts(e, "en"), place))  # one row a session and vector length
    deal = lambda df, own, n, other, m: df.join(blocks, place).withColumn(own, F.pmod(F.xxhash64("id"), n)).withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.col(m) - 1)))
    fields = [*place, "qb", "eb", "asks", "id", "v", "kind", "entry"]
    dealt = deal(q, "qb", F.col("qn"), "eb", "en").withColumn("asks", F.lit(True)).select(*fields).unionByName(deal(e, "eb", F.col("en"), "qb", "qn").withColumn("asks", F.lit(False)).select(*fields))

    def compare(key, rows):
        import pandas as pd

        rows = rows.sort_values("id", kind="stable")
        x, y = rows[rows["asks"]], rows[~rows["asks"]]
        if not len(x) or not len(y):
            return pd.DataFrame({"session": [], "src": [], "dst": [], "w": [], "kind": [], "entry": []})
        src, dst, kind = x["id"].to_numpy(np.int64), y["id"].to_numpy(np.int64), y["kind"].to_numpy()
        # without kinds a query is told from the entries by its id; with them by its column entry (one more is kept for it)
        itself = np.full(len(src), -(1 << 62)) if entry else src
        flat = lambda part: np.stack(part["v"].to_numpy()).astype(float, copy=False)
        row, col, w = _block_nearest(flat(x), flat(y), itself, dst, kind.astype(str) if kinds else None, k + entry, least)
        return pd.DataFrame({"session": key[0], "src": src[row], "dst": dst[col], "w": w, "kind": kind[col], "entry": x["entry"].to_numpy()[row]})

    kind = f"session {q.schema['session'].dataType.simpleString()}, src long, dst long, w double, kind string, entry long"
    found = dealt.groupBy(*place, "qb", "eb").applyInPandas(compare, kind).where(~F.col("dst").eqNullSafe(F.col("entry")))
    if not kinds:
        found = found.withColumn("r", F.row_number().over(Window.partitionBy("session", "src").orderBy(F.desc("w"), "dst"))).where(F.col("r") <= k)
    return found.select("session", "src", "dst", "w", *["kind"] * kinds, *["entry"] * entry)


def nearest_neighbours(segments: DataFrame, k: int = 8, least: float = 0.25) -> DataFrame:
    """Edges (session, src, dst, w): each vector's k nearest of its session with cosine at least `least`, made symmetric by the larger weight."""
    v = unit_rows(segments).where("session is not null").select("session", "seg_idx", "v")
    near = nearest_entries(v.toDF("session", "src", "v"), v.toDF("session", "dst", "v"), k, least)
    both = near.unionByName(near.select("session", F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    return both.groupBy("session", "src", "dst").agg(F.max("w").alias("w"))


def knn_votes(queries: DataFrame, bank: DataFrame, k: int, floor: float = 1e-6) -> DataFrame:
    """(session, seg_idx, speaker, probability): votes of each query's k nearest other entries, weighted by 1 / cosine distance (at least `floor`)."""
    b = unit_rows(bank).select("speaker", F.col("entry_idx").alias("dst"), "v")
    q = unit_rows(queries).select("session", F.col("seg_idx").alias("src"), "v")
    # all sessions search one bank
    near = nearest_entries(q.select(F.lit(0).alias("session"), "src", "v"), b.select(F.lit(0).alias("session"), "dst", "v"), k)
    near = near.drop("session").join(queries.select("session", F.col("seg_idx").alias("src")), "src").join(bank.select("speaker", F.col("entry_idx").alias("dst")), "dst")
    votes = near.groupBy("session", F.col("src").alias("seg_idx"), "speaker").agg(F.sum(1 / F.greatest(1 - F.col("w"), F.lit(floor))).alias("vote"))
    total = F.sum("vote").over(Window.partitionBy("session", "seg_idx"))
    return votes.select("session", "seg_idx", "speaker", (F.col("vote") / total).alias("probability"))


def whitening(bank: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(mean, matrix) that whitens unit vectors: pseudo-inverse root of the sample covariance, with a floor on eigenvalues.

    Moments are summed by the executors; the driver sees one d x d matrix. Vectors that are null, zero or not finite count nothing.
    """
    v = unit_rows(bank).select("v")

    def moments(batches):
        import pyarrow as pa

        n, s, m = 0, 0.0, 0.0
        for b in batches:
            for _, _, x in vector_parts(b.column("v")):
                x = x[np.isfinite(x).all(1)]
                n, s, m = n + len(x), s + x.sum(0), m + x.T @ x
        if n:
            x = np.concatenate([[n], s, m.ravel()])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(x))), pa.array(x)], ["i", "x"])

    # one row an element, summed before they meet: the driver sees d * d + d + 1 numbers
    parts = v.mapInArrow(moments, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).orderBy("i").toPandas()["x"].to_numpy()
    d = (v.select(F.size("v").alias("d")).first() or [1])[0]
    n = parts[0] if len(parts) else 0
    if n < 2:
        return np.zeros(d), np.eye(d)
    s, m = parts[1 : d + 1], parts[d + 1 :].reshape(d, d)
    mean = s / n
    values, axes = np.linalg.eigh((m - n * np.outer(mean, mean)) / (n - 1))
    floor = max(values.max() * 1e-6, 1e-8)
    root = np.where(values > floor, 1 / np.sqrt(np.maximum(values, floor)), 0.0)
    return mean, (axes * root) @ axes.T


def whitened(df: DataFrame, mean: np.ndarray, matrix: np.ndarray) -> DataFrame:
    """df, as a table, with embedding replaced by the whitened unit vector; null for a vector that is null, zero or not finite.

    It is written, so each vector goes through Python once however often the result is read, and no task that reads it needs a further worker for it.
    """

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for at, part, x in vector_parts(b.column("embedding")):
                x = x.reshape(len(x), len(mean))
                with np.errstate(divide="ignore", invalid="ignore"):
                    x = (x / np.linalg.norm(x, axis=1, keepdims=True) - mean) @ matrix
                x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
                finite = np.isfinite(x).all(1)
                there = np.zeros(len(part), bool)
                there[np.flatnonzero(part.is_valid().to_numpy(zero_copy_only=False))[finite]] = True
                offsets = np.concatenate([[0], np.cumsum(there * len(mean))]).astype(np.int32)
                white = pa.ListArray.from_arrays(pa.array(offsets), pa.array(x[finite].ravel()), mask=pa.array(~there))
                yield pa.RecordBatch.from_arrays([white if f.name == "embedding" else b.column(i).slice(at, len(part)) for i, f in enumerate(b.schema)], b.schema.names)

    kind = ", ".join(f"`{f.name}` {'array<double>' if f.name == 'embedding' else f.dataType.simpleString()}" for f in df.schema)
    return materialize(df.mapInArrow(run, kind), "white")


def embedded(segments: DataFrame, embed, least: float = 0.4, pad: float = 0.0) -> DataFrame:
    """segments with embedding, a unit vector: embed maps an iterator of pandas frames (all columns of segments, padded start and end) to frames with a
    further column embedding, or null where there is nothing to embed. Too short segments and vectors that are null or zero go. Keys travel with the rows."""
    rows = segments.where(F.col("end") - F.col("start") >= least).withColumns({"start": F.greatest(F.col("start") - pad, F.lit(0.0)), "end": F.col("end") + pad})
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", embedding array<double>"
    return rows.mapInPandas(embed, kind).withColumn("embedding", unit(F.col("embedding"))).where("embedding is not null")


def plane(vectors: DataFrame) -> DataFrame:
    """vectors with x and y: the two main axes of the unit vectors, for a plot. Moments are summed by the executors."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = unit_rows(vectors).withColumn("_in", array_to_vector("v"))
    out = PCA(k=2, inputCol="_in", outputCol="_out").fit(rows).transform(rows).withColumn("_xy", vector_to_array("_out"))
    return out.select(*vectors.columns, F.col("_xy")[0].alias("x"), F.col("_xy")[1].alias("y"))
