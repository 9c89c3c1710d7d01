"""Several clusters a speaker: by density on cosine distance, with centroids, variances and prototypes of each.

Density clusters are worked out on blocks: a task compares one block of a speaker's vectors with another and returns, per vector, how many
lie within eps, and later a root per core vector; pairs are never listed, but for those of vectors with fewer neighbours than a core needs. The roots of
all blocks are joined to clusters by connected components in written rounds.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions.vectors import distance, mean_vectors
from parlance.operators.bank import BLOCK, top_rows, unit_rows
from parlance.operators.sequences import numbered
from parlance.tables import connected_components, drop, materialize, roots

#: Distances this near to eps are summed again component by component, so that they don't depend on how vectors are dealt.
_CLOSE = 1e-9


def _within(x: np.ndarray, y: np.ndarray, eps: float) -> np.ndarray:
    """Whether the cosine distance of each row of x to each of y is at most eps."""
    d = 1 - x @ y.T
    near = d <= eps
    for i, j in np.argwhere(np.abs(d - eps) <= _CLOSE):
        near[i, j] = 1 - sum(a * b for a, b in zip(x[i].tolist(), y[j].tolist(), strict=True)) <= eps
    return near


def _blocks(rows: DataFrame, run, kind: str, asked: DataFrame | None = None) -> DataFrame:
    """run(x, y) on every block of `asked` (or rows) beside every block of rows of the same speaker and vector length; both have id, v and speaker."""
    place = ["speaker", "dim"]
    sized = lambda df: df.withColumn("dim", F.size("v"))
    x, y = sized(rows if asked is None else asked), sized(rows)
    counts = lambda df, n: df.groupBy(*place).agg(F.ceil(F.count("*") / BLOCK).cast("long").alias(n))
    blocks = materialize(counts(x, "xn").join(counts(y, "yn"), place), "blocks")
    few = F.broadcast(blocks) if blocks.count() <= 1_000_000 else blocks
    deal = lambda df, own, n, other, m: df.join(few, place).withColumn(own, F.pmod(F.xxhash64("entry_idx"), F.col(n))).withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.col(m) - 1)))
    fields = [*place, "xb", "yb", "asks", "entry_idx", "v", *[c for c in ("core",) if c in rows.columns]]
    both = deal(x, "xb", "xn", "yb", "yn").withColumn("asks", F.lit(True)).select(*fields).unionByName(deal(y, "yb", "yn", "xb", "xn").withColumn("asks", F.lit(False)).select(*fields))

    def compare(key, part):
        part = part.sort_values("entry_idx", kind="stable")
        a, b = part[part["asks"]], part[~part["asks"]]
        return run(key[0], a, b)

    return both.groupBy(*place, "xb", "yb").applyInPandas(compare, kind)


def density_clusters(bank: DataFrame, eps: float = 0.28, least: int = 5) -> DataFrame:
    """speaker, entry_idx, cluster: density clusters within each speaker's entries, -1 for noise.

    An entry with `least` entries within eps (itself included) is a core; cores within eps of each other share a cluster, numbered by its first core; another entry
    joins the first cluster that has a core within eps. entry_idx is unique within the bank.
    """
    rows = materialize(unit_rows(bank).select("speaker", F.col("entry_idx").cast("long").alias("entry_idx"), "v"), "units")

    def count(speaker, a, b):
        import pandas as pd

        if not len(a) or not len(b):
            return pd.DataFrame({"entry_idx": [], "n": []}).astype(np.int64)
        near = _within(np.stack(a["v"]), np.stack(b["v"]), eps)
        return pd.DataFrame({"entry_idx": a["entry_idx"].to_numpy(), "n": near.sum(1)})

    counts = _blocks(rows, count, "entry_idx long, n long").groupBy("entry_idx").agg((F.sum("n") >= least).alias("core"))
    rows = materialize(rows.join(counts, "entry_idx"), "cores")

    def link(speaker, a, b):
        """Cores of this block with the smallest core that they reach within it, and each other entry's cores."""
        import pandas as pd

        none = pd.DataFrame({"entry_idx": [], "other": [], "core": []}).astype({"entry_idx": np.int64, "other": np.int64, "core": bool})
        b = b[b["core"]]
        if not len(a) or not len(b):
            return none
        near = _within(np.stack(a["v"]), np.stack(b["v"]), eps)
        ai, bi, core = a["entry_idx"].to_numpy(), b["entry_idx"].to_numpy(), a["core"].to_numpy(bool)
        i, j = np.nonzero(near & core[:, None])
        ids = np.unique(np.concatenate([ai[core], bi]))
        found = ids[roots(np.searchsorted(ids, ai[i]), np.searchsorted(ids, bi[j]), len(ids))]
        m, n = np.nonzero(near & ~core[:, None])
        return pd.concat([pd.DataFrame({"entry_idx": ids, "other": found, "core": True}), pd.DataFrame({"entry_idx": ai[m], "other": bi[n], "core": False})])

    links = materialize(_blocks(rows, link, "entry_idx long, other long, core boolean"), "links")
    joined = connected_components(links.where("core and entry_idx <> other").select(F.col("entry_idx").alias("a"), F.col("other").alias("b")))
    cores = rows.where("core").select("speaker", "entry_idx").join(joined.withColumnRenamed("node", "entry_idx"), "entry_idx", "left").select("speaker", "entry_idx", F.coalesce("component", "entry_idx").alias("first"))
    cores = materialize(cores, "core-clusters")
    edge = links.where("not core").join(cores.select(F.col("entry_idx").alias("other"), "first"), "other").groupBy("entry_idx").agg(F.min("first").alias("first"))
    ranks = numbered(cores.select("speaker", "first").distinct(), ["speaker"], ["first"]).select("speaker", "first", F.col("_i").cast("long").alias("cluster"))
    every = rows.select("speaker", "entry_idx").join(cores.select("entry_idx", "first").unionByName(edge), "entry_idx", "left")
    out = every.join(ranks, ["speaker", "first"], "left").select("speaker", "entry_idx", F.coalesce("cluster", F.lit(-1).cast("long")).alias("cluster"))
    out = materialize(out, "density")
    drop(links)
    return out


def members(bank: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """entry_idx, speaker, cluster_id, v. labels (density_clusters()): noise is a cluster of its own; without them a speaker is one cluster."""
    rows = unit_rows(bank).select("entry_idx", "speaker", "v")
    if labels is None:
        return rows.withColumn("cluster_id", F.concat("speaker", F.lit("_c0")))
    rows = rows.join(labels.select("entry_idx", "cluster"), "entry_idx", "left")
    solo = F.coalesce(F.col("cluster"), F.lit(-1)) < 0
    name = F.when(solo, F.concat("speaker", F.lit("_solo_"), F.col("entry_idx").cast("string"))).otherwise(F.concat("speaker", F.lit("_c"), F.col("cluster").cast("string")))
    return rows.select("entry_idx", "speaker", "v", name.alias("cluster_id"))


def clusters_of(rows: DataFrame) -> DataFrame:
    """speaker, cluster_id, centroid (unit mean), variance (mean squared distance to it), members, first_entry (the speaker's). rows: of members()."""
    key = ["speaker", "cluster_id"]
    centres = mean_vectors(rows, key, "v")
    spread = rows.join(centres, key).groupBy(*key).agg(F.avg(F.pow(distance(F.col("v"), F.col("centroid")), 2)).alias("variance"), F.count("*").alias("members"))
    order = rows.groupBy("speaker").agg(F.min("entry_idx").cast("long").alias("first_entry"))
    return centres.join(spread, key).join(order, "speaker")


def _assigned(rows: DataFrame, centres: DataFrame) -> DataFrame:
    """rows with at, the number of their cluster's nearest centre (the smaller on ties), and the squared distance to it. centres: cluster_id, centres (array of vectors)."""
    far = F.transform("centres", lambda c: F.aggregate(F.zip_with("v", c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
    met = rows.join(centres, "cluster_id").withColumn("far", far)
    return met.withColumn("square", F.array_min("far")).withColumn("at", F.array_position("far", F.col("square")) - 1).drop("far")


def kmeans_centres(rows: DataFrame, k: int, rounds: int = 20, tolerance: float = 1e-10) -> DataFrame:
    """cluster_id, centres: Lloyd's rounds inside every cluster of at least two members at once, from k seeds spread over it.

    The seeds are the entries at places 0, n/k, 2n/k, ... (rounded down) of the cluster in the order of their index. A round is one assignment and one
    sum of vectors per (cluster, centre); clusters with fewer than k members have as many centres as members. Centres that lose all members stay.
    """
    drawn = numbered(rows, ["cluster_id"], ["entry_idx"])
    limit = F.least(F.lit(k), F.col("_n"))
    # the place p is a seed if it is floor(j n / k) for some j
    j = F.ceil(F.col("_i") * limit / F.col("_n"))
    seeds = drawn.where(F.col("_n") > 1).withColumn("j", j).where((F.floor(F.col("j") * F.col("_n") / limit) == F.col("_i")) & (F.col("j") < limit))
    listed = lambda df, at, v: df.groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(at).alias("at"), F.col(v).alias("v")))), lambda x: x["v"]).alias("centres"))
    centres = materialize(listed(seeds, "j", "v"), "seeds")
    many = materialize(rows.join(centres.select("cluster_id"), "cluster_id", "left_semi"), "many")
    for _ in range(rounds):
        means = mean_vectors(_assigned(many, centres), ["cluster_id", "at"], "v", "mean", as_unit=False)
        old = centres.select("cluster_id", F.posexplode("centres").alias("at", "old")).join(means.withColumn("at", F.col("at").cast("int")), ["cluster_id", "at"], "left").withColumn("new", F.coalesce("mean", "old"))
        moved = old.withColumn("moved", distance(F.col("old"), F.col("new")))
        new = materialize(moved.groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "new"))), lambda x: x["new"]).alias("centres"), F.max("moved").alias("moved")), "centres")
        most = new.agg(F.max("moved")).first()[0]
        drop(centres)
        centres = new.drop("moved")
        if most is None or most <= tolerance:
            break
    return centres


def prototypes_of(rows: DataFrame, clusters: DataFrame, k: int, method: str = "central", rounds: int = 20) -> DataFrame:
    """speaker, cluster_id, place, entry_idx, v, variance: up to k entries that stand for each cluster. rows: of members().

    `central`: the entries nearest the centroid, the earlier on ties. `kmeans`: of each of k centres the entry nearest to it that no earlier centre took, then the most central ones.
    """
    known = rows.join(clusters.select("speaker", "cluster_id", "centroid", "variance"), ["speaker", "cluster_id"]).withColumn("far", distance(F.col("v"), F.col("centroid")))
    fields = ["speaker", "cluster_id", "entry_idx", "v", "variance"]
    if method == "central" or k <= 1:
        return top_rows(known, ["speaker", "cluster_id"], [F.col("far"), F.col("entry_idx")], k, "entry_idx").select("speaker", "cluster_id", "place", *fields[2:])
    known = materialize(known.select(*fields, "far"), "known")
    centres = kmeans_centres(rows, k, rounds)
    each = known.join(centres.select("cluster_id", F.posexplode("centres").alias("at", "centre")), "cluster_id").withColumn("d", distance(F.col("v"), F.col("centre")))
    # of each centre only the k nearest can be its choice: the earlier centres took fewer than k
    near = top_rows(each.select("cluster_id", "at", "entry_idx", "d"), ["cluster_id", "at"], [F.col("d"), F.col("entry_idx")], k, "entry_idx")
    lists = near.groupBy("cluster_id", "at").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "entry_idx"))), lambda x: x["entry_idx"]).alias("ids"))
    lists = lists.groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "ids"))), lambda x: x["ids"]).alias("lists"))
    take = F.aggregate("lists", F.array().cast("array<bigint>"), lambda got, ids: F.concat(got, F.slice(F.filter(ids, lambda x: ~F.array_contains(got, x)), 1, 1)))
    chosen = lists.select("cluster_id", F.posexplode(take).alias("place", "entry_idx"))
    first = known.join(chosen, ["cluster_id", "entry_idx"], "left")
    # the places that are left go to the most central entries
    w = Window.partitionBy("cluster_id").orderBy(F.coalesce(F.col("place"), F.lit(k)), "r")
    rest = top_rows(first.where("place is null").select("cluster_id", "entry_idx", "far"), ["cluster_id"], [F.col("far"), F.col("entry_idx")], k, "entry_idx").select("cluster_id", "entry_idx", F.col("place").alias("r"))
    some = first.join(rest, ["cluster_id", "entry_idx"], "left").where("place is not null or r is not null").withColumn("place", (F.row_number().over(w) - 1).cast("long")).where(F.col("place") < k)
    return some.select("speaker", "cluster_id", "place", "entry_idx", "v", "variance")
