"""Tables in the folder that driver and executors share, and what is worked out in rounds of them.

A table that is read again is written to that folder: it cuts the lineage, and no lost executor takes it along.
"""

from __future__ import annotations

import atexit
import uuid

import numpy as np
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Links that one task may merge at the end of connected_components: 16 MB of pairs.
FEW_LINKS = 1_000_000
_ROOTS: set[str] = set()
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, or one of our own where that is unset and all runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    app = spark.sparkContext.applicationId
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile  # only for tests and local sessions, where one machine holds everything

        found = _OWN.get(app) or _OWN.setdefault(app, "file://" + tempfile.mkdtemp(prefix="parlance-"))
    root = f"{found.rstrip('/')}/parlance-{app}"
    if root not in _ROOTS:
        _ROOTS.add(root)
        atexit.register(_remove, spark, root)
    return root


def _remove(spark: SparkSession, root: str) -> None:
    try:
        delete(spark, root)
    except Exception:  # the session may be gone already; the folder is then the cluster's to clean
        pass


def _file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _file_system(spark, path)
    fs.delete(p, True)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Delete a table of materialize() that nothing reads any more."""
    for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        delete(df.sparkSession, f)


def replace(spark: SparkSession, path: str, write) -> None:
    """Put what write(folder) writes in place of path: written beside it first, so it may be made from what path holds, and a failure leaves path as it was.

    The old folder is renamed, not deleted, until the new one has its name; one that is found under `path.old` is what a run that died between the two left.
    """
    fresh, old = f"{path.rstrip('/')}.new-{uuid.uuid4().hex[:8]}", f"{path.rstrip('/')}.old"
    try:
        write(fresh)
    except BaseException:
        delete(spark, fresh)
        raise
    fs, here = _file_system(spark, path)
    to = lambda p: _file_system(spark, p)[1]
    if fs.exists(here):
        fs.delete(to(old), True)
        if not fs.rename(here, to(old)):
            raise OSError(f"{path} can't be renamed")
    if not fs.rename(to(fresh), here):
        raise OSError(f"{fresh} can't be renamed to {path}")
    fs.delete(to(old), True)


def roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest index reachable from each of n nodes over links (a, b)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        # whole trees hang themselves under the smaller root
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == root).all():
            return root
        root = new


def _merge(batches):
    import pandas as pd

    parts = [b for b in batches if len(b)]
    if parts:
        links = pd.concat(parts)
        nodes, at = np.unique(links[["a", "b"]].to_numpy(np.int64).ravel(), return_inverse=True)
        at = at.reshape(-1, 2)
        yield pd.DataFrame({"node": nodes, "component": nodes[roots(at[:, 0], at[:, 1], len(nodes))]})


def _links(edges: DataFrame, name: str) -> tuple[DataFrame, tuple]:
    """The edges (a, b) as a table, with their number and a fingerprint, taken while they are written."""
    seen = Observation()
    h = lambda *c: F.coalesce(F.bit_xor(F.xxhash64(*c)), F.lit(0))
    out = materialize(edges.observe(seen, F.count("*").alias("n"), h("a", "b").alias("x"), h(F.lit(1), "b", "a").alias("y")), name)
    return out, (seen.get["n"], seen.get["x"], seen.get["y"])


def connected_components(edges: DataFrame, few: int = FEW_LINKS, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges(a, b), both long: component is the smallest node reachable.

    Large-star and small-star steps in turn, each an aggregation by node (a minimum, combined before it is shuffled), each written. They shrink the
    links to stars; once there are at most `few` of them, counted, one task merges what is left.
    """
    e, seen = _links(edges.select(F.least("a", "b").cast("long").alias("a"), F.greatest("a", "b").cast("long").alias("b")).where("a <> b").distinct(), "links")
    for _ in range(most_rounds):
        if seen[0] <= few:
            out = materialize(e.repartition(1).mapInPandas(_merge, "node long, component long"), "components")
            drop(e)
            return out
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = materialize(both.where("v > u").join(low, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a <> b").distinct(), "large")
        joined = large.join(large.groupBy("b").agg(F.min("a").alias("m")), "b")
        small = joined.select(F.col("m").alias("a"), "b").unionByName(joined.select(F.col("m").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
        small, now = _links(small, "small")
        same, seen = now == seen, now
        drop(large)
        drop(e)
        e = small
        if same:  # equal number and equal sums of two hashes: the same links, all of them stars
            return e.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(e.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
    raise RuntimeError(f"no fixpoint after {most_rounds} rounds")
