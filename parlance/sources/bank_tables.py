"""A bank of vectors as tables: entries, and the clusters that are made from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from parlance.sources.readers import missing
from parlance.tables import replace

ENTRIES = "entry_idx long, speaker string, embedding array<double>"
CLUSTERS = "speaker string, cluster_id string, centroid array<double>, variance double, members long, first_entry long"
PROTOTYPES = "speaker string, cluster_id string, place long, entry_idx long, v array<double>, variance double"


def save_bank(bank: DataFrame, path: str, labels: DataFrame | None = None, examples: int = 0, method: str = "central") -> None:
    """Entries as unit vectors with their cluster, the clusters, and `examples` prototypes of each, in place of what path holds.

    bank may be made from the bank at path: everything is written beside it and takes its place at the end. labels: of density_clusters(); without them a
    speaker is one cluster.
    """
    from pyspark.sql import functions as F

    from parlance.operators.clusters import clusters_of, members, prototypes_of

    spark = bank.sparkSession

    def write(folder: str) -> None:
        members(bank, labels).select("entry_idx", "speaker", F.col("v").alias("embedding"), "cluster_id").write.parquet(f"{folder}/entries")
        rows = spark.read.schema(f"{ENTRIES}, cluster_id string").parquet(f"{folder}/entries").withColumnRenamed("embedding", "v")
        clusters_of(rows).write.parquet(f"{folder}/clusters")
        if examples:
            prototypes_of(rows, load_clusters(spark, folder), examples, method).select("speaker", "cluster_id", "place", "entry_idx", "v", "variance").write.parquet(f"{folder}/prototypes")

    replace(spark, path, write)


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        found = spark.read.schema(schema).parquet(path)
        found.isEmpty()
        return found
    except Exception as e:
        if not missing(e):
            raise
        return spark.createDataFrame([], schema)


def load_bank(spark: SparkSession, path: str) -> DataFrame:
    """The entries at path; none where there is no bank."""
    return _table(spark, f"{path}/entries", ENTRIES)


def load_clusters(spark: SparkSession, path: str) -> DataFrame:
    """The clusters of a saved bank, as bank_scores() takes them."""
    return _table(spark, f"{path}/clusters", CLUSTERS)


def load_prototypes(spark: SparkSession, path: str) -> DataFrame:
    """The prototypes of a saved bank; none if it was saved without."""
    return _table(spark, f"{path}/prototypes", PROTOTYPES)


def save_vectors(vectors: DataFrame, path: str) -> None:
    """A map of vectors (session, seg_idx, embedding), one folder a session."""
    replace(vectors.sparkSession, path, lambda folder: vectors.write.partitionBy("session").parquet(folder))


def load_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
