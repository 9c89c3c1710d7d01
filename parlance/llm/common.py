"""What the corpus operators share: word classes, joins of hot keys, and the library's tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.tables import connected_components, drop, materialize, new_path, shared_dir

__all__ = ["SPACE", "WORD", "connected_components", "drop", "join_hot", "materialize", "new_path", "shared_dir", "table"]

#: Word separators of the contracts (space, and tab to carriage return), as a Java regex class.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def join_hot(left: DataFrame, right: DataFrame, key: str, spread: str, how: str = "inner", hot_rows: int = 10_000, salts: int = 64) -> DataFrame:
    """left joined with right (one row a key), keys of `hot_rows` or more left rows dealt over `salts` tasks by the hash of `spread`.

    left must be cheap to read twice. The hot keys are at most a 10,000th of the rows; they are broadcast while counted to be few.
    """
    hot = materialize(left.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") >= hot_rows).select(key, F.lit(salts).alias("salts")), "hot")
    few = F.broadcast(hot) if hot.count() <= 1_000_000 else hot
    a = left.join(few, key, "left").withColumn("salt", F.when(F.col("salts").isNull(), 0).otherwise(F.pmod(F.xxhash64(spread), F.coalesce("salts", F.lit(1)))).cast("int")).drop("salts")
    b = right.join(few, key, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
    return a.join(b, [key, "salt"], how).drop("salt")
