"""The pool of mixed windows, and the hard negatives that are mined from it.

A pool is one table: record and vector of a window are one row, so nothing is paired by position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.functions.text import pair_key, valid_label
from parlance.operators.datasets import capped
from parlance.tables import replace

#: Fixed reasons for which a mixed window was turned down that make it a hard negative.
HARD_REASONS = ("low_share", "not_dominant")
POOL = "row_id long, session string, window_index long, speaker string, second_speaker string, rejection string, dominant_share double, active_speakers int, top1_power double, top2_power double, style_profile string, style_score double, start double, end double, embedding array<float>"


def save_pool(pool: DataFrame, path: str) -> None:
    """The pool in place of what path holds; it may be made from that."""
    replace(pool.sparkSession, path, lambda folder: pool.write.parquet(folder))


def load_pool(spark: SparkSession, path: str) -> DataFrame:
    """The pool at path; an empty one where there is none. Rows without a vector go."""
    try:
        pool = spark.read.schema(POOL).parquet(path)
        pool.isEmpty()
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], POOL)
    return pool.where("embedding is not null")


def partner(pair: Column, speaker: Column) -> Column:
    """The other label of a pair key."""
    names = F.split(pair, "::")
    return F.when(names[1] == speaker, names[0]).otherwise(names[1])


def hard_candidates(pool: DataFrame, pairs: DataFrame, least_share: float = 0.55) -> DataFrame:
    """Windows of tracked pairs that were turned down as mixed, yet have one prevailing speaker: with pair, partner and the reason they are taken."""
    c = F.col
    rows = pool.withColumns({"speaker": F.trim("speaker"), "second_speaker": F.trim("second_speaker"), "dominant_share": F.coalesce("dominant_share", F.lit(0.0))})
    rows = rows.where(valid_label(c("speaker")) & valid_label(c("second_speaker")) & F.trim("rejection").isin(*HARD_REASONS) & (c("dominant_share") >= least_share))
    rows = rows.withColumn("pair", pair_key(c("speaker"), c("second_speaker"))).join(pairs.select("pair").distinct(), "pair", "left_semi")
    return rows.withColumns({"partner": partner(c("pair"), c("speaker")), "selection_reason": F.concat(F.lit("mixed_rejection_"), F.trim("rejection"))})


def hard_negatives(pool: DataFrame, weights: DataFrame, wanted: str, least_share: float = 0.55, per_pair: int = 20, style_target: int = 6, per_speaker: int | None = None, total: int = 0) -> DataFrame:
    """The chosen windows: candidates of weighted pairs, those of the wanted style first, within all caps.

    weights: pair, weight. row_id breaks ties.
    """
    rows = hard_candidates(pool, weights, least_share).join(weights.select("pair", "weight"), "pair")
    style = F.coalesce(F.col("style_profile") == wanted, F.lit(False))
    return capped(rows.withColumns({"is_style": style, "priority": F.when(style, 0).otherwise(1)}), per_pair, style_target, per_speaker, total)
