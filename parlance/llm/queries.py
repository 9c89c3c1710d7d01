"""The queries opN_<name> and their SQL, where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from parlance.llm.common import table


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from parlance.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parlance.llm.jaccard import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"), 4, 85).select("doc_id", "n_shingles", "component_id")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parlance.llm.mixing import mixing_rates

    return mixing_rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parlance.llm.quality import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parlance.llm.warc import archive_round_trip

    return archive_round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parlance.llm.extract import main_text

    return main_text(table(spark, sf_dir, "pages"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parlance.llm.urls import filter_urls, production_list

    return filter_urls(table(spark, sf_dir, "pages"), production_list(spark))


def op8_ppm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from parlance.llm.ppm import fold_remainder, score_documents

    return score_documents(table(spark, sf_dir, "documents"), fold_remainder(F.col("doc_id"), 7) == 2)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from parlance.llm.ppm import fold_remainder
    from parlance.llm.toxicity import score_toxicity

    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), fold_remainder(F.col("doc_id"), 4) == 2)


def op10_embedding_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parlance.llm.embeddings import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op11_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parlance.llm.infill import infill_digests

    return infill_digests(table(spark, sf_dir, "documents"))


def op12_slot_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parlance.llm.sharding import sharded

    return sharded(table(spark, sf_dir, "documents"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parlance.llm.centroids import clustered

    return clustered(table(spark, sf_dir, "embeddings")).drop("tried")


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    from parlance.llm import oracles

    return {k: v for k, v in oracles.SQL.items()}
