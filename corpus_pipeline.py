"""The corpus pipeline: quality rules, toxicity, near duplicates, mixing, packing.

Each stage gets what its predecessor kept, as a table, and is written before the next one reads it. Quality, toxicity and mixing decide in
the pass that reads the texts, and near duplicates leaves the others out by their ids: no stage shuffles texts, unless
more ids are to be left out than may be broadcast.

Defined cases, in every stage: null and empty texts are documents without words (quality rejects them if its rules say so); rows with a null doc_id are judged
by their text, link with nothing and stay; repeated rows are decided alike, each for itself; empty tables give no rows, with the same columns; further
columns, whatever their names, go through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm.common import materialize, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the certified cutoffs; being short or repetitive is certified like all else, which bounds what is lost of good ones."""
    from parlance.llm.quality import keep_good

    return keep_good(docs, table(spark, sf_dir, "labels"))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold."""
    from parlance.llm.toxicity import drop_toxic

    return drop_toxic(docs, table(spark, sf_dir, "labels"), F.lit(False))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five words, similarity 0.8."""
    from parlance.llm.jaccard import one_of_each

    return one_of_each(docs, 5, 80)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that the domains' tokens meet the target weights."""
    from parlance.llm.mixing import mix

    return mix(docs, table(spark, sf_dir, "labels"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 2048 tokens."""
    import public_tokenizers

    from parlance.llm.packing import pack_documents

    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [("quality", quality), ("toxicity", toxicity), ("near_duplicates", near_duplicates), ("mixing", mixing), ("packing", packing)]

#: No SQL expresses signatures, learned cutoffs and packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs
