"""From raw documents to packed bins: each stage is one operator over all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from slicewright.llm import exact_dedup, jaccard_join, mixing, packing, quality_model
from slicewright.session import materialize, release, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return quality_model.keep_good(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for the case of A-Z, the one with the largest id."""
    return exact_dedup.dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by their 5-word shingles, at a similarity of 0.8 or more, the one with the smallest id."""
    return jaccard_join.keep_first(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the target weights of domains, languages and sources, once for each epoch that takes them."""
    return mixing.mix_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in bins, none with two documents of one source or text."""
    return packing.pack(docs)


STAGES = [("quality_classifier", quality), ("exact_dedup", exact), ("near_dedup", near), ("source_mixing", mixed), ("best_fit_packing", packed)]

#: A trained model and best-fit search are beyond SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result written and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name)
            release(spark)
    return docs
