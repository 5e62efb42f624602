"""The corpus pipeline: quality classifier, language identification, near-duplicate removal and packing, in this order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from emberlog.llm import importance, language, packing, simhash
from emberlog.llm.common import stored, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Importance resampling towards the documents labelled good; rows that are not drawn go."""
    return importance.keep_resampled(docs, importance.good(table(spark, sf_dir, "labels")))


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language identification; rows without letters, or without a clear language, go."""
    return language.keep_identified(docs, language.train(docs))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-duplicates over five-word shingles at a similarity of 0.8; one row of each group stays."""
    return simhash.drop_near_copies(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cost-balanced packing of what is left, one row a piece."""
    return packing.pack_documents(docs, packing.vocabulary_path(), with_ids=False)


#: (name, function) of each stage; a function takes (spark, docs, sf_dir) and reads what the one before it kept.
STAGES = [("quality", keep_quality), ("language", keep_languages), ("near_duplicates", drop_copies), ("packing", pack)]
#: SQL has no hashed n-gram models, trained networks or tokenizers; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each one's result is written and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs if not k else stored(docs, name), sf_dir)
    return docs
