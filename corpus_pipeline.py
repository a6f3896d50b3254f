"""Corpus pipeline: quality rules, language ID, near-duplicate join, mixing and packing.

Each stage takes what its predecessor kept and returns documents with the same
columns; the last returns the packed pieces. run() writes every stage's result
as Parquet to the cluster's shared folder and rereads it, so a stage is computed
once. The stages set the session's Arrow batches to 8 MB, unless it has a size of
its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scrivane.llm import jaccard, language, mixing, packing, quality
from scrivane.llm._kit import lean_batches, stored, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the quality model, which is trained on the labels."""
    lean_batches(spark)
    return quality.keep_quality(docs, table(spark, sf_dir, "labels"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with one main language."""
    lean_batches(spark)
    return language.keep_language(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    lean_batches(spark)
    return jaccard.keep_one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' words at the sources' target weights, whole documents or runs of their words."""
    lean_batches(spark)
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    lean_batches(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("language ID", language_id),
    ("n-gram Jaccard join", jaccard_join),
    ("mixing sources to target weights", mix),
    ("packing", pack),
]

#: The trained stages, the permutations and the tokeniser are beyond SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stored(docs)
    return docs
