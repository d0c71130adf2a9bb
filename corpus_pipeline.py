"""The corpus pipeline: language ID, quality, near duplicates, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what a stage
keeps is written as Parquet and read again as the next one's documents. All but
the last return the columns of documents.

Defined cases, on top of the operators' own: an empty table passes every stage.
Null, empty and blank texts hold no language and go in the first stage; null ids,
languages, sources and lengths stay as they are. Without labels every document
has quality 0.5 and stays. Of near duplicates the row with the smallest id stays
(null ids last), then that of the smallest hash of its text; equal rows are one;
different texts under one id are different documents. The mixing stage repeats
rows, so the last one meets equal ids and packs each row. Very long texts pass
whole. Columns beyond those of documents stay up to the last stage, also where
they are named like columns that operators add.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftline.llm import jaccard_join, language_id, mixing, packing, quality
from weftline.llm._common import materialize, table


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those that are no learned language; mixtures of any number of languages stay."""
    return language_id.keep_determined(docs, language_id.train(docs))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose quality is below 0.3."""
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near duplicates."""
    return jaccard_join.keep_one(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replicates documents to square-root-flattened source weights and shuffles them."""
    return mixing.replicate(docs).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs into sequences of at most 2048 tokens."""
    return packing.pack(docs)


STAGES = [
    ("language_id", language_stage),
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Learned models, similarity classes and tokenisation are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
