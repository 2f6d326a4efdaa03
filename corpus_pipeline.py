"""A corpus pipeline of five stages, each a function (spark, docs, sf_dir) -> DataFrame.

Every stage works on what its predecessor wrote. All but the last return rows
of ``documents`` with all their columns; the last returns packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from runlens.llm import decontaminate, exact_dedup, jaccard_join, packing, toxicity
from runlens.llm.common import drop_scratch, scratch_path, scratch_tables, table
from runlens.llm.queries import vocabulary


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest id."""
    return exact_dedup.keep_first(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by 5-word shingles at a Jaccard similarity of 0.8, the one with the smallest id."""
    return jaccard_join.keep_one(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.keep_unmatched(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 ids, placed in sequences."""
    return packing.best_fit(docs, vocabulary("word_bpe_49k.json"), 0).drop("row")


STAGES = [
    ("toxicity", toxicity_filter),
    ("exact_dedup", exact_duplicates),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", benchmark_passages),
    ("best_fit_packing", packed),
]

#: SQL has no nearest-neighbour scores by trained terms and no tokenizer; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read again, and scratch tables go with their stage."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path, before = scratch_path(spark, name), scratch_tables(spark)
        stage(spark, docs, sf_dir).write.parquet(path)
        # What the stage kept for itself is no longer read.
        drop_scratch(spark, before)
        docs = spark.read.parquet(path)
    return docs
