"""Corpus pipeline: quality rules, line dedup, near-dedup, decontamination and packing, each stage over all that the last one kept.

Edge cases: the stages take rows with null ids, repeated rows and ties as their operators state it. Null, empty and wordless texts fail the
quality rules and go. Texts of any length are read whole. An empty table gives an empty result with the columns of the bins. Further columns of
the documents, also of names that the operators use inside, pass through all stages but the last, which has columns of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from reelscribe.llm import decontaminate, line_dedup, line_rules, packing, simhash


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failed lines go; rejected documents go."""
    return line_rules.clean_documents(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shared lines stay in one document only."""
    return line_dedup.dedup_documents(docs)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return simhash.dedup_documents(docs)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All that is left, in bins."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", dedup_lines),
    ("simhash_near_dedup", dedup_near),
    ("benchmark_decontamination", decontaminate_benchmark),
    ("best_fit_packing", pack_bins),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
