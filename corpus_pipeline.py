"""The corpus pipeline: documents through the stages, in this order.

Each stage takes all that the one before kept, and returns it with its columns as they were, whatever their names, less
what it drops. Defined results for odd rows, stage by stage: a document without letters (null and empty texts too) has no
language and goes first; of texts that are equal, or nearly, the one with the least id stays, a null id after all others;
repeated rows are copies of each other; a null source is a source of its own. An empty table goes through empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from assaykit.llm import decontaminate, exact_dedup, langid, mixing, near_dedup
from assaykit.llm.exchange import materialise


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without what the classifier, fitted to the documents' own labels, is not sure of; without labels nothing stays."""
    return langid.keep_identified(docs)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text."""
    return exact_dedup.drop_exact_duplicates(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return near_dedup.drop_near_duplicates(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that hold a passage of the benchmark; an empty benchmark drops nothing."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Half of the tokens, the same weight for every source."""
    return mixing.keep_mixture(docs)


STAGES = [("language_id", identified), ("exact_dedup", without_copies), ("near_dedup", without_near_copies), ("decontaminate", without_benchmark), ("mixing", mixed)]

#: The classifier and the random draw have no SQL; tests hold each stage and run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents; what each keeps is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs, name)
    return docs
