"""A corpus in five stages: language ID, exact dedup, near-duplicate join, mixing, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of documents. run() writes what a stage returns as Parquet in the shared folder and reads it again for
the next one. Each stage has the null, tie and empty cases that its operator's module states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from orbweave.llm.common import shared_folder
from orbweave.llm.exact_dedup import exact_dedup
from orbweave.llm.langid import keep_identified
from orbweave.llm.mixing import mix
from orbweave.llm.ngram_join import keep_one
from orbweave.llm.packing import pack


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or without a main language, go."""
    return keep_identified(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of links one document stays."""
    return keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are left out or repeated until sources have their weights."""
    return mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document, and its place in a sequence."""
    return pack(docs)


STAGES = [
    ("language_id", identify_language), ("exact_dedup", drop_copies), ("ngram_join", drop_near_copies),
    ("mix_sources", mix_sources), ("best_fit_packing", pack_sequences),
]

#: SQL can express neither the language model nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = shared_folder(spark, "pipeline")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
