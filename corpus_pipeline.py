"""The corpus pipeline: language ID, near duplicates, repeated passages, benchmark passages, mixing.

Each stage gets what its predecessor kept, written as Parquet and read again. All stages but the last return the
columns of ``documents``; other columns that ``documents`` may have pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteledger.llm import decontaminate, jaccard, language, mixing, suffix_dedup
from siteledger.session import scratch_path


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the models recognise; texts without letters, NULL or foreign to all models go."""
    model = language.fit(docs, ~language.held_out(3, 1))
    return language.recognised(docs, model)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each near-duplicate group; documents without doc_id all stay."""
    return jaccard.representatives(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that earlier documents hold; a document of which nothing is left goes.

    n_chars is that of the new text. A character goes if all its bytes do.
    """
    return suffix_dedup.rewritten(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of a benchmark item."""
    return decontaminate.without_overlaps(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes: a row for each document of which it takes words."""
    return mixing.mix(docs).where("taken > 0")


STAGES = [
    ("language ID", known_language),
    ("n-gram Jaccard join", one_of_each_group),
    ("suffix-array dedup", without_repeats),
    ("benchmark decontamination", without_benchmark),
    ("mixing to target weights", mixed),
]
#: Models, near-duplicate groups and seeded blocks are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
