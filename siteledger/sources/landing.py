"""Landed responses of all sources in one table, by source and landing day, and what a run reads of it.

The day a response landed on is a partition, so a run that starts where the last one ended opens only the folders after
it, and the other sources' folders never: ``since`` is a filter of the scan, not of parsed records. A stream over the same
table keeps its place in its checkpoint.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siteledger.config import SourceConfig
from siteledger.operators.normalize import normalize
from siteledger.sources.records import read_source, union_sources

SCHEMA = "response string, source string, day date"


def land(responses: DataFrame, path: str, source: str, day: Column) -> None:
    """Append ``responses`` (response) of one source to the table at ``path``."""
    rows = responses.select("response", F.lit(source).alias("source"), day.cast("date").alias("day"))
    rows.write.mode("append").partitionBy("source", "day").parquet(path)


def landed(spark: SparkSession, path: str, source: str, after: str | None = None) -> DataFrame:
    """Responses of one source that landed after the day ``after`` (all without one), with their ``day``."""
    rows = spark.read.schema(SCHEMA).parquet(path).where(F.col("source") == source)
    return (rows.where(F.col("day") > F.lit(after).cast("date")) if after else rows).select("response", "day")


def landed_stream(spark: SparkSession, path: str, files_per_batch: int | None = None, source: str | None = None) -> DataFrame:
    """The table as a stream of (response, source, day); a restart from its checkpoint reads new files only.

    Of one ``source`` only its own folder is listed.
    """
    reader = spark.readStream.schema(SCHEMA if source is None else "response string, day date")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if source is None:
        return reader.parquet(path)
    return reader.parquet(f"{path}/{folder(spark, source)}").select("response", F.lit(source).alias("source"), "day")


def folder(spark: SparkSession, source: str) -> str:
    """The folder of one source, named as Spark names it."""
    names = spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
    return f"source={names.escapePathName(source)}"


def has_landed(spark: SparkSession, path: str, source: str) -> bool:
    """Whether anything of ``source`` ever landed."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{folder(spark, source)}")
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def watermarks(spark: SparkSession, path: str) -> DataFrame:
    """(source, day): the last day that each source landed on, from partition values alone."""
    return spark.read.schema(SCHEMA).parquet(path).groupBy("source").agg(F.max("day").alias("day"))


def read_projects(
    spark: SparkSession,
    path: str,
    configs: Mapping[str, SourceConfig],
    after: Mapping[str, str] | None = None,
    inputs: Mapping[str, Mapping[str, DataFrame]] | None = None,
) -> DataFrame:
    """Every configured source read by the reader of its kind and mapped to one project table.

    ``after`` gives the day a source was read up to, ``inputs`` further tables of its reader (contacts, details).
    """
    parts = []
    for name, cfg in configs.items():
        responses = landed(spark, path, name, (after or {}).get(name))
        parts.append(normalize(read_source(name, cfg, responses, **(inputs or {}).get(name, {})), cfg))
    return union_sources(parts)
