"""Partitioning for work that is heavy per row."""

from __future__ import annotations

from pyspark.sql import DataFrame


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partitioned by ``keys`` for work that is heavy per row: the count follows the cores,
    because the bytes say little about the work and must not merge partitions."""
    spark = df.sparkSession
    count = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    return df.repartition(count, *keys)
