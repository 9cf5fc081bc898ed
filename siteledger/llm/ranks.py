"""Gapless ranks and shares over a whole table without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET_ROWS = 1 << 20


def ranked(df: DataFrame, keys: list[str], bucket: Column, order: list[Column], name: str = "rank") -> DataFrame:
    """``df`` with a rank from 0 within ``keys``, by ``bucket`` and then by ``order``.

    Rows are counted by bucket and the counts added up, so a window sees the rows of one bucket only. ``df`` is read
    twice and has to be the same both times (a written table). NULL keys are a key of their own.
    """
    marked = df.withColumn("_bucket", bucket)
    own = [*keys, "_bucket"]
    counts = marked.groupBy(*own).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_bucket").alias("_of"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    same = F.col("_bucket").eqNullSafe(F.col("_of"))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    within = F.row_number().over(Window.partitionBy(*own).orderBy(*order)) - 1
    placed = marked.withColumn("_within", within).join(offsets, same)
    return placed.select(*df.columns, (F.col("_offset") + F.col("_within")).alias(name))


def bucket_count(rows: int, least: int = 64) -> int:
    """So many buckets that each has about ``BUCKET_ROWS`` rows at most."""
    return max(least, -(-rows // BUCKET_ROWS))


def hashed(column: str, buckets: int, salt: int = 0) -> Column:
    return F.pmod(F.xxhash64(F.lit(salt), column), F.lit(buckets))
