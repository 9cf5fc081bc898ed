"""Pages of a large ordered table: a directory of ranges turns a page number into a range and an offset.

The rows are written once in range partitions, each numbered from 0, with one directory row a range. A page then reads
the one range that holds it (two at a border), whatever its number: nothing is skipped row by row and no top-k grows with
the page. The number of ranges follows the rows, so that a range is what one task sorts and reads comfortably.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


ROWS_PER_RANGE = 1 << 18


@dataclass(frozen=True)
class Directory:
    """Where the ordered rows and their directory (range_no, first_row, n_rows) lie, and how many rows there are."""

    path: str
    total: int

    def pages(self, size: int) -> int:
        return max(1, -(-self.total // size))


def write_directory(rows: DataFrame, order: list[Column], path: str, ranges: int = 64, rows_per_range: int = ROWS_PER_RANGE) -> Directory:
    """Write ``rows`` by ``order``, which has to be total, as range partitions with positions, and their directory.

    There are at least ``ranges`` of them, and more where one would get over ``rows_per_range`` rows or so.
    """
    path = path.rstrip("/")
    ranges = max(ranges, -(-rows.count() // rows_per_range))
    # The low 33 bits of the running id are the row's place within its task, and a task is one range.
    placed = rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order).select(
        "*",
        F.spark_partition_id().alias("range_no"),
        F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("row_no"),
    )
    placed.write.partitionBy("range_no").parquet(f"{path}/rows")
    spark = rows.sparkSession
    schema = placed.schema
    written = spark.read.schema(schema).parquet(f"{path}/rows")
    counted = written.groupBy("range_no").agg(F.count("*").alias("n_rows"))
    # One row a range: the window sees as many rows as there are ranges.
    before = Window.orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    counted.withColumn("first_row", F.coalesce(F.sum("n_rows").over(before), F.lit(0))).write.parquet(f"{path}/directory")
    total = spark.read.parquet(f"{path}/directory").agg(F.coalesce(F.sum("n_rows"), F.lit(0))).first()[0]
    return Directory(path, total)


def read_page(spark: SparkSession, directory: Directory, number: int, size: int = 50) -> DataFrame:
    """One page in order, with ``row_no`` counted from 0 over all rows; a number past either end gives the first or last page."""
    start = (min(max(1, number), directory.pages(size)) - 1) * size
    entries = spark.read.schema("range_no int, n_rows long, first_row long").parquet(f"{directory.path}/directory")
    # Ranges hold rows, so no more than ``size`` of them meet a page.
    met = entries.where((F.col("first_row") < start + size) & (F.col("first_row") + F.col("n_rows") > start)).collect()
    first = {r["range_no"]: r["first_row"] for r in met}
    rows = spark.read.parquet(f"{directory.path}/rows")
    if not first:
        return rows.where("false").drop("range_no")
    wanted = F.lit(False)
    for range_no, first_row in first.items():
        place = F.col("row_no").between(start - first_row, start + size - 1 - first_row)
        wanted = wanted | ((F.col("range_no") == range_no) & place)
    offset = F.element_at(F.create_map(*[F.lit(x) for pair in first.items() for x in pair]), F.col("range_no"))
    found = rows.where(F.col("range_no").isin(*first) & wanted)
    return found.withColumn("row_no", F.col("row_no") + offset).drop("range_no").orderBy("row_no")
