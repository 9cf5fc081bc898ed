"""Ranges of a page directory follow the rows."""

from pyspark.sql import functions as F

from siteledger.operators import paging


def test_ranges_of_a_directory_follow_the_rows(spark, tmp_path):
    rows = spark.range(10_000).withColumn("key", F.sha2(F.col("id").cast("string"), 256))
    directory = paging.write_directory(rows, [F.col("key")], str(tmp_path), 4, rows_per_range=500)
    sizes = [r.n_rows for r in spark.read.parquet(f"{tmp_path}/directory").collect()]
    assert sum(sizes) == 10_000 and max(sizes) <= 1_500
    page = paging.read_page(spark, directory, 100, 50).collect()
    wanted = [r.id for r in rows.orderBy("key").collect()[4950:5000]]
    assert [r.id for r in page] == wanted and [r.row_no for r in page] == list(range(4950, 5000))
