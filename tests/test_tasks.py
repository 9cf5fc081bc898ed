"""Even tasks and one evaluation of payloads."""

import re

import pytest
from pyspark.sql import functions as F

from siteledger.plans import ingest
from siteledger.plans.tables import wide_table
from siteledger.sources.records import extract_records


def test_rows_of_one_row_group_are_dealt_to_all_tasks(spark, tmp_path):
    spark.range(20_000).withColumn("t", F.sha2(F.col("id").cast("string"), 256)).coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    size = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(size)
    spark.conf.set(size, "65536")  # many splits, of which one has all rows
    try:
        tasks = wide_table(spark, str(tmp_path), "orders").groupBy(F.spark_partition_id().alias("task")).count().collect()
    finally:
        spark.conf.set(size, before)
    assert sum(r["count"] for r in tasks) == 20_000
    assert max(r["count"] for r in tasks) <= 2 * 20_000 / spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("name", ["feature_since", "notice_window", "permit_array_since"])
def test_payloads_are_not_made_again_to_filter_them(spark, name):
    plan = ingest.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    filters = [line for line in plan.splitlines() if re.search(r"[+:]- Filter|^Filter", line)]
    assert not any(re.search("to_json|tojson|from_json|jsontostructs", line, re.I) for line in filters)


def test_only_objects_are_records(spark):
    responses = spark.createDataFrame([('[{"b": 1, "a": "x"}, [1], "{}", null, 3, {}]',)], "response string")
    assert [r[0] for r in extract_records(responses).collect()] == ['{"a":"x","b":1}', "{}"]
