"""Code of a step that the JVM compiles, and what it computes."""

import re

from pyspark.sql import functions as F

from siteledger.functions.text import strip
from siteledger.operators.contacts import permit_contacts


def test_contact_code_is_small_enough_for_the_jvm_to_compile(spark):
    names = ["permit_number", "role", "first_name", "last_name", "firm_name", "license1", "license2", "line"]
    rows = spark.range(100).select(*[F.col("id").cast("string").alias(n) for n in names])
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else the code is made only when the query runs
    try:
        plan = permit_contacts(rows, "permit_number", "line")._jdf.queryExecution()
        text = spark._jvm.PythonSQLUtils.explainString(plan, "codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", text)]
    assert sizes and max(sizes) < 8000


def test_strip_removes_every_kind_of_space_at_both_ends_only(spark):
    texts = ["", " \t\n", " a b\x85", "a\r\n", "　 x \n", "\x1cq\x1f", "\x00 z"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(strip(F.col("t"))).collect()]
    assert got == ["", "", "a b", "a", "x", "q", "\x00 z"]
