"""What a Python worker holds does not grow with the table."""

from pyspark.sql import functions as F

from siteledger.functions.html import page_parts


def test_pages_reach_python_in_small_batches(spark):
    pages = spark.createDataFrame([("<a href='/contact'>c</a> hi", "https://x.org/"), (None, None)], "html string, url string")
    parsed = pages.select(page_parts(F.col("html"), F.col("url")).alias("p"))
    assert "ArrowEvalPython" not in parsed._jdf.queryExecution().executedPlan().toString()
    first, none = [r.p for r in parsed.collect()]
    assert (first.text, first.hrefs, first.links) == ("c  hi", ["/contact"], ["https://x.org/contact"])
    assert (none.text, none.hrefs, none.links) == ("", [], [])
