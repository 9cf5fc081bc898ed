"""Where results go: one run folder each, and a pointer to the newest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteledger.operators import leads as L
from siteledger.operators import profile as P
from siteledger.session import cut


def write_export(rows: DataFrame, path: str, run: str, formats: tuple[str, ...] = ("parquet",)) -> str:
    """Export rows split by sheet below ``path/run=<run>``, one folder per sheet.

    A large sheet is written by as many tasks as produced it.
    """
    target = f"{path.rstrip('/')}/run={run}"
    for kind in formats:
        if kind == "csv":
            named = rows.select("sheet", *[F.col(c).alias(h) for c, h in L.EXPORT_HEADINGS.items()])
            named.write.mode("overwrite").option("header", True).partitionBy("sheet").csv(f"{target}/csv")
        else:
            rows.write.mode("overwrite").partitionBy("sheet").format(kind).save(f"{target}/{kind}")
    return target


def write_web_document(web: DataFrame, path: str, run: str, today: str, window_days: int = 7) -> str:
    """The viewer document: leads as JSON lines in their order, facets as small tables from one pass over the leads."""
    target = f"{path.rstrip('/')}/run={run}"
    L.new_first(web).write.mode("overwrite").json(f"{target}/leads")
    found = cut(L.web_facets(web))
    of = lambda kind: found.where(F.col("kind") == kind)
    facets = {
        "totals": of("total").select(F.col("n").alias("total"), "with_contact", F.col("n_new").alias("new_count"), F.lit(today).alias("generated_at"), F.lit(window_days).alias("new_window_days")),
        "categories": of("category").select(F.col("key").alias("category"), "n", "n_new").orderBy("category"),
        "weeks": of("week").select(F.col("key").alias("week"), "label", "monday", "n").orderBy(F.desc("monday")),
        "cities": of("city").select(F.col("key").alias("city")).orderBy("city"),
    }
    for name, frame in facets.items():
        frame.write.mode("overwrite").json(f"{target}/{name}")
    return target


def write_findings(findings: DataFrame, path: str, run: str) -> str:
    """The discovery report: markdown lines in order, part files by name, and the findings as JSON rows."""
    target = f"{path.rstrip('/')}/run={run}"
    P.findings_lines(findings).orderBy(*P.report_order()).select("line").write.mode("overwrite").text(f"{target}/markdown")
    P.findings_rows(findings).write.mode("overwrite").option("ignoreNullFields", "false").json(f"{target}/rows")
    return target


def point_latest(spark, path: str, run: str) -> None:
    """Record ``run`` as the newest one under ``path``; readers follow ``latest``."""
    spark.createDataFrame([(run,)], "run string").coalesce(1).write.mode("overwrite").json(f"{path.rstrip('/')}/latest")


def latest_run(spark, path: str) -> str:
    return spark.read.schema("run string").json(f"{path.rstrip('/')}/latest").first()["run"]
