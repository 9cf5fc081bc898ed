from __future__ import annotations

from pyspark.sql import functions as F

from siteledger.operators import leads as L
from siteledger.operators import profile as P
from siteledger.sources import sinks

SCHEMA = ("source string, source_record_id string, company_name string, category string, city string, county string, address string, description string, "
          "email string, phone string, project_date string, bid_deadline string, first_seen string, source_url string, license_number string, duplicate_of string")


def lead(i, **values):
    base = dict.fromkeys([c.split()[0] for c in SCHEMA.split(", ")])
    base.update(source="permits", source_record_id=str(i), **values)
    return tuple(base.values())


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def test_report(spark):
    rows = frame(
        spark,
        lead(1, category="OFFICE_LAB", email="a@b.co", license_number="1", first_seen="2026-05-28T01:00:00"),
        lead(2, category="", phone="", email="", first_seen="2026-05-01"),
        tuple(["samgov-x" if k == 0 else v for k, v in enumerate(lead(3, phone="(1)", category="OFFICE_LAB"))]),
    )
    got = L.lead_report(rows, "2026-05-28").first().asDict()
    assert got == {"total": 3, "with_contact": 2, "pending": 1, "new_today": 1, "rfp_leads": 1, "high_value": 2, "coverage": 2 / 3}
    assert L.lead_report(rows.where("false"), "2026-05-28").first()["coverage"] == 0.0
    assert [(r["category"], r["total"], r["with_contact"]) for r in L.category_coverage(rows).collect()] == [("OFFICE_LAB", 2, 2), ("OTHER", 1, 0)]
    lines = [r["line"] for r in L.report_lines(L.lead_report(rows, "2026-05-28")).orderBy("line_no").collect()]
    assert lines[0] == "线索总数：3（有联系方式 2，覆盖率 67%）" and len(lines) == 5
    assert "boom" in L.failure_lines(spark, "boom").first()["line"]


def test_web_document(spark, tmp_path):
    rows = frame(
        spark,
        lead(1, category="OFFICE_LAB", email="a@b.co", first_seen="2026-06-17T01:00:00", city="Napa", description="x" * 400),
        lead(2, category="OTHER", first_seen="2026-05-01", city="", project_date="2026-05-02"),
    )
    web = L.web_leads(rows, "2026-06-18", 7)
    assert tuple(L.web_totals(web).first()) == (2, 1, 1)
    assert [r["week"] for r in L.week_cohorts(web).collect()] == ["2026-W25", "2026-W18"]
    assert [r["source_record_id"] for r in L.new_first(web).collect()] == ["1", "2"]
    assert [r["city"] for r in L.cities(web).collect()] == ["Napa"]
    assert L.latest_week(web).count() == 1 and L.last_page(web) == 1
    found = L.search(web, contact=True, query="XXX").first()["desc"]
    assert len(found) > 300 and len(L.web_leads(rows, "2026-06-18", 7, 300).where(F.length("desc") > 300).first()["desc"]) == 301
    assert L.page(web, 99).count() == L.page(web, 0).count() == 2
    path = sinks.write_web_document(web, str(tmp_path), "r1", "2026-06-18")
    assert spark.read.json(f"{path}/leads").count() == 2 and spark.read.json(f"{path}/totals").first()["new_count"] == 1


def test_export(spark, tmp_path):
    rows = frame(
        spark,
        lead(1, category="OFFICE_LAB", email="a@b.co", project_date="2026-06-01", bid_deadline="2026-07-01"),
        lead(2, category="OFFICE_LAB", project_date="06/02/2026"),
        lead(3, category="OTHER", phone="x", project_date="2020-01-01"),
        lead(4, category=None, phone="x", project_date=None),
    )
    out = L.export_rows(L.in_window(rows, "2026-06-18", 90))
    assert tuple(L.export_stats(out).first()) == (3, 2, 1)
    path = sinks.write_export(out, str(tmp_path / "x"), "r1", ("parquet", "csv"))
    assert {r["sheet"] for r in spark.read.parquet(f"{path}/parquet").collect()} == {"OFFICE_LAB", "OTHER", "PENDING"}
    assert "公司名" in spark.read.option("header", True).csv(f"{path}/csv").columns
    sinks.point_latest(spark, str(tmp_path / "x"), "r1")
    assert sinks.latest_run(spark, str(tmp_path / "x")) == "r1"


def test_profiles(spark):
    cols = [("d1", "ContractorName"), ("d1", "Contractor_License"), ("d1", "Address"), ("d2", "OwnerName"), ("d2", "ProjectName"), ("d3", "Address")]
    got = {r["dataset"]: r for r in P.dataset_verdicts(spark.createDataFrame(cols, "dataset string, column string")).collect()}
    assert {k: r["verdict"] for k, r in got.items()} == {"d1": "candidate", "d2": "owner-only", "d3": "no-contact-fields"}
    assert got["d1"]["contractor_fields"] == "ContractorName,Contractor_License"
    df = spark.createDataFrame([("San Jose", "data.sanjoseca building permits"), ("Saratoga", "NY permits")], "c string, t string")
    assert [r[0] for r in df.select(P.is_relevant(F.col("c"), F.col("t"))).collect()] == [True, False]


def test_verdicts_do_not_depend_on_the_batch(spark):
    """One failing text loses its own verdict only, whatever the size of the batches."""
    import pandas as pd

    from siteledger.operators.classify import refine_other

    def judge(texts):
        if (texts == "bad 7").any():
            raise ValueError
        return pd.DataFrame({"category": "JUDGED", "confidence": 0.5, "reason": "r"}, index=texts.index)

    rows = spark.range(100).selectExpr(
        "'s' AS source", "CAST(id AS STRING) AS source_record_id", "concat('bad ', id) AS description", "'OTHER' AS category", "0.1D AS confidence", "'x' AS reason"
    )
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(name)
    for size in ("10", "4096"):
        spark.conf.set(name, size)
        got = {r.source_record_id: (r.category, r.confidence) for r in refine_other(rows, judge).collect()}
        assert got == {str(i): ("OTHER", 0.1) if i == 7 else ("JUDGED", 0.5) for i in range(100)}
    spark.conf.set(name, old)


def test_newest_sighting_wins(spark):
    from siteledger.operators.upsert import consolidate_companies

    rows = spark.createDataFrame(
        [("a", "A", "9", "old", None), ("a", "A", "10", "new", None), ("b", "B", "10", "late", "2026-02-01"), ("b", "B", "11", "early", "2026-01-01")],
        "company_key string, name string, source_record_id string, phone string, at string",
    ).selectExpr("*", "CAST(at AS TIMESTAMP) AS fetched_at", "'s' AS source", "CAST(NULL AS STRING) AS license_number", "CAST(NULL AS STRING) AS website", "CAST(NULL AS STRING) AS email")
    assert {r.company_key: r.phone for r in consolidate_companies(rows).collect()} == {"a": "new", "b": "late"}


def test_freshness_compares_days(spark):
    from siteledger.operators.profile import freshness

    rows = spark.createDataFrame([("x", "9/1/2025", None), ("x", "10/1/2025", "z"), ("y", "soon", "999000000000"), ("y", None, "1000000000000")], "k string, issue_date string, received_date string")
    assert {r.k: r.latest_date for r in freshness(rows, ["k"]).collect()} == {"x": "10/1/2025", "y": "1000000000000"}


def test_links_of_a_page():
    from siteledger.functions.html import parse_page

    html = "<noscript><a href='mailto:a@b.com'>x</a></noscript>" + "".join(f"<a href='https://Site.com/contact{i}'>c</a>" for i in range(9))
    page = parse_page(html, "HTTPS://site.com/", ("contact",))
    assert page["links"] == [f"https://site.com/contact{i}" for i in range(9)] and page["hrefs"][0] == "mailto:a@b.com"


def test_only_wanted_pages_are_parsed(spark):
    from siteledger.operators import enrich as E

    firms = spark.createDataFrame([("a", "Alpha Beta, Inc.", "HTTPS://Site.com/"), ("b", "Gamma Delta LLC", None)], "company_key string, name string, website string")
    crawl = spark.createDataFrame(
        [
            ("https://SITE.com", "<a href='https://Site.com/contact/team'>t</a>", "2026-01-02"),
            ("https://site.com/", "<p>old and longer text of the same page</p>", "2026-01-01"),
            ("https://site.com/contact/team", "<p>write to desk@site.com</p>", None),
            ("https://gammadelta.com", "<p>gamma delta</p>", None),
            ("https://unwanted.com", "<p>x@y.com</p>", None),
        ],
        "url string, html string, fetched_at string",
    )
    assert {r.page_url for r in E.wanted_pages(firms, crawl).collect()} == {"https://site.com", "https://site.com/contact/team", "https://gammadelta.com"}
    got = {r.company_key: (r.status, r.email, r.website) for r in E.web_result(firms, crawl).collect()}
    assert got == {"a": ("updated", "desk@site.com", "https://site.com"), "b": ("not_found", None, None)}
