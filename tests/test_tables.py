"""Tables in place of expressions: regions, rules, page directories, the discovery report."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from siteledger.functions import geo
from siteledger.operators import leads as L
from siteledger.operators import paging, regions, rule_table
from siteledger.operators import profile as P
from siteledger.sources import sinks


def test_pages_by_directory(spark, tmp_path):
    rows = spark.range(0, 1003).select((F.col("id") * 7919 % 1003).alias("k"), F.lit("x").alias("v"))
    directory = paging.write_directory(rows, [F.desc("k")], str(tmp_path / "d"), 7)
    assert directory.total == 1003 and directory.pages(50) == 21
    for number, want in ((1, range(1002, 952, -1)), (10, range(552, 502, -1)), (21, range(2, -1, -1)), (99, range(2, -1, -1)), (0, range(1002, 952, -1))):
        got = paging.read_page(spark, directory, number, 50).collect()
        assert [r["k"] for r in got] == list(want)
        assert [r["row_no"] for r in got] == [1002 - k for k in want]
    whole = paging.read_page(spark, directory, 1, 2000).collect()
    assert [r["k"] for r in whole] == list(range(1002, -1, -1))
    plan = paging.read_page(spark, directory, 10, 50)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*range_no", plan)
    empty = paging.write_directory(rows.where("false"), [F.desc("k")], str(tmp_path / "e"), 3)
    assert empty.total == 0 and empty.pages(50) == 1


def test_regions_as_a_table(spark):
    rnd = random.Random(5)
    given = [(f"r{i % 40}", "CA" if i % 3 else "NV", low := rnd.randrange(90000, 99000), low + rnd.randrange(-2, 300)) for i in range(1000)]
    given = [(r, "CA" if int(r[1:]) % 3 else "NV", a, b) for r, _, a, b in given] + [("r1", "CA", None, 5)]
    names = [("r7", "CA", "san jose"), ("r9", "NV", "reno"), ("r7", "CA", "san jose")]
    places = [(rnd.choice(["San Jose", " RENO.", None, "x"]), rnd.choice([None, "", str(rnd.randrange(89000, 99500))]), rnd.choice([None, "", "ca", "NV", "TX"])) for _ in range(300)]
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(places)], "id int, city string, zip string, state string").withColumn("region", F.lit("old"))
    got = regions.with_regions(rows, spark.createDataFrame(names, regions.CITY_SCHEMA), spark.createDataFrame(given, regions.RANGE_SCHEMA))
    want = set()
    for i, (city, code, state) in enumerate(places):
        for region in {r for r, *_ in given} | {"r7", "r9"}:
            home = "CA" if int(region[1:]) % 3 else "NV"
            home = {"r9": "NV"}.get(region, home)
            by_zip = code and any(a is not None and a <= int(code) <= b for r, s, a, b in given if r == region and (not state or s == state.upper()))
            by_city = city and any(r == region and c == re.sub("[^a-z0-9 ]", "", city.lower()).strip() and (not state or s == state.upper()) for r, s, c in names)
            if by_zip or by_city:
                want.add((i, region))
    assert sorted((r["id"], r["region"]) for r in got.collect()) == sorted(want)
    # The named regions give what the expression gives.
    cities, ranges = regions.named_regions(spark, {"bay_area": geo.NINE_COUNTY})
    by_table = {r["id"] for r in regions.with_regions(rows, cities, ranges).collect()}
    by_expression = {r["id"] for r in rows.where(geo.in_region(F.col("city"), F.col("zip"), F.col("state"), geo.NINE_COUNTY)).collect()}
    assert by_table == by_expression and by_table


def test_rules_as_a_table(spark):
    rnd = random.Random(3)
    words = ["street", "public", "works", "r&d", "ti", "lab", "café", "bar"]
    rules = [(i % 50, i, f"C{i % 50}", 0.5, " ".join(rnd.choice(words) for _ in range(rnd.randrange(1, 4)))) for i in range(200)]
    rules += [(0, 900, "BAD", 1.0, "-x"), (0, 901, "BAD", 1.0, ""), (51, 902, "UP", 0.7, "Kitchen")]
    texts = [None, "", "KITCHEN!", "kitchens", "r&d", "r & d", "public  works", "(public works)", "x_lab", "lab's"]
    texts += ["".join(rnd.choice(words + ["zz", "Zz"]) + rnd.choice([" ", ", ", "-"]) for _ in range(rnd.randrange(1, 6))) for _ in range(100)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, note string")
    table = spark.createDataFrame(rules, "rule_no int, phrase_no int, category string, confidence double, phrase string")
    got = {r["id"]: r for r in rule_table.classify_by_table(rows, ["id"], "note", table).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        hit = next((r for r in sorted(rules) if r[4] not in ("", "-x") and re.search(rf"\b{re.escape(r[4].lower())}\b", (text or "").lower())), None)
        assert got[i]["category"] == (hit[2] if hit else "OTHER"), text
        assert got[i]["reason"] == (rf"Matched \b{hit[4].lower()}\b" if hit else "No high-confidence rule matched")
    assert {r["category"] for r in rule_table.classify_by_table(rows, ["id"], "note", table.limit(0)).collect()} == {"OTHER"}
    sizes = [len(rule_table.classify_by_table(rows, ["id"], "note", table.limit(n))._jdf.queryExecution().optimizedPlan().toString().splitlines()) for n in (10, 200)]
    assert sizes[0] == sizes[1]


FINDING = ("city string, county string, source_kind string, title string, dataset_url string, api_url string, domain string, contractor_fields array<string>, "
           "owner_fields array<string>, sample_field_count long, latest_date string, notes array<string>")


def test_discovery_report(spark, tmp_path):
    rows = [
        ("Dublin", "Alameda", "ckan", "Permits", "u1", "a1", "d", ["contractor", "license_no"], ["owner"], 9, "2024-01-02", ["slow", "old"]),
        ("Dublin", "Alameda", "arcgis", "Zoning", "u2", None, "d", [], [], 3, None, []),
        ("Albany", None, "ckan", "Fees", "u3", "", "d", [], ["owner"], 2, "", None),
        (None, None, None, None, None, None, None, None, None, None, None, None),
    ]
    target = sinks.write_findings(spark.createDataFrame(rows, FINDING).repartition(3), str(tmp_path), "1")
    files = sorted((p for p in (tmp_path / "run=1" / "markdown").glob("part-*")), key=lambda p: p.name)
    assert "".join(p.read_text() for p in files) == (
        "# Source Discovery Report\n\n"
        "## \n_No contractor-shaped dataset found._\n- **** · no-contact-fields · \n\n"
        "## Albany\n_No contractor-shaped dataset found._\n- **ckan** · owner-only · Fees\n  - owner/applicant fields: owner\n\n"
        "## Dublin (Alameda)\n**Has contractor-shaped fields — promote to sources.yaml after manual review.**\n\n"
        "- **arcgis** · no-contact-fields · Zoning\n"
        "- **ckan** · candidate · Permits\n  - API: a1\n  - contractor fields: contractor, license_no\n  - owner/applicant fields: owner\n"
        "  - latest record date: 2024-01-02\n  - notes: slow; old\n\n"
    )
    verdicts = {r["title"]: r["verdict"] for r in spark.read.json(f"{target}/rows").collect()}
    assert verdicts == {"Permits": "candidate", "Zoning": "no-contact-fields", "Fees": "owner-only", None: "no-contact-fields"}
    lines = P.findings_lines(spark.createDataFrame([], FINDING))
    assert [r["line"] for r in lines.orderBy(*P.report_order()).collect()] == [P.REPORT_TITLE, ""]


def test_batches_by_id(spark):
    rows = spark.createDataFrame(
        [("a", "2", None, None, None, None, None), ("a", "1", None, None, "c", None, None), ("a", "3", "X", None, "c", "m", None), ("b", "0", "X", "d", None, None, None)],
        "source string, source_record_id string, category string, duplicate_of string, company_name string, email string, phone string",
    )
    ids = lambda df: [r["source_record_id"] for r in df.collect()]
    assert ids(L.unclassified(rows)) == ["1", "2"] and ids(L.unclassified(rows, 1)) == ["1"] and ids(L.unclassified(rows, 0)) == ["1", "2"]
    assert ids(L.enrichment_batch(rows)) == ["1", "2"] and ids(L.enrichment_batch(rows, 1)) == ["1"] and ids(L.enrichment_batch(rows, None, "X")) == []


def test_page_probe_keeps_pages_that_were_crawled_twice(spark, tmp_path):
    from siteledger.plans import enrichment

    rows = [(1, "http://acme.example.com/en/1?a=1", "<p>acme then a@b.com</p>"), (2, "http://acme.example.com/en/1?a=2", "<p>other</p>")]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    found = sorted(enrichment.page_probe(spark, str(tmp_path)).select("url", "email", "matches_company").collect(), key=str)
    assert [tuple(r) for r in found] == [("http://acme.example.com/en/1", "a@b.com", True), ("http://acme.example.com/en/1", None, False)]


def test_addresses_of_pages_are_computed_once(spark):
    """The filter on the normal address used to compute it again."""
    from siteledger.operators import enrich as E

    pages = spark.createDataFrame([("HTTP://A.com/x/?q=1", "a"), (None, "b"), (" b.com", "c")], "url string, html string")
    keyed = E.keyed_pages(pages)
    assert keyed._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 2
    assert sorted((r.page_url, r.html) for r in keyed.collect()) == [("http://a.com/x", "a"), ("https://b.com", "c")]


def test_runs_meet_phrases_unsorted(spark):
    """Runs are the many rows: they pass by the phrases without a sort, then rows are dealt by their own key."""
    rows = spark.createDataFrame([(k, "new roof and new deck") for k in range(20)], "id long, note string")
    rules = spark.createDataFrame([(1, 1, "ROOF", 0.9, "new roof"), (0, 2, "DECK", 0.8, "new deck")], "rule_no long, phrase_no long, category string, confidence double, phrase string")
    hits = rule_table.rule_hits(rows, ["id"], "note", rules)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"ShuffledHashJoin \[phrase", plan) and not re.search(r"SortMergeJoin \[phrase", plan)
    assert {(r["id"], r["category"]) for r in hits.collect()} == {(k, "DECK") for k in range(20)}
