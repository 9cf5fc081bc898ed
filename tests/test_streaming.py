"""Late rows are counted, an unbounded delay drops nothing, html never moves."""

from __future__ import annotations

import datetime as dt
import json
import re

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from siteledger import config as C
from siteledger.operators import page_filter
from siteledger.operators import leads as L
from siteledger.session import cut, scratch_path
from siteledger.sources import landing
from siteledger.streaming import cohorts, keyed_state


@pytest.mark.parametrize(("delay", "late"), [(None, 0), ("7 days", 3)])
def test_late_rows_are_counted(spark, delay, late):
    root, day = scratch_path(spark, "late"), dt.datetime(2026, 6, 1)
    deliveries = [[30, 31, 40], [41, None, 42], [1, 2, 3, 36, 41]]
    for number, days in enumerate(deliveries):
        rows = [(day + dt.timedelta(days=d) if d is not None else None, "x") for d in days]
        spark.createDataFrame(rows, "ts timestamp, kind string").coalesce(1).write.parquet(f"{root}/in/{number}")
        stream = spark.readStream.schema("ts timestamp, kind string").parquet(f"{root}/in/*")
        found = cohorts.run_weekly_counts(spark, stream, "ts", ["kind"], f"{root}/state", delay)
    assert (found.arrived, found.late) == (10, late)
    assert found.counts.agg(F.sum("n")).first()[0] == 10 - late
    again = cohorts.run_weekly_counts(spark, stream, "ts", ["kind"], f"{root}/state", delay)
    assert (again.arrived, again.late) == (10, late)


def test_page_filter_keeps_all_wanted_and_few_others(spark):
    pages = spark.range(20_000).select(F.concat(F.lit("https://c"), "id", F.lit(".com")).alias("page_url"), F.repeat(F.lit("x"), 50).alias("html"))
    wanted = cut(pages.where("page_url LIKE '%7.com'").select("page_url"))
    got = page_filter.possibly_wanted(pages, wanted)
    assert got.join(wanted, "page_url", "left_semi").count() == 2000
    assert got.count() < 2100
    assert page_filter.possibly_wanted(pages, wanted.limit(0)).count() == 0
    # However few bits there are, no wanted page is lost.
    assert page_filter.possibly_wanted(pages, wanted, most_bits=1024).join(wanted, "page_url", "left_semi").count() == 2000


def test_html_is_never_shuffled(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        path = scratch_path(spark, "crawl")
        spark.range(100).select(F.concat(F.lit("https://c"), "id", F.lit(".com")).alias("page_url"), F.lit("<p>x</p>").alias("html")).write.parquet(path)
        pages = spark.read.parquet(path)
        plan = page_filter.possibly_wanted(pages, cut(pages.select("page_url").limit(5)))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    outer = plan.split("BroadcastExchange")[0]
    assert "BroadcastNestedLoopJoin" in outer and not re.search(r"Exchange (hash|round|single)", outer)


def test_facets_read_the_leads_once(spark, tmp_path):
    path = str(tmp_path / "leads")
    columns = "category string, week string, week_label string, week_start string, city string, is_new boolean, email string, phone string"
    rows = [("A", "w1", "1", "m1", "x", True, "e", ""), ("A", "w2", "2", "m2", "", False, "", ""), ("B", "w1", "1", "m1", "y", None, "", "p")]
    spark.createDataFrame(rows, columns).write.parquet(path)
    facets = L.web_facets(spark.read.parquet(path))
    assert facets._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    got = {(r.kind, r.key): (r.n, r.n_new, r.with_contact) for r in facets.collect()}
    assert got == {
        ("total", None): (3, 1, 2), ("category", "A"): (2, 1, 1), ("category", "B"): (1, 0, 1), ("week", "w1"): (2, 1, 2), ("week", "w2"): (1, 0, 0),
        ("city", "x"): (1, 1, 1), ("city", "y"): (1, 0, 1),
    }


def _config(kind, name, **more):
    fields = C.FieldMap(record_id="id", permit_number="id", description=("what",), address=("where",), project_date=("day",), company_name="who", company_phone="tel")
    return C.SourceConfig(type=kind, name=name, jurisdiction="Lake City", field_map=fields, **more)


def test_state_costs_what_a_delivery_brings(spark):
    root = scratch_path(spark, "state")
    configs = {"a b": _config(C.PERMIT_ARRAY, "a b"), "portal": _config(C.PORTAL, "portal", record_path="items"), "silent": _config(C.PORTAL, "silent")}

    def deliver(day, source, *records):
        bodies = [json.dumps([r] if source == "a b" else {"items": [r]}) for r in records]
        landing.land(spark.createDataFrame([(b,) for b in bodies], "response string").coalesce(1), f"{root}/in", source, F.lit(day))

    def run(day):
        keyed_state.run_sources(spark, f"{root}/in", configs, f"{root}/out", F.lit(day).cast("timestamp"))

    def record(number, what, **more):
        return {"id": number, "what": what, "where": f"{number} Main", "day": "2001-07-01"} | more

    def written():
        rows = spark.read.parquet(f"{root}/out/records/*/*").collect()
        return sorted((str(r.last_seen.date()), r.source, r.source_record_id, r.revision, r.changed, r.payload is not None) for r in rows)

    def category(**options):
        return keyed_state.projects_table(spark, f"{root}/out", **options).where("source_record_id = '3' AND source = 'a b'").first().category

    # A key that most rows of a delivery carry is one row of the log.
    deliver("2001-07-01", "a b", *[record(1, f"office {k}") for k in range(300)], record(2, "hotel", who="Ann Co", tel="415-555-1234"), record(3, "shop"))
    run("2001-07-01")
    first = written()
    assert [r[1:] for r in first] == [("a b", k, 1, True, True) for k in ("1", "2", "3")]
    run("2001-07-01")
    assert written() == first
    shop = category()
    # Content that stays is a sighting without values, content that changes a revision; another source comes.
    deliver("2001-07-02", "a b", record(2, "hotel", who="Ann Co", tel="415-555-1234"), record(3, "restaurant"))
    deliver("2001-07-02", "portal", record(3, "office", who="Ann Co"))
    run("2001-07-02")
    second = [r[1:] for r in written() if r[0] == "2001-07-02"]
    assert second == [("a b", "2", 1, False, False), ("a b", "3", 2, True, True), ("portal", "3", 1, True, True)]
    # A changed project keeps its category unless asked otherwise.
    assert category() == shop != category(reclassify_changed=True) == "RESTAURANT_RETAIL"
    # Content that returns is a revision as well.
    deliver("2001-07-03", "a b", record(3, "shop"))
    run("2001-07-03")
    known = {(r.source, r.source_record_id): r for r in keyed_state.records_table(spark, f"{root}/out").collect()}
    assert {k: (r.revision, r.first_seen.day, r.last_seen.day) for k, r in known.items()} == {
        ("a b", "1"): (1, 1, 1), ("a b", "2"): (1, 1, 2), ("a b", "3"): (3, 1, 3), ("portal", "3"): (1, 2, 2),
    }
    assert json.loads(known["a b", "2"].payload)["what"] == "hotel" and json.loads(known["a b", "3"].payload)["what"] == "shop"
    projects = {(r.source, r.source_record_id): r for r in keyed_state.projects_table(spark, f"{root}/out").collect()}
    assert projects.keys() == known.keys() and projects["a b", "3"].description == "shop" and projects["a b", "3"].first_seen.day == 1
    company = keyed_state.companies_table(spark, f"{root}/out", F.lit("2001-07-03").cast("timestamp")).collect()
    assert [(c.name, c.phone is not None) for c in company] == [("Ann Co", True)]


def test_a_failing_source_holds_up_no_other(spark):
    root = scratch_path(spark, "state")
    configs = {n: _config(C.PERMIT_ARRAY, n) for n in ("bad", "good")}
    for name in configs:
        landing.land(spark.createDataFrame([(json.dumps([{"id": 1, "what": "x"}]),)], "response string"), f"{root}/in", name, F.lit("2001-07-01"))
    now = F.lit("2001-07-01").cast("timestamp")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/out/projects/source=bad")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.create(path).close()  # a file where the log of one source should be
    with pytest.raises(StreamingQueryException):
        keyed_state.run_sources(spark, f"{root}/in", configs, f"{root}/out", now)
    assert spark.read.parquet(f"{root}/out/projects/source=good/*").count() == 1
    fs.delete(path, True)
    # The batch that failed comes again, with the state as it was.
    keyed_state.run_sources(spark, f"{root}/in", configs, f"{root}/out", now)
    assert {(r.source, r.revision) for r in keyed_state.records_table(spark, f"{root}/out").collect()} == {("bad", 1), ("good", 1)}
    assert keyed_state.projects_table(spark, f"{root}/out").count() == 2


def test_keys_share_state_values(spark, monkeypatch):
    monkeypatch.setattr(keyed_state, "_BUCKETS", 16, raising=False)
    root = scratch_path(spark, "shared")
    columns = "source string, source_record_id string, payload string, contact struct<name:string,license_number:string,email:string,phone:string>, content_hash string, fetched_at timestamp"

    def deliver(day, ids, content):
        at = dt.datetime(2001, 7, day, 1, 2, 3, 456789)
        rows = [(s, str(k), f"{content} {k}", (f"Ann {k}", None, "", "1") if k % 2 else None, content, at) for s in ("a", "b") for k in ids]
        spark.createDataFrame(rows, columns).write.mode("append").parquet(f"{root}/in")
        stream = keyed_state.changes(spark.readStream.schema(columns).parquet(f"{root}/in"))
        query = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{root}/_stream")
        query = query.foreachBatch(lambda df, number: df.write.parquet(f"{root}/out/{day}")).start()
        query.awaitTermination()
        found = {(r.source, r.source_record_id): r for r in spark.read.parquet(f"{root}/out/{day}").collect()}
        assert len(found) == 2 * len(ids)
        assert {r.last_seen for r in found.values()} == {at}
        return found, max(s["numRowsTotal"] for p in query.recentProgress for s in p["stateOperators"])

    for k, v in keyed_state._STORE.items():
        spark.conf.set(k, v)
    try:
        first, second, third = deliver(1, range(500), "x"), deliver(2, range(0, 500, 3), "y"), deliver(3, range(502), "x")
    finally:
        for k in keyed_state._STORE:
            spark.conf.unset(k)
    found, values = first
    # 1,000 keys of two sources, sixteen values each.
    assert values <= 2 * 16
    assert {(r.revision, r.changed, r.content_hash) for r in found.values()} == {(1, True, "x")}
    assert all(r.payload == f"x {r.source_record_id}" and r.fetched_at == r.first_seen == r.last_seen for r in found.values())
    assert found["a", "3"].contact.asDict() == {"name": "Ann 3", "license_number": None, "email": "", "phone": "1"} and found["a", "4"].contact is None
    assert {r.revision for r in second[0].values()} == {2}
    # Neighbours of a changed key stay as they were, new ones begin.
    found, values = third
    assert values <= 2 * 16
    for (_, record), r in found.items():
        revision = 1 if int(record) >= 500 else 3 if int(record) % 3 == 0 else 1
        assert (r.revision, r.changed, r.first_seen.day) == (revision, int(record) % 3 == 0 or int(record) >= 500, 3 if int(record) >= 500 else 1)
        assert (r.payload, r.contact is None) == ((f"x {record}", int(record) % 2 == 0) if r.changed else (None, True))


def test_responses_of_one_file_are_dealt_out(spark, monkeypatch):
    root, read = scratch_path(spark, "dealt"), keyed_state.read_source
    bodies = [(json.dumps([{"id": k, "what": "office at"}]),) for k in range(64)]
    landing.land(spark.createDataFrame(bodies, "response string").coalesce(1), f"{root}/in", "one", F.lit("2001-07-01"))
    marked = F.replace("response", F.lit("office at"), F.concat(F.lit("office at "), F.spark_partition_id().cast("string"))).alias("response")
    monkeypatch.setattr(keyed_state, "read_source", lambda name, cfg, responses: read(name, cfg, responses.select(marked)))
    keyed_state.run_sources(spark, f"{root}/in", {"one": _config(C.PERMIT_ARRAY, "one")}, f"{root}/out")
    projects = keyed_state.projects_table(spark, f"{root}/out").select("description").collect()
    assert len(projects) == 64 and len(set(projects)) > 1
