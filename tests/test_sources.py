from __future__ import annotations

import json

from pyspark.sql import functions as F

from siteledger import config as C
from siteledger import schemas as S
from siteledger.operators import contacts as K
from siteledger.operators import upsert as U
from siteledger.operators.normalize import companies_of, normalize
from siteledger.sources import files, landing, records
from siteledger.streaming import incremental


def responses(spark, *docs):
    return spark.createDataFrame([(json.dumps(d),) for d in docs], "response string")


def one(df):
    return df.collect()[0].asDict()


def test_permits_with_contacts(spark):
    cfg = C.SourceConfig(type=C.PERMIT_ARRAY, name="P", jurisdiction="San Francisco", county="San Francisco",
                         source_url_template="https://x.gov/{permit_number}")
    permits = responses(spark, [{
        "record_id": "rec-1", "permit_number": "2026-0001", "description": "Restaurant tenant improvement, new kitchen hood",
        "street_number": "100", "street_name": "Market", "street_suffix": "St", "issued_date": "2026-05-10T00:00:00.000",
        "data_loaded_at": "2026-05-20T00:00:00.000"}, {"record_id": "rec-2", "permit_number": "2026-0002"}])
    contacts = spark.createDataFrame(
        [("2026-0001", "Owner", "Jane", "Doe", None, None, None),
         ("2026-0001", "Contractor", None, None, "Acme Builders Inc", "492944", "4155551212")],
        "permit_number string, role string, first_name string, last_name string, firm_name string, license1 string, phone string",
    )
    raw = records.read_source("p", cfg, permits, contacts=contacts).cache()
    rows = {r["source_record_id"]: r for r in normalize(raw, cfg).collect()}
    first = rows["rec-1"]
    assert (first["company_name"], first["license_number"], first["company_phone"]) == ("Acme Builders Inc", "492944", "(415) 555-1212")
    assert (first["project_date"], first["address"], first["source_url"]) == ("2026-05-10", "100 Market St", "https://x.gov/2026-0001")
    assert rows["rec-2"]["description"] == "Permit at unknown address" and rows["rec-2"]["company_name"] is None
    loaded = records.P.flat_fields(F.col("payload"), ["data_loaded_at"])["data_loaded_at"]
    assert one(records.high_water(raw, loaded))["watermark"] == "2026-05-20T00:00:00.000"
    assert [r[0] for r in records.payload_keys(raw).collect()][:2] == ["data_loaded_at", "description"]
    assert records.sample(raw, 1).count() == 1


def test_inline_contractor(spark):
    fm = C.FieldMap(record_id="id_col", permit_number="permit_no", description=("work_description",), address=("house_no", "street"),
                    project_date=("issue_date", "applied_date"), company_name="contractor", company_license="contractor_lic", company_phone="contractor_phone")
    cfg = C.SourceConfig(type=C.PERMIT_ARRAY, name="P", jurisdiction="Oakland", field_map=fm)
    doc = [{"id_col": "x1", "permit_no": "BLD-2026-77", "work_description": "Office TI", "house_no": 200, "street": "Broadway",
            "issue_date": "2026-05-11", "contractor": "Bay Build", "contractor_lic": "123", "contractor_phone": "510.555.1234"}]
    row = one(normalize(records.read_source("p", cfg, responses(spark, doc)), cfg))
    assert (row["permit_number"], row["address"], row["company_phone"], row["city"]) == ("BLD-2026-77", "200 Broadway", "(510) 555-1234", "Oakland")


def test_feature_layer(spark):
    fm = C.FieldMap(record_id="PermitID", permit_number="ApplicationNumber", description=("ProjectDescription",), address=("Address",),
                    project_date=("IssuedDate",), city="City", company_name="ProjectName")
    cfg = C.SourceConfig(type=C.FEATURE_LAYER, name="C", jurisdiction="Campbell", field_map=fm, date_field="IssuedDate")
    doc = {"features": [{"attributes": {"OBJECTID": 1, "PermitID": "A1", "ApplicationNumber": "B-1", "ProjectName": "Acme LLC",
                                        "ProjectDescription": "Reroof", "Address": "1 Main", "City": "CAMPBELL", "IssuedDate": 1778371200000}}],
           "exceededTransferLimit": False}
    row = one(normalize(records.read_source("c", cfg, responses(spark, doc)), cfg))
    assert (row["project_date"], row["city"], row["company_name"], row["source_record_id"]) == ("2026-05-10", "Campbell", "Acme LLC", "A1")


def notice(i, **place):
    return {"noticeId": i, "title": "Roof", "solicitationNumber": "S1", "fullParentPathName": "DEPT.SUB.ARMY  CORPS", "postedDate": "2026-05-10",
            "type": "Solicitation", "naicsCode": "236220", "responseDeadLine": "2026-06-15T17:00:00-07:00", "uiLink": "https://u/" + i,
            "pointOfContact": [{"type": "secondary", "fullName": "B", "email": "b@x.gov"}, {"type": "primary", "fullName": "A", "email": "a@x.gov", "phone": "4155550000"}],
            "placeOfPerformance": place}


def test_opportunities(spark):
    cfg = C.SourceConfig(type=C.OPPORTUNITIES, name="S", jurisdiction="California", county="Bay Area", region="bay_area", naics_codes=("236220",))
    ca = {"name": "California", "code": "CA"}
    doc = {"opportunitiesData": [
        notice("sf-1", city={"name": "SAN FRANCISCO"}, state=ca),
        notice("moffett-1", city={"name": "LINDA"}, state=ca, zip="94035"),
        notice("fresno", city={"name": "Fresno"}, state=ca, zip="93701"),
        notice("nv", city={"name": "Richmond"}, streetAddress="1 A St, Reno, NV 89501"),
    ], "totalRecords": 4}
    raw = records.read_source("s", cfg, responses(spark, doc))
    rows = {r["source_record_id"]: r for r in normalize(raw, cfg).collect()}
    assert set(rows) == {"sf-1", "moffett-1"}
    row = rows["sf-1"]
    assert (row["description"], row["bid_deadline"], row["city"], row["address"]) == (
        "[Solicitation] Roof", "2026-06-15", "San Francisco", "SAN FRANCISCO, California")
    assert (row["company_name"], row["company_email"], row["company_phone"], row["county"]) == ("ARMY CORPS", "a@x.gov", "(415) 555-0000", None)


def test_portal_paths_and_recency(spark):
    fm = C.FieldMap(record_id="permitId", permit_number="permitNumber", description=("workDescription",), address=("siteAddress",),
                    project_date=("issueDate",), company_name="contractorCompany", company_email="contractorEmail")
    cfg = C.SourceConfig(type=C.PORTAL_DETAIL, name="E", jurisdiction="Sunnyvale", record_path="data", field_map=fm, detail_url_template="https://d/{permitId}", date_field="issueDate")
    doc = {"data": [{"permitId": "1", "permitNumber": "P1", "issueDate": "05/10/2026", "CaseId": "c1"}, {"permitId": "2", "issueDate": "01/10/2020"}, {"permitId": "3"}]}
    got = records.portal("e", cfg, responses(spark, doc), since="2026-01-01")
    assert {r["source_record_id"]: r["source_url"] for r in got.collect()} == {"1": "https://d/1", "3": "https://d/3"}
    details = spark.createDataFrame([("c1", json.dumps({"Result": {"Contractor": "Acme", "n": 3}}))], "case_id string, response string")
    merged = records.read_source("e", cfg, responses(spark, doc), details=details)
    payload = {r["source_record_id"]: json.loads(r["payload"]) for r in merged.collect()}
    assert payload["1"]["detail_Contractor"] == "Acme" and "detail_Contractor" not in payload["2"]


def test_permit_csv(spark, tmp_path):
    path = tmp_path / "p.csv"
    path.write_text(
        "﻿PermitID,Scope,SiteAddress,IssueDate,Contractor\nP1, Reroof ,\"1 Main, #2\",5/1/2026,Acme\nP1,Again,x,5/2/2026,B\n,No number,y,,\n",
        encoding="utf-8",
    )
    document = {"portals": [{"jurisdiction": "Mountain View", "county": "Santa Clara", "field_map": {
        "record_id": "PermitID", "permit_number": "PermitID", "description": ["Scope"], "address": ["SiteAddress"], "project_date": ["IssueDate"],
        "company_name": "Contractor"}}]}
    name, cfg = C.csv_source(document, "mountain-view")
    assert (name, cfg.jurisdiction, cfg.county) == ("cpra-mountain-view", "Mountain View", "Santa Clara")
    assert C.csv_source(document, "Other")[1].field_map == C.CSV_FIELD_MAP
    rows = files.permit_rows(files.read_csv(spark, str(path)), "cpra-mountain-view", cfg.field_map).cache()
    assert one(files.import_stats(rows)) == {"rows_read": 3, "upserted": 2, "skipped": 1}
    kept = {r["permit_number"]: r for r in normalize(rows.where("not skipped"), cfg).collect()}
    assert (kept["P1"]["description"], kept["P1"]["address"], kept["P1"]["city"]) == ("Reroof", "1 Main, #2", "Mountain View")
    hashed = [r["source_record_id"] for r in rows.collect() if r["source_record_id"] != "P1"]
    assert len(hashed) == 1 and len(hashed[0]) == 64


def test_license_master_last_row_wins(spark, tmp_path):
    path = tmp_path / "l.csv"
    path.write_text("LicenseNo,FullBusinessName,BusinessPhone,MailingAddress,City,State,ZIPCode,PrimaryStatus,SecondaryStatus,Classifications(s)\n"
                    "00492944,Old,1,a,b,c,d,e,,\n492944,Acme,4155551212,555 Main St,San Francisco,CA,94105,CLEAR,,B\nX1,No,,,,,,,,\n")
    from siteledger.operators.enrich import license_result

    wanted = spark.createDataFrame([("492944",)], "license_key string")
    master = files.license_master(files.read_csv(spark, str(path)), wanted)
    firms = spark.createDataFrame([("a", "Acme", "0492944"), ("b", "B", None), ("c", "C", "77")], "company_key string, name string, license_number string")
    got = {r["company_key"]: r for r in license_result(firms, master).collect()}
    assert (got["a"]["phone"], got["a"]["address"], got["a"]["license_status"], got["a"]["license_classification"]) == (
        "(415) 555-1212", "555 Main St San Francisco CA 94105", "CLEAR", "B")
    assert [got[k]["status"] for k in "abc"] == ["updated", "skipped", "not_found"]
    assert {r["status"] for r in license_result(firms, None).collect()} == {"pending", "skipped"}


def test_contact_pages_keep_everything(spark):
    rows = [("hot", f"f{i % 5}") for i in range(500)] + [("p2", "f"), ("", "lost")]
    df = spark.createDataFrame(rows, "permit string, firm_name string")
    pages = K.contact_pages(df, "permit", 50).collect()
    assert sum(len(p["contacts"]) for p in pages if p["permit"] == "hot") == 500
    assert max(len(p["contacts"]) for p in pages) < 110


def test_upsert_is_idempotent(spark):
    incoming = spark.createDataFrame([("s", "1", '{"a":1}'), ("s", "2", '{"a":2}')], "source string, source_record_id string, payload string")
    incoming = S.conform(incoming.withColumn("content_hash", F.sha2("payload", 256)), S.RAW)
    t1, t2 = F.lit("2026-01-01").cast("timestamp"), F.lit("2026-01-02").cast("timestamp")
    first = U.upsert_raw(U.empty(spark, S.RAW), incoming, t1)
    assert first.where("changed").count() == 2
    again = U.upsert_raw(U.mark_processed(first, first), incoming, t2)
    assert again.where("changed").count() == 0 and again.count() == 2
    pending = U.upsert_raw(first, incoming, t2)
    assert pending.where("changed").count() == 2
    assert U.upsert_raw(first, incoming, t2, keep_pending=False).where("changed").count() == 0


def test_manual_records_and_config(spark):
    df = spark.createDataFrame([("Fix roof", "P1", "Acme"), (" ", "P2", None), ("No number", None, None)], "description string, permit_number string, company_name string")
    good, bad = files.split_manual(df, "manual")
    rows = {r["description"]: r for r in good.collect()}
    assert rows["Fix roof"]["source_record_id"] == "P1" and len(rows["No number"]["source_record_id"]) == 64
    assert [r["reason"] for r in bad.collect()] == ["missing description"]
    assert companies_of(good).count() == 1
    cfgs = C.sources_from({"sources": {"m": {"type": C.PERMIT_ARRAY, "name": "Marin", "jurisdiction": "Marin County", "county": "Marin",
                                             "field_map": {"record_id": "unique_id", "description": ["description", "construction"]}}}})
    assert cfgs["m"].field_map.record_id == "unique_id" and cfgs["m"].field_map.permit_number == "permit_number"
    assert records.list_sources(spark, cfgs).first()["county"] == "Marin"
    records.register_reader("own", lambda name, cfg, df: df)
    own = C.source_from({"type": "own", "name": "o", "jurisdiction": "x"})
    assert records.read_source("o", own, df).count() == 3
    del records.READERS["own"]


def test_batch_can_run_again(spark, tmp_path):
    """A micro-batch that is repeated after a failure leaves the same state."""
    cfg = C.SourceConfig(type=C.PORTAL, name="P", jurisdiction="X", record_path="items",
                         field_map=C.FieldMap(record_id="id", permit_number="id", description=("d",), address=(), project_date=("day",), company_name="who"))
    raw = records.portal("p", cfg, responses(spark, {"items": [{"id": 1, "d": "hotel", "day": "2026-01-01", "who": "A & B"}]}))
    root, now, mark = str(tmp_path / "state"), F.lit("2026-01-01").cast("timestamp"), F.col("source_record_id")
    for _ in range(2):
        incremental.process_batch(spark, raw, cfg, root, 0, now, mark)
    projects = incremental.Snapshots(spark, f"{root}/projects", S.PROJECT).before()
    assert [(r["category"], r["company_key"]) for r in projects.collect()] == [("HOSPITALITY_REMODEL", "a and b")]
    assert incremental.Snapshots(spark, f"{root}/watermarks", S.WATERMARK).before().first()["watermark"] == "1"
    assert incremental.Snapshots(spark, f"{root}/raw", S.RAW).before().where("changed").count() == 0


def test_values_keep_their_types(spark):
    found = [('{"CaseId": 7, "n": 1.5, "_contacts": [{"name": "A", "main": true}], "detail_x": "old"}',), ('{"PermitId": "p", "none": null}',)]
    details = [(7, '{"Result": {"x": {"deep": [1, 2]}, "ok": false, "nothing": null}}'), (9, '{"Result": {"x": 1}}'), (8, "broken")]
    merged = records.merge_details(spark.createDataFrame(found, "payload string"), spark.createDataFrame(details, "case_id int, response string"))
    got = sorted((json.loads(r["payload"]) for r in merged.collect()), key=len)
    assert got == [
        {"PermitId": "p", "none": None},
        {"CaseId": 7, "n": 1.5, "_contacts": [{"name": "A", "main": True}], "detail_x": {"deep": [1, 2]}, "detail_ok": False, "detail_nothing": None},
    ]
    cfg = C.SourceConfig(type=C.FEATURE_LAYER, name="x", jurisdiction="y", field_map=C.FieldMap(record_id="id", permit_number=None, project_date=("day", "other")))
    response = '{"features": [{"attributes": {"id": 5, "day": 1704067200000, "other": "soon", "size": 2.5, "open": true, "tags": ["a"], "none": null}}]}'
    raw = records.feature_layer("x", cfg, spark.createDataFrame([(response,)], "response string")).first()
    assert json.loads(raw["payload"]) == {"id": 5, "day": "2024-01-01", "other": "soon", "size": 2.5, "open": True, "tags": ["a"], "none": None}
    assert raw["source_record_id"] == "5"


def test_landing_reads_new_folders_only(spark, tmp_path):
    path, one_day = str(tmp_path / "landing"), lambda *texts: spark.createDataFrame([(t,) for t in texts], "response string")
    landing.land(one_day("a1", "a2"), path, "a", F.lit("2024-01-01"))
    landing.land(one_day("b1"), path, "b", F.lit("2024-01-03"))
    counted = []

    def run():
        query = landing.landed_stream(spark, path).writeStream.foreachBatch(lambda df, n: counted.append(sorted(r["response"] for r in df.collect())))
        query.option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start().awaitTermination()

    run()
    landing.land(one_day("a3"), path, "a", F.lit("2024-01-02"))
    new = landing.landed(spark, path, "a", "2024-01-01")
    assert [r["response"] for r in new.collect()] == ["a3"]
    assert sorted(r["response"] for r in landing.landed(spark, path, "a").collect()) == ["a1", "a2", "a3"]
    plan = new._jdf.queryExecution().executedPlan().toString()
    assert "Location: InMemoryFileIndex" in plan and "(day#" in plan.split("PartitionFilters:")[1].split("PushedFilters")[0]
    run()
    run()
    assert [x for x in counted if x] == [["a1", "a2", "b1"], ["a3"]]
    assert {r["source"]: str(r["day"]) for r in landing.watermarks(spark, path).collect()} == {"a": "2024-01-02", "b": "2024-01-03"}
