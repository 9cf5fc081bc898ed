"""Registered queries: reading landed responses and mapping them to projects."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siteledger import config as C
from siteledger.functions import dates, geo
from siteledger.functions.payload import flat_fields
from siteledger.operators import contacts as K
from siteledger.operators import regions
from siteledger.operators.normalize import normalize
from siteledger.plans.tables import ORDERS_SQL, orders_with_customers, table, wide_table
from siteledger.session import scratch_path
from siteledger.sources import files, landing, records

QUERIES = {}
ORACLES = {}

_DAY = "CAST(o_orderdate AS DATE)"
_KEY = "CAST(o_orderkey AS STRING)"

PERMIT_CONFIG = C.SourceConfig(
    type=C.PORTAL,
    name="orders",
    jurisdiction="Springfield",
    county="Clark",
    record_path="result.records",
    source_url_template="https://permits.example.gov/{permitNo}?id={recordId}",
    field_map=C.FieldMap(
        record_id="recordId",
        permit_number="permitNo",
        description=("work", "kind"),
        address=("houseNo", "street"),
        project_date=("issued", "filed"),
        city="town",
        company_name="contractor",
        company_license="license",
        company_email="mail",
        company_phone="phone",
    ),
)

# Payload fields over ``orders_with_customers``: blanks, sentinels and mixed layouts on purpose.
PERMIT = {
    "recordId": f"CASE WHEN o_orderstatus = 'P' THEN '' ELSE {_KEY} END",
    "permitNo": f"concat('P-', {_KEY})",
    "work": "CASE WHEN o_orderpriority = '5-LOW' THEN '' WHEN o_orderpriority = '3-MEDIUM' THEN '  ' "
    "ELSE concat('  ', o_orderpriority, ' works for ', lower(c_mktsegment), ' ') END",
    "kind": "CASE WHEN o_orderstatus = 'F' THEN lower(c_mktsegment) END",
    "houseNo": "CASE WHEN c_acctbal < 0 THEN NULL ELSE CAST(c_custkey AS STRING) END",
    "street": "concat(n_name, ' Street ')",
    "issued": f"CASE WHEN o_orderpriority = '1-URGENT' THEN concat(CAST({_DAY} AS STRING), 'T10:00:00.000') "
    f"WHEN o_orderpriority = '2-HIGH' THEN replace(CAST({_DAY} AS STRING), '-', '/') "
    "WHEN o_orderpriority = '3-MEDIUM' THEN 'next spring' ELSE '' END",
    "filed": f"concat(CAST(month({_DAY}) AS STRING), '/', CAST(day({_DAY}) AS STRING), '/', CAST(year({_DAY}) AS STRING))",
    "town": "CASE WHEN n_regionkey = 0 THEN ' ' ELSE lower(replace(r_name, '_', ' ')) END",
    "contractor": "CASE WHEN c_mktsegment = 'BUILDING' THEN 'Owner' WHEN c_mktsegment = 'MACHINERY' THEN ' N/A ' "
    "ELSE concat(' ', replace(c_name, '#', '  '), ' ') END",
    "license": "CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 'NONE' ELSE concat(' ', CAST(c_custkey AS STRING)) END",
    "mail": "concat('write to <', lower(replace(c_name, '#', '.')), '@example.com> today')",
    "phone": "CASE WHEN c_acctbal > 5000 THEN concat('415.555.', right(lpad(CAST(c_custkey AS STRING), 4, '0'), 4)) "
    "ELSE concat('1415555', right(lpad(CAST(c_custkey AS STRING), 4, '0'), 4)) END",
}


def _object(fields: dict[str, str]) -> Column:
    return F.struct(*[F.expr(e).alias(n) for n, e in fields.items()])


def permit_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One landed response per order, records nested under ``result.records``."""
    base = orders_with_customers(spark, sf_dir, wide=True)
    doc = F.struct(F.struct(F.array(_object(PERMIT)).alias("records")).alias("result"))
    return base.select(F.to_json(doc, {"ignoreNullFields": "false"}).alias("response"))


_PROJECT = ("source_record_id", "permit_number", "description", "project_date", "address", "city", "county", "source_url",
            "company_name", "license_number", "company_email", "company_phone")


def normalize_permits(spark, sf_dir):
    raw = records.read_source("orders", PERMIT_CONFIG, permit_responses(spark, sf_dir))
    return normalize(raw, PERMIT_CONFIG).select(*_PROJECT)


_PERMIT_CTE = "p AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in PERMIT.items()) + f" FROM {ORDERS_SQL})"
_ADDRESS = "trim(concat_ws(' ', houseNo, trim(street)))"
_COMPANY = "trim(regexp_replace(contractor, '\\s+', ' ', 'g'))"
_NAMED = f"lower({_COMPANY}) NOT IN ('owner', 'none', 'n/a')"
QUERIES["normalize_permits"] = normalize_permits
ORACLES["normalize_permits"] = f"""WITH {_PERMIT_CTE} SELECT
    coalesce(nullif(recordId, ''), permitNo) AS source_record_id, permitNo AS permit_number,
    coalesce(nullif(trim(coalesce(nullif(work, ''), kind)), ''), concat('Permit at ', {_ADDRESS})) AS description,
    CASE WHEN issued <> '' THEN coalesce(CAST(try_strptime(split_part(issued, 'T', 1), ['%Y-%m-%d', '%Y/%m/%d']) AS DATE)::VARCHAR,
        split_part(issued, ' ', 1)) ELSE CAST(strptime(filed, '%m/%d/%Y') AS DATE)::VARCHAR END AS project_date,
    {_ADDRESS} AS address,
    CASE WHEN trim(town) = '' THEN 'Springfield' ELSE array_to_string(list_transform(string_split(town, ' '), lambda w: concat(upper(left(w, 1)), substr(w, 2))), ' ') END AS city,
    'Clark' AS county, 'https://permits.example.gov/' || permitNo || '?id=' || recordId AS source_url,
    CASE WHEN {_NAMED} THEN {_COMPANY} END AS company_name,
    CASE WHEN {_NAMED} AND license <> 'NONE' THEN trim(license) END AS license_number,
    CASE WHEN {_NAMED} THEN regexp_extract(mail, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}') END AS company_email,
    CASE WHEN {_NAMED} THEN '(415) 555-' || right(phone, 4) END AS company_phone FROM p"""

NOTICE_CONFIG = C.SourceConfig(
    type=C.OPPORTUNITIES,
    name="notices",
    jurisdiction="California",
    region="CA",
    naics_codes=("236220", "237310"),
    source_url_template="https://notices.example.gov/{noticeId}",
)
_STATE = "CASE WHEN n_regionkey < 3 THEN 'ca' WHEN n_regionkey = 3 THEN '' ELSE 'NV' END"
_STREET = "concat(CAST(c_custkey AS STRING), ' Oak Way, ', CASE WHEN c_acctbal > 0 THEN 'CA' ELSE 'OR' END, ' 94', lpad(CAST(c_nationkey AS STRING), 3, '0'))"
_NAICS = "CASE WHEN c_mktsegment = 'BUILDING' THEN '236220' WHEN c_mktsegment = 'MACHINERY' THEN '541330' ELSE '237310' END"
_TITLE = "CASE WHEN o_orderpriority = '5-LOW' THEN '' ELSE concat(' Repair of ', lower(c_mktsegment)) END"
_KIND = "CASE WHEN o_orderstatus = 'P' THEN '' ELSE concat('Kind ', o_orderstatus) END"
_SOLICITATION = f"CASE WHEN c_mktsegment = 'BUILDING' THEN '' ELSE concat('S-', {_KEY}) END"
_PATH = "CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN ' ' ELSE concat('DEPT.', r_name, '. OFFICE  OF ', n_name) END"


def notice_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    contact = """array(
        named_struct('type', 'secondary', 'fullName', 'Second Person', 'email', NULL,
            'phone', CASE WHEN c_acctbal > 3000 THEN '(702) 555-0100' END),
        named_struct('type', 'Primary', 'fullName', c_name,
            'email', CASE WHEN c_acctbal > 6000 THEN lower(concat(replace(c_name, '#', '.'), '@agency.example.gov')) END,
            'phone', NULL))"""
    place = f"""named_struct('city', named_struct('name', concat('  ', lower(replace(n_name, '_', ' ')))),
        'state', named_struct('code', {_STATE}, 'name', NULL), 'zip', NULL, 'streetAddress', {_STREET})"""
    fields = {
        "noticeId": _KEY,
        "title": _TITLE,
        "type": _KIND,
        "solicitationNumber": _SOLICITATION,
        "fullParentPathName": _PATH,
        "department": "CASE WHEN n_regionkey = 1 THEN 'Dept One' END",
        "postedDate": f"CAST({_DAY} AS STRING)",
        "responseDeadLine": f"concat(CAST({_DAY} + 30 AS STRING), 'T17:00:00-07:00')",
        "naicsCode": _NAICS,
        "uiLink": f"CASE WHEN o_orderstatus = 'F' THEN concat('https://ui.example.gov/', {_KEY}) END",
        "pointOfContact": contact,
        "placeOfPerformance": place,
    }
    base = orders_with_customers(spark, sf_dir, wide=True)
    doc = F.struct(F.array(_object(fields)).alias("opportunitiesData"))
    return base.select(F.to_json(doc, {"ignoreNullFields": "false"}).alias("response"))


def normalize_notices(spark, sf_dir):
    raw = records.read_source("notices", NOTICE_CONFIG, notice_responses(spark, sf_dir))
    return normalize(raw, NOTICE_CONFIG).select(*_PROJECT, "bid_deadline")


_AGENCY = "CASE WHEN trim(path) <> '' THEN trim(regexp_replace(split_part(path, '.', 3), '\\s+', ' ', 'g')) ELSE department END"
_POC = "(email IS NOT NULL OR phone IS NOT NULL)"
QUERIES["normalize_notices"] = normalize_notices
ORACLES["normalize_notices"] = f"""WITH n AS (SELECT {_KEY} AS id, trim({_TITLE}) AS title, {_KIND} AS kind, {_SOLICITATION} AS sol,
    {_PATH} AS path, CASE WHEN n_regionkey = 1 THEN 'Dept One' END AS department, {_DAY} AS d, o_orderstatus AS st,
    '  ' || lower(replace(n_name, '_', ' ')) AS city, {_STATE} AS state, {_STREET} AS street, {_NAICS} AS naics, c_name,
    CASE WHEN c_acctbal > 6000 THEN lower(replace(c_name, '#', '.')) || '@agency.example.gov' END AS primary_mail,
    CASE WHEN c_acctbal > 3000 THEN '(702) 555-0100' END AS second_phone FROM {ORDERS_SQL}),
 k AS (SELECT *, primary_mail AS email, CASE WHEN primary_mail IS NULL THEN second_phone END AS phone, {_AGENCY} AS agency FROM n
   WHERE naics IN ('236220', '237310')
     AND upper(coalesce(nullif(state, ''), regexp_extract(street, ',\\s*([A-Z]{{2}})\\s+\\d{{5}}', 1))) = 'CA')
 SELECT id AS source_record_id, coalesce(nullif(sol, ''), id) AS permit_number,
    CASE WHEN title <> '' AND kind <> '' THEN '[' || kind || '] ' || title WHEN title <> '' THEN title
         WHEN kind <> '' THEN kind ELSE 'SAM.gov opportunity' END AS description,
    d::VARCHAR AS project_date, concat_ws(', ', city, nullif(state, '')) AS address,
    regexp_replace(concat(upper(left(trim(city), 1)), substr(trim(city), 2)), '\\s+', ' ', 'g') AS city, NULL AS county,
    CASE WHEN st = 'F' THEN 'https://ui.example.gov/' || id ELSE 'https://notices.example.gov/' || id END AS source_url,
    CASE WHEN {_POC} THEN coalesce(agency, CASE WHEN email IS NOT NULL THEN c_name ELSE 'Second Person' END) ELSE agency END AS company_name,
    NULL AS license_number, email AS company_email, phone AS company_phone, (d + 30)::VARCHAR AS bid_deadline FROM k"""

FEATURE_CONFIG = C.SourceConfig(
    type=C.FEATURE_LAYER,
    name="events",
    jurisdiction="Lake City",
    field_map=C.FieldMap(
        record_id="OBJECTID", permit_number=None, description=("EventType",), address=("UserId",), project_date=("IssuedDate",)
    ),
)


def _feature_responses(spark, sf_dir):
    attributes = """named_struct('OBJECTID', event_id, 'EventType', event_type, 'UserId', user_id,
        'IssuedDate', timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts), 'Props', props)"""
    texts = """named_struct('OBJECTID', event_id, 'EventType', event_type, 'UserId', user_id,
        'IssuedDate', CAST(CAST(ts AS DATE) AS STRING), 'Props', props)"""
    events = wide_table(spark, sf_dir, "events")
    as_number = F.to_json(F.expr(f"named_struct('features', array(named_struct('attributes', {attributes})))"))
    as_text = F.to_json(F.expr(f"named_struct('features', array(named_struct('attributes', {texts})))"))
    return events.select(F.when(F.col("event_type") == "view", as_text).otherwise(as_number).alias("response"))


def feature_layer_permits(spark, sf_dir):
    """Events as layer features; the issue date is an epoch number, or text for some types."""
    raw = records.read_source("events", FEATURE_CONFIG, _feature_responses(spark, sf_dir))
    return normalize(raw, FEATURE_CONFIG).select("source_record_id", "description", "project_date", "address", "city")


QUERIES["feature_layer_permits"] = feature_layer_permits
ORACLES["feature_layer_permits"] = """SELECT CAST(event_id AS VARCHAR) AS source_record_id, event_type AS description,
    CAST(CAST(ts AS DATE) AS VARCHAR) AS project_date, CAST(user_id AS VARCHAR) AS address, 'Lake City' AS city FROM events"""



def feature_since(spark, sf_dir):
    """Features from a day on, the day included."""
    cfg = replace(FEATURE_CONFIG, date_field="IssuedDate")
    return records.read_source("events", cfg, _feature_responses(spark, sf_dir), since="2024-01-15").select("source_record_id")


QUERIES["feature_since"] = feature_since
ORACLES["feature_since"] = "SELECT CAST(event_id AS VARCHAR) AS source_record_id FROM events WHERE CAST(ts AS DATE) >= DATE '2024-01-15'"


def notice_window(spark, sf_dir):
    """Notices of any place posted from a day on."""
    cfg = replace(NOTICE_CONFIG, region=None)
    return records.read_source("notices", cfg, notice_responses(spark, sf_dir), since="1997-06-01").select("source_record_id", "source_url")


QUERIES["notice_window"] = notice_window
ORACLES["notice_window"] = f"""SELECT {_KEY} AS source_record_id,
    CASE WHEN o_orderstatus = 'F' THEN 'https://ui.example.gov/' ELSE 'https://notices.example.gov/' END || {_KEY} AS source_url
    FROM {ORDERS_SQL} WHERE {_NAICS} IN ('236220', '237310') AND {_DAY} >= DATE '1997-06-01'"""


def permit_array_since(spark, sf_dir):
    """Array responses after a moment, the moment excluded; some permits have no id of their own."""
    cfg = C.SourceConfig(
        type=C.PERMIT_ARRAY, name="orders", jurisdiction="Springfield", date_field="loaded", source_url_template="https://permits.example.gov/{num}",
        field_map=C.FieldMap(record_id="rid", permit_number="num"),
    )
    item = f"""array(named_struct('rid', CASE WHEN o_orderstatus = 'P' THEN '' ELSE {_KEY} END, 'num', concat('P-', {_KEY}),
        'loaded', CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE concat(CAST({_DAY} AS STRING), 'T00:00:00.000') END))"""
    responses = wide_table(spark, sf_dir, "orders").select(F.to_json(F.expr(item)).alias("response"))
    return records.read_source("orders", cfg, responses, since="1997-06-01").select("source_record_id", "source_url")


QUERIES["permit_array_since"] = permit_array_since
ORACLES["permit_array_since"] = f"""SELECT CASE WHEN o_orderstatus = 'P' THEN concat('P-', {_KEY}) ELSE {_KEY} END AS source_record_id,
    concat('https://permits.example.gov/P-', {_KEY}) AS source_url FROM orders WHERE o_orderpriority <> '5-LOW' AND {_DAY} > DATE '1997-06-01'"""

_CONTACT = {
    "permit_number": "CAST(l_orderkey AS STRING)",
    "role": "CASE WHEN l_returnflag = 'R' THEN 'Owner' WHEN l_linestatus = 'O' THEN 'Subcontractor' ELSE 'Architect' END",
    "first_name": "'Pat'",
    "last_name": "CASE WHEN l_tax > 0.07 THEN '' ELSE concat('Line', CAST(l_suppkey AS STRING)) END",
    "firm_name": "CASE WHEN l_discount > 0.05 THEN concat('Supply ', CAST(l_suppkey AS STRING)) END",
    "license1": "CASE WHEN l_quantity > 40 THEN CAST(l_partkey AS STRING) WHEN l_quantity > 30 THEN '000000' ELSE '' END",
    "license2": "CASE WHEN l_quantity < 10 THEN CAST(l_suppkey AS STRING) END",
    "line": "lpad(concat(CAST(l_linenumber AS STRING), '-', CAST(l_partkey AS STRING), '-', CAST(l_suppkey AS STRING)), 24, '0')",
}


def permit_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as the contacts of their order."""
    return wide_table(spark, sf_dir, "lineitem").selectExpr(*[f"{e} AS {n}" for n, e in _CONTACT.items()])


def attach_contacts(spark, sf_dir):
    permits = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("permit"))
    joined = K.attach_contacts(permits, "permit", permit_contacts(spark, sf_dir), "permit_number", "line")
    return joined.select(
        "permit",
        F.coalesce("contact_count", F.lit(0)).alias("contact_count"),
        F.col("contact.name").alias("name"),
        F.col("contact.license_number").alias("license_number"),
    )


QUERIES["attach_contacts"] = attach_contacts
ORACLES["attach_contacts"] = f"""WITH c AS (SELECT {', '.join(f'{e} AS {n}' for n, e in _CONTACT.items())} FROM lineitem),
 r AS (SELECT permit_number, firm_name, trim(coalesce(firm_name, concat_ws(' ', first_name, nullif(last_name, '')))) AS name,
   CASE WHEN coalesce(nullif(license1, ''), license2) = '000000' THEN NULL ELSE coalesce(nullif(license1, ''), license2) END AS lic,
   lower(role) AS role, line FROM c),
 b AS (SELECT *, row_number() OVER (PARTITION BY permit_number ORDER BY CASE WHEN contains(role, 'contractor') THEN 0
     WHEN contains(role, 'architect') THEN 3 ELSE 5 END, firm_name IS NULL, lic IS NULL, line) AS rn
   FROM r WHERE NOT (role = 'owner' AND firm_name IS NULL AND lic IS NULL)),
 n AS (SELECT permit_number, count(*) AS n FROM c GROUP BY 1)
 SELECT CAST(o_orderkey AS VARCHAR) AS permit, coalesce(n, 0) AS contact_count, name, lic AS license_number FROM orders
   LEFT JOIN n ON n.permit_number = CAST(o_orderkey AS VARCHAR)
   LEFT JOIN b ON b.permit_number = CAST(o_orderkey AS VARCHAR) AND rn = 1"""


def contact_pages(spark, sf_dir):
    """All contacts of every permit, in lists of about three."""
    paged = K.contact_pages(permit_contacts(spark, sf_dir), "permit_number", 3)
    return paged.groupBy("permit").agg(F.max("pages").alias("pages"), F.sum(F.size("contacts")).alias("contacts"))


QUERIES["contact_pages"] = contact_pages
ORACLES["contact_pages"] = """SELECT CAST(l_orderkey AS VARCHAR) AS permit, CAST(ceil(count(*) / 3.0) AS BIGINT) AS pages,
    count(*) AS contacts FROM lineitem GROUP BY 1"""


def search_with_detail(spark, sf_dir):
    """Search results left-joined with detail documents, which exist for finished orders only."""
    orders = table(spark, sf_dir, "orders")
    found = orders.selectExpr("to_json(named_struct('CaseId', o_orderkey, 'Status', o_orderstatus)) AS payload")
    details = orders.where("o_orderstatus = 'F'").selectExpr(
        "o_orderkey AS case_id",
        "to_json(named_struct('Result', named_struct('Priority', o_orderpriority, 'Cust', o_custkey))) AS response",
    )
    merged = records.merge_details(found, details)
    fields = flat_fields(F.col("payload"), ["CaseId", "Status", "detail_Priority", "detail_Cust"])
    return merged.select(fields.alias("f")).select(
        F.col("f.CaseId").alias("case_id"), F.col("f.Status").alias("status"),
        F.col("f.detail_Priority").alias("priority"), F.col("f.detail_Cust").alias("cust"),
    )


QUERIES["search_with_detail"] = search_with_detail
ORACLES["search_with_detail"] = """SELECT CAST(o_orderkey AS VARCHAR) AS case_id, o_orderstatus AS status,
    CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END AS priority,
    CASE WHEN o_orderstatus = 'F' THEN CAST(o_custkey AS VARCHAR) END AS cust FROM orders"""


def permit_csv(spark, sf_dir):
    """A permit CSV written and read back: kept and repeated rows per permit number."""
    from siteledger.session import scratch_path

    path = scratch_path(spark, "permits-csv")
    orders = table(spark, sf_dir, "orders")
    rows = orders.selectExpr(
        "concat(' ', CAST(o_custkey AS STRING), ' ') AS permit_number", "o_orderpriority AS description",
        "concat('\"', o_orderstatus, '\", line') AS address", "CAST(o_orderkey AS STRING) AS note",
    )
    rows.write.option("header", True).option("escape", '"').csv(path)
    landed = files.read_csv(spark, path, multi_line=False)
    read = files.permit_rows(landed, C.csv_source({}, "Mountain View")[0], C.CSV_FIELD_MAP)
    address = flat_fields(F.col("payload"), ["address"])["address"]
    return read.groupBy("source_record_id").agg(
        F.count("*").alias("rows_read"), F.count_if("skipped").alias("skipped"), F.max(address).alias("last_address")
    )


QUERIES["permit_csv"] = permit_csv
ORACLES["permit_csv"] = """SELECT CAST(o_custkey AS VARCHAR) AS source_record_id, count(*) AS rows_read,
    count(*) - 1 AS skipped, max('"' || o_orderstatus || '", line') AS last_address FROM orders GROUP BY 1"""


def manual_ingest(spark, sf_dir):
    """Hand-made records: accepted rows with their identity, rejected ones with the reason."""
    rows = orders_with_customers(spark, sf_dir).selectExpr(
        "CASE WHEN o_orderstatus = 'P' THEN '  ' ELSE concat(' ', o_orderpriority) END AS description",
        f"{_KEY} AS permit_number", "c_name AS company_name",
    )
    accepted, rejected = files.split_manual(rows, "manual")
    left = accepted.select("source_record_id", "description", F.lit(None).cast("string").alias("reason"))
    right = rejected.select(F.col("permit_number").alias("source_record_id"), "description", "reason")
    return left.unionByName(right)


QUERIES["manual_ingest"] = manual_ingest
ORACLES["manual_ingest"] = f"""SELECT {_KEY} AS source_record_id, CASE WHEN o_orderstatus = 'P' THEN '' ELSE o_orderpriority END AS description,
    CASE WHEN o_orderstatus = 'P' THEN 'missing description' END AS reason FROM orders"""

QUERIES["payload_keys"] = lambda spark, sf: records.payload_keys(table(spark, sf, "events"), "props")
ORACLES["payload_keys"] = "SELECT DISTINCT unnest(json_keys(props::JSON)) AS payload_key FROM events"


def union_sources(spark, sf_dir):
    """Two tables with different columns as one."""
    customer = table(spark, sf_dir, "customer").selectExpr("'customer' AS source", "c_custkey AS id", "c_name AS name", "c_mktsegment AS segment")
    supplier = table(spark, sf_dir, "supplier").selectExpr("'supplier' AS source", "s_suppkey AS id", "s_name AS name", "s_acctbal AS balance")
    return records.union_sources([customer, supplier])


QUERIES["union_sources"] = union_sources
ORACLES["union_sources"] = """SELECT 'customer' AS source, c_custkey AS id, c_name AS name, c_mktsegment AS segment, NULL::DOUBLE AS balance FROM customer
    UNION ALL SELECT 'supplier', s_suppkey, s_name, NULL, s_acctbal FROM supplier"""


_MIXED = {
    "spark": "CASE WHEN event_type = 'click' THEN date_format(ts, 'MM/dd/yyyy') ELSE CAST(CAST(ts AS DATE) AS STRING) END",
    "sql": "CASE WHEN event_type = 'click' THEN strftime(ts, '%m/%d/%Y') ELSE CAST(CAST(ts AS DATE) AS VARCHAR) END",
}


def source_watermarks(spark, sf_dir):
    """Newest date per event type, by date although one type writes another layout."""
    rows = table(spark, sf_dir, "events").selectExpr("event_type AS source", f"{_MIXED['spark']} AS seen")
    return records.high_water(rows, F.col("seen"), by_date=True)


QUERIES["source_watermarks"] = source_watermarks
_MARKS = f"SELECT event_type AS source, arg_max({_MIXED['sql']}, CAST(ts AS DATE)) AS watermark FROM events GROUP BY 1"
ORACLES["source_watermarks"] = _MARKS


def fetch_window(spark, sf_dir):
    """Start of the next fetch per source: given, else the mark, else the look-back; a start of a year ago stays."""
    marks = records.high_water(
        table(spark, sf_dir, "events").selectExpr("event_type AS source", "CAST(CAST(ts AS DATE) AS STRING) AS seen"), F.col("seen")
    )
    given = F.when(F.col("source") == "click", "2023-01-01")
    mark = F.when(F.col("source") != "view", F.col("watermark"))
    since = dates.fetch_since(given, mark, F.lit("2024-02-15").cast("date"), F.lit(30))
    return marks.select("source", since.alias("since"))


QUERIES["fetch_window"] = fetch_window
ORACLES["fetch_window"] = """WITH m AS (SELECT event_type AS source, max(CAST(CAST(ts AS DATE) AS VARCHAR)) AS w FROM events GROUP BY 1)
    SELECT source, CASE WHEN source = 'click' THEN '2023-01-01'
    WHEN source = 'view' THEN CAST(DATE '2024-02-15' - 30 AS VARCHAR) ELSE w END AS since FROM m"""


def recent_records(spark, sf_dir):
    """Client-side recency filter: unreadable and missing dates are kept."""
    rows = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey", f"CASE WHEN o_orderstatus = 'P' THEN 'soon' WHEN o_orderpriority = '5-LOW' THEN NULL ELSE CAST({_DAY} AS STRING) END AS d"
    )
    return rows.where(dates.is_recent(F.col("d"), F.lit("2000-01-01")))


QUERIES["recent_records"] = recent_records
ORACLES["recent_records"] = f"""WITH r AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'soon' WHEN o_orderpriority = '5-LOW' THEN NULL
    ELSE CAST({_DAY} AS VARCHAR) END AS d FROM orders)
    SELECT * FROM r WHERE d IS NULL OR d = 'soon' OR d >= '2000-01-01'"""


# Places of customers: most name a city of a region, some another state, some a ZIP only.
_PLACE_SQL = {
    "city": "CASE WHEN c_custkey % 5 = 0 THEN 'San  Jose!' WHEN c_custkey % 5 = 1 THEN 'St. Helena' WHEN c_custkey % 5 = 2 THEN 'Aptos' WHEN c_custkey % 5 = 3 THEN c_mktsegment END",
    "zip": "CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE concat(CAST(90000 + (c_custkey * 37) % 9000 AS STRING), '-1234') END",
    "state": "CASE WHEN c_nationkey % 4 = 0 THEN 'ca' WHEN c_nationkey % 4 = 1 THEN 'NV' WHEN c_nationkey % 4 = 2 THEN '' END",
}
_LOW = "CAST(90000 + (s_suppkey * 91) % 9000 AS INT)"
_HIGH = f"CAST({_LOW} + s_suppkey % 120 - 3 AS INT)"
_OWN_REGION = "concat('district-', CAST(s_nationkey AS STRING))"
_OWN_STATE = "CASE WHEN s_nationkey % 2 = 0 THEN 'CA' ELSE 'NV' END"


def region_table(spark, sf_dir):
    """Customers in the two named regions and in districts of ZIP ranges, one range a supplier."""
    named = {n: geo.REGIONS[n] for n in ("bay_area", "san_jose_50mi")}
    cities, ranges = regions.named_regions(spark, named)
    districts = table(spark, sf_dir, "supplier").selectExpr(f"{_OWN_REGION} AS region", f"{_OWN_STATE} AS state", f"{_LOW} AS low", f"{_HIGH} AS high")
    rows = table(spark, sf_dir, "customer").selectExpr("c_custkey", *[f"{e} AS {n}" for n, e in _PLACE_SQL.items()])
    return regions.with_regions(rows, cities, ranges.unionByName(districts)).select("c_custkey", "region")


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(repr(v) for v in row) + ")" for row in rows)


QUERIES["region_table"] = region_table
ORACLES["region_table"] = f"""WITH p AS (SELECT c_custkey, {', '.join(f'{e} AS {n}' for n, e in _PLACE_SQL.items())} FROM customer),
 r(region, state, low, high) AS (VALUES {_values((n, 'CA', a, b) for n in ('bay_area', 'san_jose_50mi') for a, b in geo.REGIONS[n].zip_ranges)}
   UNION ALL SELECT {_OWN_REGION}, {_OWN_STATE}, {_LOW}, {_HIGH} FROM supplier),
 c(region, city) AS (VALUES {_values((n, c) for n in ('bay_area', 'san_jose_50mi') for c in geo.REGIONS[n].cities)})
 SELECT c_custkey, region FROM p JOIN r ON CAST(left(zip, 5) AS INT) BETWEEN low AND high AND (coalesce(p.state, '') = '' OR upper(p.state) = r.state)
 UNION SELECT c_custkey, region FROM p JOIN c ON trim(regexp_replace(lower(p.city), '[^a-z0-9 ]', '', 'g')) = c.city AND (coalesce(p.state, '') = '' OR upper(p.state) = 'CA')"""


def typed_details(spark, sf_dir):
    """Search results with numbers and nested contacts merged with nested details: types and inner values of what comes out."""
    orders = table(spark, sf_dir, "orders")
    found = orders.selectExpr(
        """to_json(named_struct('CaseId', o_orderkey, 'Total', CAST(o_orderkey % 100 AS DOUBLE) + 0.5, '_contacts',
        array(named_struct('name', o_orderpriority, 'main', o_orderstatus = 'F')), 'detail_Priority', 'old')) AS payload"""
    )
    details = orders.where("o_orderstatus <> 'P'").selectExpr(
        "o_orderkey AS case_id", "to_json(named_struct('Result', named_struct('Priority', o_orderpriority, 'Place', named_struct('Zip', o_custkey, 'Open', o_orderstatus = 'O')))) AS response"
    )
    merged = records.merge_details(found, details).select(F.try_parse_json("payload").alias("v"))
    get = lambda path, kind: F.try_variant_get("v", path, kind)
    return merged.select(
        get("$.CaseId", "long").alias("case_id"), get("$.Total", "double").alias("total"), get("$._contacts[0].name", "string").alias("contact"),
        get("$._contacts[0].main", "boolean").alias("main"), get("$.detail_Priority", "string").alias("priority"), get("$.detail_Place.Zip", "long").alias("place_zip"),
        get("$.detail_Place.Open", "boolean").alias("place_open"),
        *[F.regexp_extract(F.schema_of_variant(get(f"$.{k}", "variant")), "^[A-Z]+", 0).alias(n) for k, n in (("CaseId", "id_type"), ("_contacts", "contact_type"), ("detail_Place", "place_type"))],
    )


QUERIES["typed_details"] = typed_details
ORACLES["typed_details"] = """SELECT o_orderkey AS case_id, CAST(o_orderkey % 100 AS DOUBLE) + 0.5 AS total, o_orderpriority AS contact, o_orderstatus = 'F' AS main,
    CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority ELSE 'old' END AS priority, CASE WHEN o_orderstatus <> 'P' THEN o_custkey END AS place_zip,
    CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus = 'O' END AS place_open, 'BIGINT' AS id_type, 'ARRAY' AS contact_type,
    CASE WHEN o_orderstatus <> 'P' THEN 'OBJECT' END AS place_type FROM orders"""


_PLAIN = C.FieldMap(record_id="id", permit_number="no", description=("work",), address=("place",), project_date=("on",), city="town")


def _plain(kind: str, name: str, **more) -> C.SourceConfig:
    return C.SourceConfig(type=kind, name=name, jurisdiction="Springfield", field_map=_PLAIN, **more)


# Source -> (configuration, table, id, text of the work, response around the record, day after which it is read).
_KINDS = {
    "array": (_plain(C.PERMIT_ARRAY, "array"), "customer", "c_custkey", "c_name", "array({})", "2001-07-01"),
    "catalog": (_plain(C.PORTAL, "catalog", record_path="result.records"), "supplier", "s_suppkey", "s_name", "named_struct('result', named_struct('records', array({})))", None),
    "civic": (_plain(C.PORTAL_ACCELA, "civic", record_path="result"), "part", "p_partkey", "p_name", "named_struct('result', array({}))", "2001-07-02"),
    "search": (
        replace(_plain(C.PORTAL_DETAIL, "search", detail_url_template="https://search.example.gov/{CaseId}"), field_map=replace(_PLAIN, record_id="CaseId", description=("detail_Work", "work"))),
        "orders", "o_orderkey", "o_orderpriority", "named_struct('Result', named_struct('EntityResults', array({})))", "2001-07-01",
    ),
}


def all_sources(spark, sf_dir):
    """All six kinds of sources landed in one table, each read from its own day on, as one project table."""
    path = scratch_path(spark, "landing")
    configs = {"features": FEATURE_CONFIG, "notices": NOTICE_CONFIG} | {n: k[0] for n, k in _KINDS.items()}
    landing.land(_feature_responses(spark, sf_dir), path, "features", F.lit("2001-07-01"))
    landing.land(notice_responses(spark, sf_dir), path, "notices", F.lit("2001-07-01"))
    for name, (_, of, key, work, around, _) in _KINDS.items():
        record = f"named_struct('id', {key}, 'CaseId', {key}, 'no', concat('N-', {key}), 'work', {work}, 'place', concat({key}, ' Main'), 'on', '2001-07-04', 'town', 'lake side')"
        rows = table(spark, sf_dir, of).selectExpr(f"to_json({around.format(record)}) AS response", f"date_add(DATE'2001-07-01', CAST({key} % 3 AS INT)) AS day")
        landing.land(rows, path, name, F.col("day"))
    details = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS case_id", "to_json(named_struct('Result', named_struct('Work', CASE WHEN o_orderstatus = 'F' THEN concat('Detail ', o_orderstatus) END))) AS response"
    )
    after = {n: k[-1] for n, k in _KINDS.items() if k[-1]}
    return landing.read_projects(spark, path, configs, after, {"search": {"details": details}}).select(
        "source", "source_record_id", "description", "project_date", "address", "city"
    )


def _kind_sql(name: str, of: str, key: str, work: str, after: str | None) -> str:
    text = f"CASE WHEN o_orderstatus = 'F' THEN 'Detail F' ELSE {work} END" if name == "search" else work
    later = f" WHERE {key} % 3 >= {int(after[-1])}" if after else ""
    return f"SELECT '{name}', CAST({key} AS VARCHAR), {text}, '2001-07-04', concat({key}, ' Main'), 'Lake Side' FROM {of}{later}"


QUERIES["all_sources"] = all_sources
ORACLES["all_sources"] = f"""SELECT 'features' AS source, source_record_id, description, project_date, address, city FROM ({ORACLES['feature_layer_permits']})
    UNION ALL SELECT 'notices', source_record_id, description, project_date, address, city FROM ({ORACLES['normalize_notices']})
    UNION ALL {' UNION ALL '.join(_kind_sql(n, k[1], k[2], k[3], k[5]) for n, k in _KINDS.items())}"""
