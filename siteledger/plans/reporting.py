"""Registered queries: reports, facets, search and export."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from siteledger.operators import leads as L
from siteledger.operators import paging
from siteledger.operators import profile as P
from siteledger.plans.tables import TODAY, lead_cte, leads, table
from siteledger.session import scratch_path
from siteledger.sources import sinks

QUERIES = {}
ORACLES = {}

_CONTACT = "(coalesce(email, '') <> '' OR coalesce(phone, '') <> '')"
_CATEGORY = "coalesce(nullif(category, ''), 'OTHER')"
_NEW = f"coalesce(left(first_seen, 10) >= CAST(DATE '{TODAY}' - 30 AS VARCHAR), false)"
_WINDOW = 30

_DAY = "try_cast(left(first_seen, 10) AS DATE)"
_MONDAY = f"CAST(date_trunc('week', {_DAY}) AS DATE)"
_SHORT = "CAST(month({0}) AS VARCHAR) || '/' || CAST(day({0}) AS VARCHAR)"
_LABEL = f"{_SHORT.format(_MONDAY)} || '–' || {_SHORT.format('(' + _MONDAY + ' + 6)')}"

_WEB = f"""web AS (
  SELECT source_record_id, coalesce(company_name, '') AS company, {_CATEGORY} AS category, coalesce(city, '') AS city,
         coalesce(address, '') AS address, coalesce(description, '') AS "desc", coalesce(email, '') AS email,
         coalesce(phone, '') AS phone, source, coalesce(project_date, '') AS date,
         coalesce(left(first_seen, 10), '') AS first_seen, {_NEW} AS is_new,
         coalesce(strftime({_DAY}, '%G-W%V'), 'unknown') AS week,
         coalesce({_LABEL}, '未知日期') AS week_label, coalesce(CAST({_MONDAY} AS VARCHAR), '') AS week_start
  FROM leads)"""


def _web(spark, sf_dir):
    return L.web_leads(leads(spark, sf_dir), TODAY, _WINDOW)


def _with(body: str, web: bool = False) -> str:
    return f"WITH {lead_cte()}{', ' + _WEB if web else ''} {body}"


def lead_report(spark, sf_dir):
    return L.lead_report(leads(spark, sf_dir), TODAY)


_REPORT = f"""SELECT count(*) AS total, count(*) FILTER ({_CONTACT}) AS with_contact,
    count(*) FILTER (NOT {_CONTACT}) AS pending,
    count(*) FILTER (coalesce(starts_with(first_seen, '{TODAY}'), false)) AS new_today,
    count(*) FILTER (contains(lower(source), 'sam')) AS rfp_leads,
    count(*) FILTER ({_CONTACT} AND (coalesce(license_number, '') <> '' OR contains(lower(source), 'sam'))) AS high_value,
    coalesce(count(*) FILTER ({_CONTACT}) / nullif(count(*), 0)::DOUBLE, 0) AS coverage FROM leads"""
QUERIES["lead_report"] = lead_report
ORACLES["lead_report"] = _with(_REPORT)

QUERIES["report_lines"] = lambda spark, sf: L.report_lines(lead_report(spark, sf)).select("line")
ORACLES["report_lines"] = f"""WITH {lead_cte()}, r AS ({_REPORT})
SELECT unnest([concat('线索总数：', total, '（有联系方式 ', with_contact, '，覆盖率 ', printf('%.0f', coverage * 100), '%）'),
  concat('本次新增：', new_today), concat('高价值线索：', high_value), concat('RFP（路径A）：', rfp_leads),
  concat('待补全（无联系方式）：', pending)]) AS line FROM r"""

QUERIES["category_coverage"] = lambda spark, sf: L.category_coverage(leads(spark, sf))
ORACLES["category_coverage"] = _with(
    f"""SELECT {_CATEGORY} AS category, count(*) AS total, count(*) FILTER ({_CONTACT}) AS with_contact,
    count(*) FILTER ({_CONTACT}) / count(*)::DOUBLE AS coverage FROM leads GROUP BY 1"""
)

QUERIES["web_leads"] = lambda spark, sf: _web(spark, sf).select(
    "source_record_id", "company", "category", "city", "address", "desc", "email", "phone", "source", "date",
    "first_seen", "is_new", "week", "week_label", "week_start",
)
ORACLES["web_leads"] = _with("SELECT * FROM web", web=True)

QUERIES["category_facets"] = lambda spark, sf: L.category_facets(_web(spark, sf))
ORACLES["category_facets"] = _with(
    "SELECT category, count(*) AS n, count(*) FILTER (is_new) AS n_new FROM web GROUP BY 1", web=True
)

QUERIES["week_cohorts"] = lambda spark, sf: L.week_cohorts(_web(spark, sf))
ORACLES["week_cohorts"] = _with(
    "SELECT week, week_label AS label, week_start AS monday, count(*) AS n FROM web GROUP BY 1, 2, 3", web=True
)

QUERIES["distinct_cities"] = lambda spark, sf: L.cities(_web(spark, sf))
ORACLES["distinct_cities"] = _with("SELECT DISTINCT city FROM web WHERE city <> ''", web=True)

QUERIES["web_totals"] = lambda spark, sf: L.web_totals(_web(spark, sf))
_TOTALS = f"count(*) AS total, count(*) FILTER ({_CONTACT}) AS with_contact, count(*) FILTER (is_new) AS new_count"
ORACLES["web_totals"] = _with(f"SELECT {_TOTALS} FROM web", web=True)

QUERIES["latest_week_stats"] = lambda spark, sf: L.scoped_stats(L.latest_week(_web(spark, sf)))
ORACLES["latest_week_stats"] = _with(
    f"""SELECT {_TOTALS}, CAST(round(count(*) FILTER ({_CONTACT}) * 100.0 / count(*)) AS BIGINT) AS coverage_percent
    FROM web WHERE week = (SELECT arg_max(week, week_start) FROM web)""",
    web=True,
)

QUERIES["latest_week_facets"] = lambda spark, sf: L.scoped_facets(L.latest_week(_web(spark, sf)))
ORACLES["latest_week_facets"] = _with(
    """SELECT category, count(*) AS n, count(*) FILTER (is_new) AS n_new FROM web
    WHERE week = (SELECT arg_max(week, week_start) FROM web) GROUP BY 1""",
    web=True,
)

_SEARCH = dict(category="COMMERCIAL_TI", contact=True, query="BY customer#0000")


def lead_search_page(spark, sf_dir):
    """Second page (a page is the feature) of a faceted search, new leads first."""
    rows = L.search(_web(spark, sf_dir), **_SEARCH)
    return L.page(rows, 2).select("source_record_id", "company", "category", "city", "date", "first_seen", "is_new", "week")


QUERIES["lead_search_page"] = lead_search_page
ORACLES["lead_search_page"] = _with(
    f"""SELECT source_record_id, company, category, city, date, first_seen, is_new, week FROM web
    WHERE category = 'COMMERCIAL_TI' AND {_CONTACT}
      AND contains(lower(concat_ws(' ', company, address, "desc", email)), 'by customer#0000')
    ORDER BY is_new DESC, date DESC, first_seen DESC, category, source DESC, source_record_id DESC LIMIT 50 OFFSET 50""",
    web=True,
)

QUERIES["lead_search"] = lambda spark, sf: L.search(_web(spark, sf), city="NATION_3", contact=False).select(
    "source_record_id", "category", "city"
)
ORACLES["lead_search"] = _with(
    f"SELECT source_record_id, category, city FROM web WHERE city = 'NATION_3' AND NOT {_CONTACT}", web=True
)

def exportable_leads(spark, sf_dir):
    """Exportable leads, whether each follows its predecessor in the written order."""
    from siteledger.session import scratch_path

    path = scratch_path(spark, "ordered-leads")
    ordered = L.lead_order(L.exportable(leads(spark, sf_dir))).select("source", "source_record_id", "category", "project_date")
    ordered.withColumn("position", F.monotonically_increasing_id()).write.parquet(path)
    back = spark.read.parquet(path)
    # The written position is turned into a place within the category, as ids leave gaps between partitions.
    place = F.row_number().over(Window.partitionBy("category").orderBy("position"))
    return back.withColumn("place", place).drop("position")


QUERIES["exportable_leads"] = exportable_leads
ORACLES["exportable_leads"] = _with(
    """SELECT source, source_record_id, category, project_date, row_number() OVER (PARTITION BY category
    ORDER BY project_date DESC NULLS LAST, first_seen DESC NULLS LAST, source DESC, source_record_id DESC) AS place FROM leads WHERE duplicate_of IS NULL"""
)

QUERIES["enrichment_targets"] = lambda spark, sf: L.enrichment_targets(leads(spark, sf)).select(
    "source", "source_record_id", "company_key"
)
_TARGETS = "duplicate_of IS NULL AND (company_name IS NULL OR (email IS NULL AND phone IS NULL))"
ORACLES["enrichment_targets"] = _with(f"SELECT source, source_record_id, company_key FROM leads WHERE {_TARGETS}")

_EXPORT_COLUMNS = (
    "source", "source_record_id", "description", "city", "project_date", "bid_deadline", "company_name", "email", "phone",
    "first_seen", "source_url", "has_deadline", "sheet",
)


def _export(spark, sf_dir):
    return L.export_rows(L.in_window(L.exportable(leads(spark, sf_dir)), TODAY, 900))


_SHEET = f"CASE WHEN NOT {_CONTACT} THEN 'PENDING' ELSE {_CATEGORY} END"
_EXPORT = f"""SELECT source, source_record_id, description, city, project_date, bid_deadline, company_name, email, phone,
    split_part(first_seen, 'T', 1) AS first_seen, source_url, coalesce(bid_deadline, '') <> '' AS has_deadline,
    {_SHEET} AS sheet FROM leads WHERE duplicate_of IS NULL
    AND (project_date IS NULL OR CAST(project_date AS DATE) >= DATE '{TODAY}' - 900)"""
QUERIES["export_rows"] = lambda spark, sf: _export(spark, sf).select(*_EXPORT_COLUMNS)
ORACLES["export_rows"] = _with(_EXPORT)

QUERIES["export_stats"] = lambda spark, sf: L.export_stats(_export(spark, sf))
ORACLES["export_stats"] = f"""WITH {lead_cte()}, e AS ({_EXPORT}) SELECT count(*) AS total,
    count(*) FILTER (sheet <> 'PENDING') AS exported, count(*) FILTER (sheet = 'PENDING') AS pending FROM e"""


def export_split(spark, sf_dir):
    """Write the split export, move the pointer, and read the newest run back."""
    from siteledger.session import scratch_path
    from siteledger.sources import sinks

    root = scratch_path(spark, "export")
    sinks.write_export(_export(spark, sf_dir), root, "r1")
    sinks.point_latest(spark, root, "r1")
    back = spark.read.parquet(f"{root}/run={sinks.latest_run(spark, root)}/parquet")
    return back.groupBy(F.col("sheet").cast("string").alias("sheet")).agg(F.count("*").alias("n"))


QUERIES["export_split"] = export_split
ORACLES["export_split"] = f"WITH {lead_cte()}, e AS ({_EXPORT}) SELECT sheet, count(*) AS n FROM e GROUP BY 1"


def column_buckets(spark, sf_dir):
    """Parts as data set columns: the brand is the data set, the part name one of its columns."""
    columns = table(spark, sf_dir, "part").select(F.col("p_brand").alias("dataset"), F.col("p_name").alias("column"))
    return P.dataset_verdicts(columns, contractor=("red_",  "hot"), owner=("bolt", "gear"))


QUERIES["column_buckets"] = column_buckets
ORACLES["column_buckets"] = """WITH c AS (SELECT p_brand AS dataset, p_name AS col,
    CASE WHEN contains(p_name, 'red') OR contains(p_name, 'hot') THEN 'c'
         WHEN contains(p_name, 'bolt') OR contains(p_name, 'gear') THEN 'o' END AS b FROM part),
 g AS (SELECT dataset, coalesce(array_to_string(list_sort(list_distinct(list(col) FILTER (b = 'c'))), ','), '') AS contractor_fields,
    coalesce(array_to_string(list_sort(list_distinct(list(col) FILTER (b = 'o'))), ','), '') AS owner_fields,
    count(*) AS field_count FROM c GROUP BY 1)
 SELECT *, contractor_fields <> '' AS has_contractor, CASE WHEN contractor_fields <> '' THEN 'candidate'
    WHEN owner_fields <> '' THEN 'owner-only' ELSE 'no-contact-fields' END AS verdict FROM g"""


def dataset_freshness(spark, sf_dir):
    """Newest date per order status of the first known date column with one; US layout without padding, and epoch numbers."""
    rows = table(spark, sf_dir, "lineitem").selectExpr(
        "l_linestatus", "CASE WHEN l_linestatus = 'O' THEN 'soon' WHEN l_returnflag = 'R' THEN NULL ELSE date_format(l_shipdate, 'M/d/yyyy') END AS issue_date",
        "CAST(datediff(CAST(l_shipdate AS DATE), DATE '1970-01-01') * 86400000L AS STRING) AS received_date",
    )
    return P.freshness(rows, ["l_linestatus"])


QUERIES["dataset_freshness"] = dataset_freshness
ORACLES["dataset_freshness"] = """WITH m AS (SELECT l_linestatus, max(CAST(l_shipdate AS DATE)) FILTER (l_returnflag <> 'R') AS d, max(CAST(l_shipdate AS DATE)) AS e FROM lineitem GROUP BY 1)
    SELECT l_linestatus, CASE WHEN l_linestatus = 'O' THEN CAST(CAST(datediff('day', DATE '1970-01-01', e) AS BIGINT) * 86400000 AS VARCHAR)
    ELSE concat(month(d), '/', day(d), '/', year(d)) END AS latest_date FROM m"""


def dataset_relevance(spark, sf_dir):
    """Documents that name a place (spaces do not count) and a term."""
    docs = table(spark, sf_dir, "documents")
    return docs.where(P.is_relevant(F.lit("On The"), F.col("text"), ("ing the", "der"))).select("doc_id", "lang")


QUERIES["dataset_relevance"] = dataset_relevance
ORACLES["dataset_relevance"] = """SELECT doc_id, lang FROM documents
    WHERE (contains(lower(text), 'on the') OR contains(replace(lower(text), ' ', ''), 'onthe'))
      AND (contains(lower(text), 'ing the') OR contains(lower(text), 'der'))"""


def web_document(spark, sf_dir):
    """The facet tables of the viewer document, written and read back."""
    path = scratch_path(spark, "web")
    target = sinks.write_web_document(_web(spark, sf_dir), path, "1", TODAY)
    read = lambda name, schema: spark.read.schema(schema).json(f"{target}/{name}")
    none = F.lit(None)
    totals = read("totals", "total long, with_contact long, new_count long").select(F.lit("total").alias("kind"), none.cast("string").alias("key"), none.cast("string").alias("label"), F.col("total").alias("n"), F.col("new_count").alias("n_new"), "with_contact")
    categories = read("categories", "category string, n long, n_new long").select(F.lit("category"), "category", none, "n", "n_new", none)
    weeks = read("weeks", "week string, label string, monday string, n long").select(F.lit("week"), "week", F.concat_ws(" ", "label", "monday"), "n", none, none)
    cities = read("cities", "city string").select(F.lit("city"), "city", none, none, none, none)
    leads_ = read("leads", "category string").select(F.lit("leads"), none, none, F.lit(1), none, none).groupBy().agg(F.count("*").alias("n"))
    rows = leads_.select(F.lit("leads"), none, none, "n", none, none)
    return totals.union(categories).union(weeks).union(cities).union(rows)


QUERIES["web_document"] = web_document
ORACLES["web_document"] = _with(
    """SELECT 'total' AS kind, NULL AS key, NULL AS label, count(*) AS n, count(*) FILTER (WHERE is_new) AS n_new, count(*) FILTER (WHERE email <> '' OR phone <> '') AS with_contact FROM web
    UNION ALL SELECT 'category', category, NULL, count(*), count(*) FILTER (WHERE is_new), NULL FROM web GROUP BY category
    UNION ALL SELECT 'week', week, trim(week_label || ' ' || week_start, ' ') || CASE WHEN week_start = '' THEN ' ' ELSE '' END, count(*), NULL, NULL FROM web GROUP BY week, week_label, week_start
    UNION ALL SELECT DISTINCT 'city', city, NULL, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT FROM web WHERE city <> ''
    UNION ALL SELECT 'leads', NULL, NULL, count(*), NULL, NULL FROM web""",
    web=True,
)


def web_facets(spark, sf_dir):
    """Totals, categories, weeks and cities by grouping sets."""
    return L.web_facets(_web(spark, sf_dir))


QUERIES["web_facets"] = web_facets
_COUNTS = "count(*) AS n, count(*) FILTER (WHERE is_new) AS n_new, count(*) FILTER (WHERE email <> '' OR phone <> '') AS with_contact FROM web"
ORACLES["web_facets"] = _with(
    f"""SELECT 'total' AS kind, NULL AS key, NULL AS label, NULL AS monday, {_COUNTS}
    UNION ALL SELECT 'category', category, NULL, NULL, {_COUNTS} GROUP BY category
    UNION ALL SELECT 'week', week, week_label, week_start, {_COUNTS} GROUP BY week, week_label, week_start
    UNION ALL SELECT 'city', city, NULL, NULL, {_COUNTS} WHERE city <> '' GROUP BY city""",
    web=True,
)


def unclassified_batch(spark, sf_dir):
    """The first 500 (the batch is the feature) leads without a category, by id."""
    return L.unclassified(leads(spark, sf_dir), 500).select("source", "source_record_id", "category")


QUERIES["unclassified_batch"] = unclassified_batch
ORACLES["unclassified_batch"] = _with(
    "SELECT source, source_record_id, category FROM leads WHERE category IS NULL ORDER BY source, source_record_id LIMIT 500"
)


def enrichment_batch(spark, sf_dir):
    """The first 200 (the batch is the feature) office leads that need contacts, by id."""
    return L.enrichment_batch(leads(spark, sf_dir), 200, "OFFICE_LAB").select("source", "source_record_id", "company_key")


QUERIES["enrichment_batch"] = enrichment_batch
ORACLES["enrichment_batch"] = _with(
    f"""SELECT source, source_record_id, company_key FROM leads WHERE {_TARGETS} AND category = 'OFFICE_LAB'
    ORDER BY source, source_record_id LIMIT 200"""
)

_PAGE = ("source_record_id", "company", "category", "city", "date", "first_seen", "is_new", "week")


def lead_page_directory(spark, sf_dir):
    """The middle page (a page is the feature) of all leads, new ones first, by a directory of ranges."""
    directory = paging.write_directory(_web(spark, sf_dir), L.newness(), scratch_path(spark, "pages"), 16)
    return paging.read_page(spark, directory, directory.pages(50) // 2, 50).select("row_no", *_PAGE)


QUERIES["lead_page_directory"] = lead_page_directory
ORACLES["lead_page_directory"] = _with(
    f"""SELECT row_no, {', '.join(_PAGE)} FROM (SELECT *, row_number() OVER (ORDER BY is_new DESC, date DESC, first_seen DESC, category,
      source DESC, source_record_id DESC) - 1 AS row_no, (SELECT greatest(1, ceil(count(*) / 50.0) // 2) FROM web) AS page FROM web)
    WHERE row_no // 50 = page - 1""",
    web=True,
)


def _findings(spark, sf_dir):
    """Brands as data sets of a city (the part type), part names as their columns, prices as their dates."""
    part = table(spark, sf_dir, "part")
    named = part.select(F.concat_ws("/", "p_type", "p_brand").alias("dataset"), F.col("p_name").alias("column")).distinct()
    verdicts = P.dataset_verdicts(named, contractor=("red widget", "hot bolt"), owner=("cold gear",))
    fields = lambda c: F.filter(F.split(c, ","), lambda x: x != "")
    city, brand = F.split_part("dataset", F.lit("/"), F.lit(1)), F.split_part("dataset", F.lit("/"), F.lit(2))
    return verdicts.select(
        city.alias("city"), F.when(city != "ECONOMY", F.lower(city)).otherwise("").alias("county"), F.lit("catalog").alias("source_kind"),
        brand.alias("title"), F.concat(F.lit("https://data.example.gov/"), "dataset").alias("dataset_url"),
        F.when(brand != "Brand#7", F.concat(F.lit("https://data.example.gov/api/"), "dataset")).alias("api_url"), F.lit("data.example.gov").alias("domain"),
        fields(F.replace("contractor_fields", F.lit(" "), F.lit("_"))).alias("contractor_fields"), fields(F.replace("owner_fields", F.lit(" "), F.lit("_"))).alias("owner_fields"),
        F.col("field_count").alias("sample_field_count"), F.when(brand == "Brand#3", "2001-01-01").alias("latest_date"),
        F.when(brand == "Brand#5", F.array(F.lit("slow"), F.lit("old"))).otherwise(F.array().cast("array<string>")).alias("notes"),
    )


def discovery_report(spark, sf_dir):
    """The lines of the markdown report with what orders them."""
    return P.findings_lines(_findings(spark, sf_dir))


_FOUND = """n AS (SELECT p_type AS city, p_brand AS title, replace(p_name, ' ', '_') AS c FROM part),
 v AS (SELECT city, title, coalesce(list_sort(list(DISTINCT c) FILTER (c IN ('red_widget', 'hot_bolt'))), []) AS cf,
   coalesce(list_sort(list(DISTINCT c) FILTER (c = 'cold_gear')), []) AS ow, count(DISTINCT c) AS n,
   CASE WHEN city <> 'ECONOMY' THEN lower(city) ELSE '' END AS county, 'https://data.example.gov/' || city || '/' || title AS url,
   CASE WHEN title <> 'Brand#7' THEN 'https://data.example.gov/api/' || city || '/' || title END AS api,
   CASE WHEN title = 'Brand#3' THEN '2001-01-01' END AS latest, CASE WHEN title = 'Brand#5' THEN ['slow', 'old'] ELSE [] END AS notes FROM n GROUP BY 1, 2),
 f AS (SELECT *, CASE WHEN len(cf) > 0 THEN 'candidate' WHEN len(ow) > 0 THEN 'owner-only' ELSE 'no-contact-fields' END AS verdict FROM v)"""
_NO_ITEM = "NULL AS source_kind, NULL AS title, NULL AS dataset_url"
QUERIES["discovery_report"] = discovery_report
ORACLES["discovery_report"] = f"""WITH {_FOUND},
 c AS (SELECT city, min(county) AS county, max(len(cf)) > 0 AS has_some FROM f GROUP BY 1),
 l AS (SELECT '' AS city, -1 AS part, {_NO_ITEM}, ['# Source Discovery Report', ''] AS lines
  UNION ALL SELECT city, 0, {_NO_ITEM}, ['## ' || city || CASE WHEN county <> '' THEN ' (' || county || ')' ELSE '' END] ||
    CASE WHEN has_some THEN ['**Has contractor-shaped fields — promote to sources.yaml after manual review.**', ''] ELSE ['_No contractor-shaped dataset found._'] END FROM c
  UNION ALL SELECT city, 1, 'catalog', title, url, list_filter(['- **catalog** · ' || verdict || ' · ' || title, '  - API: ' || api,
    CASE WHEN len(cf) > 0 THEN '  - contractor fields: ' || array_to_string(cf, ', ') END, CASE WHEN len(ow) > 0 THEN '  - owner/applicant fields: ' || array_to_string(ow, ', ') END,
    '  - latest record date: ' || latest, CASE WHEN len(notes) > 0 THEN '  - notes: ' || array_to_string(notes, '; ') END], lambda x: x IS NOT NULL) FROM f
  UNION ALL SELECT city, 2, {_NO_ITEM}, [''] FROM c)
 SELECT city, part, source_kind, title, dataset_url, i - 1 AS line_no, lines[i] AS line FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS i FROM l)"""


def discovery_rows(spark, sf_dir):
    """The JSON rows of the discovery report, written and read back."""
    target = sinks.write_findings(_findings(spark, sf_dir), scratch_path(spark, "findings"), "1")
    schema = "city string, county string, source_kind string, title string, dataset_url string, api_url string, has_contractor boolean, contractor_fields array<string>, owner_fields array<string>, sample_field_count long, latest_date string, verdict string, notes array<string>"
    joined = {c: F.array_join(c, ",") for c in ("contractor_fields", "owner_fields", "notes")}
    return spark.read.schema(schema).json(f"{target}/rows").withColumns(joined)


QUERIES["discovery_rows"] = discovery_rows
ORACLES["discovery_rows"] = f"""WITH {_FOUND} SELECT city, county, 'catalog' AS source_kind, title, url AS dataset_url, api AS api_url, len(cf) > 0 AS has_contractor,
  coalesce(array_to_string(cf, ','), '') AS contractor_fields, coalesce(array_to_string(ow, ','), '') AS owner_fields, n AS sample_field_count, latest AS latest_date, verdict,
  coalesce(array_to_string(notes, ','), '') AS notes FROM f"""
