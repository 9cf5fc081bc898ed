"""The lead view and the filters and reports over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteledger.functions import dates
from siteledger.functions.payload import fill_template
from siteledger.functions.text import cap_text, has_contact, null_if_empty
from siteledger.schemas import CATEGORIES, OTHER

LEAD_ORDER = ("source", "source_record_id")


def with_companies(projects: DataFrame, companies: DataFrame) -> DataFrame:
    """Projects left-joined with their company's contact fields."""
    side = companies.select(
        "company_key", F.col("name").alias("company_name"), "email", "phone", "website", "license_number"
    )
    return projects.join(side, "company_key", "left")


def exportable(leads: DataFrame, category: str | None = None) -> DataFrame:
    """Leads that are not duplicates, optionally of one category."""
    rows = leads.where("duplicate_of is null")
    return rows.where(F.col("category") == category) if category else rows


def enrichment_targets(leads: DataFrame, category: str | None = None) -> DataFrame:
    """Exportable leads without a company, or whose company has neither e-mail nor phone."""
    return exportable(leads, category).where("company_name is null or (email is null and phone is null)")


def _batch(rows: DataFrame, limit: int | None) -> DataFrame:
    ordered = rows.orderBy(*LEAD_ORDER)
    return ordered.limit(limit) if limit else ordered


def unclassified(projects: DataFrame, limit: int | None = None) -> DataFrame:
    """Projects without a category by id, at most ``limit`` of them where one is given."""
    return _batch(projects.where("category is null"), limit)


def enrichment_batch(leads: DataFrame, limit: int | None = None, category: str | None = None) -> DataFrame:
    """Enrichment targets by id, at most ``limit`` of them where one is given."""
    return _batch(enrichment_targets(leads, category), limit)


def lead_order(leads: DataFrame) -> DataFrame:
    """Category, newest project date first, newest record first."""
    return leads.orderBy(
        F.asc("category"), F.desc("project_date"), F.desc("first_seen"), *[F.desc(c) for c in LEAD_ORDER]
    )


def _category() -> Column:
    return F.coalesce(null_if_empty(F.col("category")), F.lit(OTHER))


def is_solicitation(source: Column, marker: str = "sam") -> Column:
    return F.coalesce(F.lower(source).contains(marker), F.lit(False))


def lead_report(leads: DataFrame, today: str, marker: str = "sam") -> DataFrame:
    """One row: totals, contact coverage, new today, solicitations, high-value leads."""
    contact = has_contact(F.col("email"), F.col("phone"))
    licensed = F.coalesce(F.length("license_number") > 0, F.lit(False))
    rfp = is_solicitation(F.col("source"), marker)
    fresh = F.coalesce(F.startswith(F.col("first_seen").cast("string"), F.lit(today)), F.lit(False))
    return leads.agg(
        F.count("*").alias("total"),
        F.count_if(contact).alias("with_contact"),
        F.count_if(~contact).alias("pending"),
        F.count_if(fresh).alias("new_today"),
        F.count_if(rfp).alias("rfp_leads"),
        F.count_if(contact & (licensed | rfp)).alias("high_value"),
    ).withColumn(
        "coverage", F.coalesce(F.try_divide(F.col("with_contact").cast("double"), F.col("total").cast("double")), F.lit(0.0))
    )


def category_coverage(leads: DataFrame) -> DataFrame:
    contact = has_contact(F.col("email"), F.col("phone"))
    return (
        leads.groupBy(_category().alias("category"))
        .agg(F.count("*").alias("total"), F.count_if(contact).alias("with_contact"))
        .withColumn("coverage", F.col("with_contact").cast("double") / F.col("total").cast("double"))
        .orderBy("category")
    )


# The summary lines.
REPORT_LINES = (
    "线索总数：{total}（有联系方式 {with_contact}，覆盖率 {percent}%）",
    "本次新增：{new_today}",
    "高价值线索：{high_value}",
    "RFP（路径A）：{rfp_leads}",
    "待补全（无联系方式）：{pending}",
)
FAILURE_LINE = "原因：{reason}\n（已保留上一次 Excel）"


def report_lines(report: DataFrame) -> DataFrame:
    """The report as text lines."""
    staged = report.withColumn("percent", F.format_string("%.0f", F.col("coverage") * 100))
    fields = F.struct(*staged.columns)
    lines = F.array(*[fill_template(line, fields) for line in REPORT_LINES])
    return staged.select(F.posexplode(lines).alias("line_no", "line"))


def failure_lines(spark, reason: str) -> DataFrame:
    return spark.createDataFrame([(0, FAILURE_LINE.format(reason=reason))], "line_no int, line string")


def web_leads(leads: DataFrame, today: str, window_days: int = 7, cap: int | None = None) -> DataFrame:
    """Lead rows of the viewer document, with ``is_new`` and the ISO week; ``cap`` shortens the shown description."""
    week = dates.iso_week(F.col("first_seen"))

    def text(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(""))

    return leads.select(
        *[F.col(c) for c in LEAD_ORDER if c != "source"],
        text("company_name").alias("company"),
        _category().alias("category"),
        text("city").alias("city"),
        text("county").alias("county"),
        text("address").alias("address"),
        (cap_text(text("description"), cap) if cap else text("description")).alias("desc"),
        text("email").alias("email"),
        text("phone").alias("phone"),
        text("source").alias("source"),
        text("project_date").alias("date"),
        dates.first_seen_day(F.col("first_seen")).alias("first_seen"),
        text("source_url").alias("url"),
        text("license_number").alias("license"),
        dates.is_new(F.col("first_seen"), today, window_days).alias("is_new"),
        week["key"].alias("week"),
        week["label"].alias("week_label"),
        week["monday"].alias("week_start"),
    )


def newness() -> list[Column]:
    """New leads first, then by project date and first-seen day, newest first; a total order."""
    return [F.desc("is_new"), F.desc("date"), F.desc("first_seen"), F.asc("category"), *[F.desc(c) for c in LEAD_ORDER]]


def new_first(web: DataFrame) -> DataFrame:
    """Leads by ``newness``."""
    return web.orderBy(*newness())


def web_totals(web: DataFrame) -> DataFrame:
    return web.agg(
        F.count("*").alias("total"),
        F.count_if(has_contact(F.col("email"), F.col("phone"))).alias("with_contact"),
        F.count_if("is_new").alias("new_count"),
    )


def category_facets(web: DataFrame) -> DataFrame:
    return web.groupBy("category").agg(F.count("*").alias("n"), F.count_if("is_new").alias("n_new")).orderBy("category")


def week_cohorts(web: DataFrame) -> DataFrame:
    """Leads per ISO week, newest first, unreadable days last."""
    return (
        web.groupBy(F.col("week"), F.col("week_label").alias("label"), F.col("week_start").alias("monday"))
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("monday"))
    )


def cities(web: DataFrame) -> DataFrame:
    return web.where(F.length("city") > 0).select("city").distinct().orderBy("city")


def web_facets(web: DataFrame) -> DataFrame:
    """Totals, categories, weeks and cities in one pass over the leads: kind, key, label, monday, n, n_new, with_contact.

    The four groupings are one expand and one aggregate, so the leads are read once however many facets there are.
    """
    week = ["week", "week_label", "week_start"]
    sets = web.groupingSets([[], ["category"], week, ["city"]], "category", *week, "city")
    by = lambda c: F.grouping(c) == 0
    kind = F.when(by("category"), "category").when(by("week"), "week").when(by("city"), "city").otherwise("total")
    counted = sets.agg(
        kind.alias("kind"),
        F.count("*").alias("n"),
        F.count_if("is_new").alias("n_new"),
        F.count_if(has_contact(F.col("email"), F.col("phone"))).alias("with_contact"),
    )
    key = F.coalesce("category", "week", "city")
    facets = counted.select("kind", key.alias("key"), F.col("week_label").alias("label"), F.col("week_start").alias("monday"), "n", "n_new", "with_contact")
    return facets.where("kind <> 'city' OR length(key) > 0")


def latest_week(web: DataFrame) -> DataFrame:
    """Leads of the newest cohort, found by one tiny aggregate that is joined back."""
    newest = web.agg(F.max_by("week", "week_start").alias("week"))
    return web.join(F.broadcast(newest), "week", "left_semi")


def scoped_stats(web: DataFrame, week: str | None = None) -> DataFrame:
    scope = web.where(F.col("week") == week) if week else web
    totals = web_totals(scope)
    percent = F.round(F.try_divide(F.col("with_contact") * 100.0, F.col("total").cast("double"))).cast("bigint")
    return totals.withColumn("coverage_percent", F.coalesce(percent, F.lit(0).cast("bigint")))


def scoped_facets(web: DataFrame, week: str | None = None) -> DataFrame:
    """Category facets within a week, largest first."""
    scope = web.where(F.col("week") == week) if week else web
    facets = scope.groupBy("category").agg(F.count("*").alias("n"), F.count_if("is_new").alias("n_new"))
    return facets.orderBy(F.desc("n"), F.asc("category"))


def search(
    web: DataFrame,
    week: str | None = None,
    category: str | None = None,
    city: str | None = None,
    contact: bool | None = None,
    query: str | None = None,
) -> DataFrame:
    """Faceted search: every given facet narrows the result."""
    rows = web
    for name, value in (("week", week), ("category", category), ("city", city)):
        if value:
            rows = rows.where(F.col(name) == value)
    if contact is not None:
        reachable = has_contact(F.col("email"), F.col("phone"))
        rows = rows.where(reachable if contact else ~reachable)
    if query:
        rows = rows.where(F.lower(F.concat_ws(" ", "company", "address", "desc", "email")).contains(query.lower()))
    return rows


def page(rows: DataFrame, number: int, size: int = 50) -> DataFrame:
    """One page of the new-first order; a number past either end gives the first or last page."""
    return new_first(rows).offset((min(max(1, number), last_page(rows, size)) - 1) * size).limit(size)


def last_page(rows: DataFrame, size: int = 50) -> int:
    return max(1, -(-rows.count() // size))


def in_window(leads: DataFrame, today: str, lookback_days: int = 90) -> DataFrame:
    """Leads whose project date lies in the export window; undated ones stay."""
    day = dates.export_date(F.col("project_date"))
    return leads.where(day.isNull() | (day >= F.date_sub(F.lit(today).cast("date"), lookback_days)))


PENDING = "PENDING"
# Column headings of the spreadsheet export, in order.
EXPORT_HEADINGS = {
    "description": "项目描述",
    "city": "城市",
    "project_date": "日期",
    "bid_deadline": "投标截止",
    "company_name": "公司名",
    "email": "邮箱",
    "phone": "电话",
    "first_seen": "首次发现日期",
    "source_url": "来源链接",
}


def export_rows(leads: DataFrame) -> DataFrame:
    """Nine-column export with its sheet: the category of a reachable lead, else PENDING."""
    reachable = has_contact(F.col("email"), F.col("phone"))
    category = _category()
    known = category.isin(*CATEGORIES)
    return leads.select(
        *LEAD_ORDER,
        "description",
        "city",
        "project_date",
        "bid_deadline",
        "company_name",
        "email",
        "phone",
        F.regexp_extract(F.col("first_seen").cast("string"), "^[^T ]*", 0).alias("first_seen"),
        "source_url",
        (F.length(F.coalesce("bid_deadline", F.lit(""))) > 0).alias("has_deadline"),
        F.when(~reachable, F.lit(PENDING)).when(known, category).otherwise(F.lit(OTHER)).alias("sheet"),
    )


def export_stats(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("sheet") != PENDING).alias("exported"),
        F.count_if(F.col("sheet") == PENDING).alias("pending"),
    )
