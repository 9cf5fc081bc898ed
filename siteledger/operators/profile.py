"""Profiles of candidate datasets: relevance, contact columns, freshness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteledger.functions.dates import epoch_ms_day, parse_date

# Column-name hints, permit terms and date columns in priority order.
CONTRACTOR_WORDS = (
    "contractor", "contracting", "licensee", "license_no", "license_number", "license_num", "licensenumber",
    "firm_name", "business_name", "company_name", "contractorname", "contractor_name", "primary_contractor",
)
OWNER_WORDS = (
    "owner", "owner_name", "applicant", "applicant_name", "applicant_first", "applicant_last", "project_name", "homeowner",
)
PERMIT_TERMS = ("building permit", "permit", "construction permit")
DATE_COLUMNS = ("issued_date", "issue_date", "data_loaded_at", "received_date", "most_recent_issued_received_date", "application_date")


def _any(text: Column, words: tuple[str, ...]) -> Column:
    hit = text.contains(words[0])
    for word in words[1:]:
        hit = hit | text.contains(word)
    return hit


def _compact(words: tuple[str, ...]) -> tuple[str, ...]:
    return tuple(dict.fromkeys(w.replace("_", "") for w in words))


def column_bucket(
    name: Column, contractor: tuple[str, ...] = CONTRACTOR_WORDS, owner: tuple[str, ...] = OWNER_WORDS
) -> Column:
    """``contractor``, ``owner`` or NULL for a column name, ignoring case, ``_`` and ``-``."""
    flat = F.regexp_replace(F.lower(name), "[_-]", "")
    return F.when(_any(flat, _compact(contractor)), "contractor").when(_any(flat, _compact(owner)), "owner")


def dataset_verdicts(columns: DataFrame, **words) -> DataFrame:
    """(dataset, column) rows -> contact columns and verdict per dataset."""
    staged = columns.select("dataset", F.col("column").alias("c"), column_bucket(F.col("column"), **words).alias("b"))

    def listed(bucket: str) -> Column:
        return F.array_join(F.array_sort(F.collect_set(F.when(F.col("b") == bucket, F.col("c")))), ",")

    return (
        staged.groupBy("dataset")
        .agg(listed("contractor").alias("contractor_fields"), listed("owner").alias("owner_fields"), F.count("*").alias("field_count"))
        .withColumn("has_contractor", F.length("contractor_fields") > 0)
        .withColumn(
            "verdict",
            F.when(F.col("has_contractor"), "candidate")
            .when(F.length("owner_fields") > 0, "owner-only")
            .otherwise("no-contact-fields"),
        )
    )


# The lines of the discovery report.
REPORT_TITLE = "# Source Discovery Report"
SOME_CONTRACTOR = "**Has contractor-shaped fields — promote to sources.yaml after manual review.**"
NO_CONTRACTOR = "_No contractor-shaped dataset found._"


def findings_rows(findings: DataFrame) -> DataFrame:
    """Findings with their verdict, as the rows of the JSON report.

    ``findings`` has city, county, source_kind, title, dataset_url, api_url, domain, contractor_fields, owner_fields and
    notes (arrays), sample_field_count and latest_date.
    """
    has = F.coalesce(F.size("contractor_fields") > 0, F.lit(False))
    verdict = F.when(has, "candidate").when(F.size("owner_fields") > 0, "owner-only").otherwise("no-contact-fields")
    return findings.withColumn("has_contractor", has).withColumn("verdict", verdict)


def findings_lines(findings: DataFrame) -> DataFrame:
    """The markdown report as rows: city, part, source_kind, title, dataset_url, line_no (which order them) and line.

    Cities follow each other by name, findings of a city by kind, title and address. A finding makes its own lines, a city
    its heading from one aggregate, so no city is gathered. Part -1 is the title, 0 a heading, 1 a finding, 2 a city's end.
    """
    rows = findings_rows(findings)
    name = F.coalesce("city", F.lit(""))
    place = ["city", "part", "source_kind", "title", "dataset_url"]
    none = F.lit(None).cast("string")

    def lines(*made: Column) -> list[Column]:
        return [F.posexplode(F.filter(F.array(*made), lambda x: x.isNotNull())).alias("line_no", "line")]

    def listed(label: str, column: str, between: str) -> Column:
        return F.when(F.size(column) > 0, F.concat(F.lit(f"  - {label}: "), F.array_join(column, between)))

    def said(label: str, column: str) -> Column:
        return F.when(F.length(column) > 0, F.concat(F.lit(f"  - {label}: "), column))

    cities = rows.groupBy(name.alias("city")).agg(
        F.min_by("county", F.struct("source_kind", "title", "dataset_url")).alias("county"), F.max("has_contractor").alias("some")
    )
    county = F.when(F.length("county") > 0, F.concat(F.lit(" ("), "county", F.lit(")"))).otherwise("")
    fixed = lambda part: ["city", F.lit(part).alias("part"), *[none.alias(c) for c in place[2:]]]
    heads = cities.select(
        *fixed(0),
        *lines(F.concat(F.lit("## "), "city", county), F.when(F.col("some"), SOME_CONTRACTOR).otherwise(NO_CONTRACTOR), F.when(F.col("some"), "")),
    )
    ends = cities.select(*fixed(2), *lines(F.lit("")))
    title = F.concat(F.lit("- **"), F.coalesce("source_kind", F.lit("")), F.lit("** · "), "verdict", F.lit(" · "), F.coalesce("title", F.lit("")))
    items = rows.select(
        name.alias("city"), F.lit(1).alias("part"), *place[2:],
        *lines(
            title,
            said("API", "api_url"),
            listed("contractor fields", "contractor_fields", ", "),
            listed("owner/applicant fields", "owner_fields", ", "),
            said("latest record date", "latest_date"),
            listed("notes", "notes", "; "),
        ),
    )
    top = rows.groupBy().agg(F.lit("").alias("city")).select(*fixed(-1), *lines(F.lit(REPORT_TITLE), F.lit("")))
    return top.unionAll(heads).unionAll(items).unionAll(ends)


def report_order() -> list[Column]:
    """The order of ``findings_lines``: the title first, then city by city."""
    return [F.asc(F.col("part") >= 0), *[F.asc(c) for c in ("city", "part", "source_kind", "title", "dataset_url", "line_no")]]


def is_relevant(city: Column, haystack: Column, terms: tuple[str, ...] = PERMIT_TERMS) -> Column:
    """The text names the city (spaces do not count) and a permit term."""
    text, place = F.lower(haystack), F.lower(city)
    bare, tight = F.replace(text, F.lit(" "), F.lit("")), F.replace(place, F.lit(" "), F.lit(""))
    return (F.contains(text, place) | F.contains(bare, tight)) & _any(text, terms)


def freshness(table: DataFrame, keys: list[str], candidates: tuple[str, ...] = DATE_COLUMNS) -> DataFrame:
    """Newest value of the first candidate date column that has a readable one, per key.

    Values are compared as days, whatever their layout (ISO, US, epoch milliseconds), and given as they are.
    """
    present = [c for c in candidates if c in table.columns]

    def newest(name: str) -> Column:
        text = F.col(name).cast("string")
        day = parse_date(epoch_ms_day(text))
        return F.max_by(F.when(day.isNotNull(), text), F.when(day.isNotNull(), F.struct(day, text)))

    found = F.coalesce(*[newest(c) for c in present]) if present else F.lit(None).cast("string")
    return table.groupBy(*keys).agg(found.alias("latest_date"))
