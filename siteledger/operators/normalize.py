"""Raw records -> project rows, as one narrow projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siteledger.config import OPPORTUNITIES, FieldMap, SourceConfig
from siteledger.functions import contacts as K
from siteledger.functions import dates
from siteledger.functions.payload import STRINGS, digest, flat_fields, once
from siteledger.functions.text import (
    address_parts,
    clean_license,
    company_key,
    drop_placeholder,
    first_present,
    null_if_empty,
    squeeze,
    strip,
    title_case,
)
from siteledger.schemas import COMPANY_STRUCT
from siteledger.sources.records import PLACE

PROJECT_COLUMNS = (
    "source",
    "source_record_id",
    "permit_number",
    "description",
    "project_date",
    "bid_deadline",
    "address",
    "city",
    "county",
    "source_url",
    "company_name",
    "license_number",
    "company_email",
    "company_phone",
    "content_hash",
)


def record_company(fields: Column, fm: FieldMap) -> Column:
    """Company named on the permit itself; its contacts come only from their mapped columns."""
    if not fm.company_name:
        return F.lit(None).cast(COMPANY_STRUCT)

    def mapped(column: str | None, clean) -> Column:
        return clean(null_if_empty(fields[column])) if column else F.lit(None).cast("string")

    name = drop_placeholder(squeeze(fields[fm.company_name]))
    return F.when(
        name.isNotNull(),
        F.struct(
            name.alias("name"),
            mapped(fm.company_license, clean_license).alias("license_number"),
            mapped(fm.company_email, K.extract_email).alias("email"),
            mapped(fm.company_phone, K.extract_phone).alias("phone"),
        ),
    )


def _projects(df: DataFrame, parts: dict[str, Column], company: Column) -> DataFrame:
    """Final column order, company flattened, hash over the mapped fields."""
    staged = df.select(
        "source",
        "source_record_id",
        *[col.alias(name) for name, col in parts.items()],
        "source_url",
        company.alias("_company"),
    ).select(
        "*",
        F.col("_company.name").alias("company_name"),
        F.col("_company.license_number").alias("license_number"),
        F.col("_company.email").alias("company_email"),
        F.col("_company.phone").alias("company_phone"),
    )
    hashed = [c for c in PROJECT_COLUMNS if c not in ("content_hash", "source_url")]
    return staged.withColumn("content_hash", digest(*[F.col(c) for c in hashed])).select(*PROJECT_COLUMNS)


def normalize_permits(raw: DataFrame, cfg: SourceConfig) -> DataFrame:
    """Permits of one source mapped through its field map."""
    fm = cfg.field_map
    columns = fm.columns()
    staged = once(raw, "_f", flat_fields(F.col("payload"), columns, {"_contacts": STRINGS}))
    fields = F.col("_f")
    address = address_parts(*[fields[c] for c in fm.address])
    description = null_if_empty(strip(first_present(*[fields[c] for c in fm.description])))
    city = F.lit(cfg.jurisdiction)
    if fm.city:
        city = F.coalesce(null_if_empty(title_case(squeeze(fields[fm.city]))), city)
    inline = fields["_contacts"]
    from_contacts = F.size(F.coalesce(inline, F.array().cast(STRINGS))) > 0
    joined = F.col("contact") if "contact" in raw.columns else F.lit(None).cast(COMPANY_STRUCT)
    has_joined = F.col("contact_digest").isNotNull() if "contact_digest" in raw.columns else F.lit(False)
    company = (
        F.when(has_joined, joined).when(from_contacts, K.best_contact(inline)).otherwise(record_company(fields, fm))
    )
    none = F.lit(None).cast("string")
    parts = {
        "permit_number": fields[fm.permit_number] if fm.permit_number else none,
        "description": F.coalesce(
            description, F.concat(F.lit("Permit at "), F.coalesce(address, F.lit("unknown address")))
        ),
        "project_date": dates.date_only(first_present(*[fields[c] for c in fm.project_date])),
        "bid_deadline": none,
        "address": address,
        "city": city,
        "county": F.lit(cfg.county),
    }
    return _projects(staged, parts, company)


_NOTICE = ("title", "type", "solicitationNumber", "noticeId", "postedDate", "responseDeadLine", "fullParentPathName",
           "organizationName", "subTier", "department", "office")


def agency_name(fields: Column) -> Column:
    """Last level of the agency path, else the first other agency field with text."""
    path = F.when(F.length(strip(fields["fullParentPathName"])) > 0, fields["fullParentPathName"])
    others = [
        F.when(F.length(strip(fields[c])) > 0, squeeze(fields[c]))
        for c in ("organizationName", "subTier", "department", "office")
    ]
    last = F.element_at(F.split(path, r"\."), -1)
    return null_if_empty(F.when(path.isNotNull(), squeeze(last)).otherwise(F.coalesce(*others)))


def normalize_opportunities(raw: DataFrame, cfg: SourceConfig) -> DataFrame:
    """Solicitations; the county stays NULL because the place of performance names none."""
    extra: dict[str, T.DataType] = {"placeOfPerformance": PLACE, "pointOfContact": STRINGS, "_contacts": STRINGS}
    staged = once(raw, "_f", flat_fields(F.col("payload"), _NOTICE, extra))
    fields = F.col("_f")
    place = fields["placeOfPerformance"]
    city = null_if_empty(place["city"]["name"])
    state = first_present(place["state"]["name"], place["state"]["code"])
    title = null_if_empty(strip(fields["title"]))
    kind = null_if_empty(strip(fields["type"]))
    contacts = F.coalesce(fields["_contacts"], fields["pointOfContact"], F.array().cast(STRINGS))
    parts = {
        "permit_number": first_present(fields["solicitationNumber"], fields["noticeId"]),
        "description": F.coalesce(
            F.concat(F.lit("["), kind, F.lit("] "), title), title, kind, F.lit("SAM.gov opportunity")
        ),
        "project_date": dates.date_only(first_present(fields["postedDate"])),
        "bid_deadline": dates.date_only(first_present(fields["responseDeadLine"])),
        "address": null_if_empty(F.concat_ws(", ", city, state)),
        "city": F.coalesce(null_if_empty(title_case(squeeze(city))), F.lit(cfg.jurisdiction)),
        "county": F.lit(None).cast("string"),
    }
    staged = once(staged, "_agency", agency_name(fields))
    return _projects(staged, parts, K.best_point_of_contact(contacts, F.col("_agency")))


def normalize(raw: DataFrame, cfg: SourceConfig) -> DataFrame:
    if cfg.type == OPPORTUNITIES:
        return normalize_opportunities(raw, cfg)
    return normalize_permits(raw, cfg)


def companies_of(projects: DataFrame) -> DataFrame:
    """Company rows named by project rows, keyed by their normal name."""
    return projects.select(
        company_key(F.col("company_name")).alias("company_key"),
        F.col("company_name").alias("name"),
        "license_number",
        F.lit(None).cast("string").alias("website"),
        F.col("company_email").alias("email"),
        F.col("company_phone").alias("phone"),
        "source",
        "source_record_id",
        *(["fetched_at"] if "fetched_at" in projects.columns else []),
    ).where("company_key is not null")
