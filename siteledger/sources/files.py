"""CSV imports and hand-made records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteledger.config import FieldMap
from siteledger.functions import payload as P
from siteledger.functions.contacts import normalize_license
from siteledger.functions.text import null_if_empty, strip
from siteledger.schemas import COMPANY_STRUCT

ORDER = "_order"


def read_csv(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """All-text CSV with a header (byte-order mark tolerated) and the file order of its rows.

    ``multi_line=False`` lets large files without line breaks inside quotes be split.
    """
    raw = (
        spark.read.option("header", True)
        .option("multiLine", multi_line)
        .option("quote", '"')
        .option("escape", '"')
        .option("encoding", "UTF-8")
        .csv(path)
    )
    names = [c.lstrip("﻿") for c in raw.columns]
    order = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("row"))
    return raw.select(*[F.col(f"`{old}`").alias(new) for old, new in zip(raw.columns, names)], order.alias(ORDER))


def permit_rows(table: DataFrame, source: str, field_map: FieldMap) -> DataFrame:
    """Raw records of a permit CSV; repeats of an id are flagged ``skipped``, the first in the file is kept.

    The first row per id comes from an aggregate, so a repeated id is never gathered in one task.
    """
    columns = [c for c in table.columns if c != ORDER]
    cleaned = [F.coalesce(strip(F.col(f"`{c}`")), F.lit("")).alias(c) for c in columns]
    permit = F.lit(None).cast("string")
    if field_map.permit_number in columns:
        permit = null_if_empty(strip(F.col(f"`{field_map.permit_number}`")))
    staged = table.select(P.canonical_json(F.to_json(F.struct(*cleaned))).alias("payload"), permit.alias("_id"), ORDER)
    hashed = staged.withColumn("content_hash", P.digest(F.col("payload"), F.lit(None).cast("string"), F.lit(None).cast("string")))
    rows = hashed.select(
        F.lit(source).alias("source"),
        F.coalesce("_id", "content_hash").alias("source_record_id"),
        "payload",
        F.lit(None).cast(COMPANY_STRUCT).alias("contact"),
        F.lit(None).cast("string").alias("contact_digest"),
        F.lit(None).cast("string").alias("source_url"),
        "content_hash",
        ORDER,
    )
    first = rows.groupBy("source_record_id").agg(F.min(ORDER).alias("_first"))
    joined = rows.join(first, "source_record_id")
    return joined.select(*[c for c in rows.columns if c != ORDER], (F.col(ORDER) != F.col("_first")).alias("skipped"))


def import_stats(rows: DataFrame) -> DataFrame:
    """Read, upserted and skipped counts of a CSV import."""
    return rows.agg(
        F.count("*").alias("rows_read"),
        F.count_if(~F.col("skipped")).alias("upserted"),
        F.count_if(F.col("skipped")).alias("skipped"),
    )


LICENSE_COLUMNS = (
    "LicenseNo",
    "FullBusinessName",
    "BusinessName",
    "BusinessPhone",
    "MailingAddress",
    "City",
    "State",
    "ZIPCode",
    "PrimaryStatus",
    "SecondaryStatus",
    "Classifications(s)",
)


def license_master(table: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """Licence file keyed by normal licence number; of repeats the last row of the file wins.

    ``wanted`` (column ``license_key``) prunes the file before it is shuffled.
    """
    present = set(table.columns)
    columns = [
        (F.col(f"`{c}`") if c in present else F.lit(None)).cast("string").alias(c) for c in LICENSE_COLUMNS
    ]
    keyed = table.select(normalize_license(F.col("LicenseNo")).alias("license_key"), F.struct(*columns).alias("row"), ORDER)
    keyed = keyed.where("license_key is not null")
    if wanted is not None:
        keyed = keyed.join(wanted.select("license_key").where("license_key is not null").distinct(), "license_key", "left_semi")
    return keyed.groupBy("license_key").agg(F.max_by("row", ORDER).alias("row")).select("license_key", "row.*")


MANUAL_COLUMNS = (
    "description",
    "permit_number",
    "address",
    "project_date",
    "city",
    "county",
    "source_url",
    "company_name",
    "company_license",
)


def split_manual(records: DataFrame, source: str) -> tuple[DataFrame, DataFrame]:
    """Hand-made records -> (projects with their raw identity, rejected rows with a reason)."""
    present = set(records.columns)
    wide = records.select(
        *[(F.col(c).cast("string") if c in present else F.lit(None).cast("string")).alias(c) for c in MANUAL_COLUMNS]
    ).withColumn("description", strip(F.col("description")))
    rejected = wide.where(F.coalesce(F.length("description"), F.lit(0)) == 0).withColumn(
        "reason", F.lit("missing description")
    )
    valid = wide.where(F.length("description") > 0)
    payload = P.canonical_json(F.to_json(F.struct(*MANUAL_COLUMNS)))
    hashed = valid.withColumn("payload", payload).withColumn("content_hash", F.sha2("payload", 256))
    accepted = hashed.withColumns(
        {
            "source": F.lit(source),
            "source_record_id": F.coalesce(null_if_empty(F.col("permit_number")), F.col("content_hash")),
            "company_name": null_if_empty(F.col("company_name")),
            "license_number": F.col("company_license"),
            "company_email": F.lit(None).cast("string"),
            "company_phone": F.lit(None).cast("string"),
            "bid_deadline": F.lit(None).cast("string"),
        }
    ).drop("company_license")
    return accepted, rejected
