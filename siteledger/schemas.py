"""Table schemas and the category list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Category names in sheet order.
CATEGORIES = (
    "PUBLIC_WORKS",
    "COMMERCIAL_TI",
    "GC_SUBCONTRACT",
    "RESIDENTIAL_REMODEL",
    "HOSPITALITY_REMODEL",
    "RESTAURANT_RETAIL",
    "OFFICE_LAB",
    "OTHER",
)
OTHER = "OTHER"


_TYPES = {
    "text": T.StringType(),
    "time": T.TimestampType(),
    "day": T.DateType(),
    "flag": T.BooleanType(),
    "real": T.DoubleType(),
}


def texts(*names: str) -> T.StructType:
    """A struct of string fields."""
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def _table(columns: str) -> T.StructType:
    """Schema from ``name`` (text) or ``name:kind`` words."""
    pairs = [(c.split(":") + ["text"])[:2] for c in columns.split()]
    return T.StructType([T.StructField(n, COMPANY_TYPE if k == "company" else _TYPES[k]) for n, k in pairs])


COMPANY_TYPE = texts("name", "license_number", "email", "phone")
COMPANY_STRUCT = "struct<name:string,license_number:string,email:string,phone:string>"

RAW = _table(
    "source source_record_id payload contact:company contact_digest source_url content_hash "
    "fetched_at:time first_seen:time last_seen:time changed:flag"
)
PROJECT = _table(
    "source source_record_id permit_number description project_date project_day:day bid_deadline address city county "
    "source_url company_key category confidence:real status content_hash first_seen:time last_seen:time duplicate_of"
)
COMPANY = _table(
    "company_key name license_number website email phone address license_status license_classification "
    "first_seen:time updated_at:time"
)
WATERMARK = _table("source watermark updated_at:time")
ATTEMPT = _table("source source_record_id provider status detail created_at:time")
RESULT = _table("company_key provider status email phone website detail address license_status license_classification")


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Bring ``df`` to ``schema``: add what it lacks as NULL, keep the order, drop the rest."""
    present = set(df.columns)
    return df.select(
        *[
            (F.col(f.name).cast(f.dataType) if f.name in present else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in schema.fields
        ]
    )
