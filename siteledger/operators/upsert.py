"""Keyed state: raw records, projects, companies, watermarks.

Every operator takes the current table and the incoming rows and returns the new table; the
caller writes it beside the old one. Incoming rows are reduced to one per key by a mergeable
aggregate first, so a key that repeats without end never reaches one task as rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siteledger import schemas as S
from siteledger.functions.text import company_key

KEY = ["source", "source_record_id"]


def latest(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """One row per key: the one with the largest ``order``."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*")


def upsert_raw(current: DataFrame, incoming: DataFrame, now: Column, keep_pending: bool = True) -> DataFrame:
    """New raw table. A new key is changed; a known key is changed when its hash differs.

    ``keep_pending`` leaves a still unprocessed change flagged when the same content returns.
    """
    new = incoming if "fetched_at" in incoming.columns else incoming.withColumn("fetched_at", now)
    new = latest(new.select(*KEY, *_RAW_VALUES), KEY, F.struct("fetched_at", "content_hash"))
    old, new = current.alias("o"), new.withColumn("_seen", F.lit(True)).alias("n")
    joined = old.join(new, KEY, "full_outer")
    seen = F.col("n._seen").isNotNull()
    known = F.col("o.first_seen").isNotNull()
    differs = ~F.col("o.content_hash").eqNullSafe(F.col("n.content_hash"))
    changed = F.when(~known, True).when(~seen, F.col("o.changed"))
    changed = changed.otherwise((F.col("o.changed") | differs) if keep_pending else differs)
    values = [F.when(seen, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in _RAW_VALUES]
    return joined.select(
        *KEY,
        *values,
        F.coalesce("o.first_seen", now).alias("first_seen"),
        F.when(seen, now).otherwise(F.col("o.last_seen")).alias("last_seen"),
        changed.alias("changed"),
    )


_RAW_VALUES = ["payload", "contact", "contact_digest", "source_url", "content_hash", "fetched_at"]


def needs_normalizing(raw: DataFrame, projects: DataFrame) -> DataFrame:
    """Raw rows without a project, or changed since they became one."""
    known = projects.select(*KEY).withColumn("_known", F.lit(True))
    return raw.join(known, KEY, "left").where(F.col("_known").isNull() | F.col("changed")).drop("_known")


def mark_processed(raw: DataFrame, processed: DataFrame) -> DataFrame:
    """Clear the change flag of the processed keys."""
    done = processed.select(*KEY).distinct().withColumn("_done", F.lit(True))
    return raw.join(done, KEY, "left").withColumn("changed", F.col("changed") & F.col("_done").isNull()).drop("_done")


_PROJECT_VALUES = [
    "permit_number",
    "description",
    "project_date",
    "bid_deadline",
    "address",
    "city",
    "county",
    "source_url",
    "company_key",
    "content_hash",
]


def upsert_projects(
    current: DataFrame, incoming: DataFrame, now: Column, reclassify_changed: bool = False
) -> DataFrame:
    """New project table: mapped fields are overwritten (a company link even by NULL), the category
    only by a non-NULL one, status restarts, first_seen and duplicate_of stay."""
    new = incoming
    for name, kind in (("category", "string"), ("confidence", "double")):
        if name not in new.columns:
            new = new.withColumn(name, F.lit(None).cast(kind))
    if "company_key" not in new.columns:
        new = new.withColumn("company_key", company_key(F.col("company_name")))
    new = new.select(*KEY, *_PROJECT_VALUES, "category", "confidence")
    new = latest(new, KEY, F.col("content_hash")).withColumn("_seen", F.lit(True)).alias("n")
    joined = current.alias("o").join(new, KEY, "full_outer")
    seen = F.col("n._seen").isNotNull()
    values = {c: F.when(seen, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")) for c in _PROJECT_VALUES}
    keep = F.lit(True)
    if reclassify_changed:
        keep = ~seen | F.col("o.description").eqNullSafe(F.col("n.description"))
    merged = joined.select(
        *KEY,
        *[v.alias(c) for c, v in values.items()],
        F.coalesce("n.category", F.when(keep, F.col("o.category"))).alias("category"),
        F.coalesce("n.confidence", F.when(keep, F.col("o.confidence"))).alias("confidence"),
        F.when(seen, F.lit("new")).otherwise(F.col("o.status")).alias("status"),
        F.coalesce("o.first_seen", now).alias("first_seen"),
        F.when(seen, now).otherwise(F.col("o.last_seen")).alias("last_seen"),
        F.col("o.duplicate_of").alias("duplicate_of"),
    )
    from siteledger.functions.dates import parse_date

    return S.conform(merged.withColumn("project_day", parse_date(F.col("project_date"))), S.PROJECT)


_COMPANY_FILL = ["license_number", "website", "email", "phone"]


def sighting_order(rows: DataFrame) -> Column:
    """Order of company sightings: fetch time, then source, then record id (of numbers the larger one)."""
    fetched = F.col("fetched_at") if "fetched_at" in rows.columns else F.lit(None).cast("timestamp")
    return F.struct(
        fetched.alias("fetched_at"), F.col("source").alias("source"), F.length("source_record_id").alias("digits"), F.col("source_record_id").alias("id")
    )


def consolidate_companies(
    rows: DataFrame, order: Column | None = None, fill: list[str] | None = None, extra: tuple[Column, ...] = ()
) -> DataFrame:
    """One row per company: latest name, and per field the latest value that is not NULL."""
    columns = fill or _COMPANY_FILL
    staged = rows.withColumn("_ord", sighting_order(rows) if order is None else order)
    aggs = [F.expr(f"max_by({c}, _ord) FILTER (WHERE {c} IS NOT NULL)").alias(c) for c in columns]
    return staged.groupBy("company_key").agg(F.max_by("name", "_ord").alias("name"), *aggs, *extra)


def upsert_companies(current: DataFrame, incoming: DataFrame, now: Column) -> DataFrame:
    """Existing rows (oldest) and incoming rows consolidated; first_seen stays."""
    info = ["address", "license_status", "license_classification"]
    old = S.conform(current, S.COMPANY).select(
        "company_key", "name", *_COMPANY_FILL, *info, "first_seen", "updated_at",
        F.lit(None).cast("struct<fetched_at:timestamp,source:string,digits:int,id:string>").alias("_o"),
    )
    new = incoming.select(
        "company_key",
        "name",
        *_COMPANY_FILL,
        *[F.lit(None).cast("string").alias(c) for c in info],
        F.lit(None).cast("timestamp").alias("first_seen"),
        now.alias("updated_at"),
        sighting_order(incoming).alias("_o"),
    )
    times = (F.coalesce(F.min("first_seen"), F.max("updated_at")).alias("first_seen"), F.max("updated_at").alias("updated_at"))
    # Known rows come before every sighting.
    order = F.struct(F.col("_o").isNotNull(), F.col("_o"))
    merged = consolidate_companies(old.unionByName(new), order, [*_COMPANY_FILL, *info], times)
    return S.conform(merged, S.COMPANY)


def merge_companies(
    companies: DataFrame, updates: DataFrame, now: Column, columns: list[str], fill_only: bool = False
) -> DataFrame:
    """Write found values back by company. A non-NULL update wins unless ``fill_only``.

    ``updates`` holds one row per company.
    """
    renamed = updates.select("company_key", *[F.col(c).alias(f"_u_{c}") for c in columns])
    joined = companies.join(renamed, "company_key", "left")
    merged = {
        c: F.coalesce(F.col(c), F.col(f"_u_{c}")) if fill_only else F.coalesce(F.col(f"_u_{c}"), F.col(c))
        for c in columns
    }
    touched = F.coalesce(*[F.col(f"_u_{c}") for c in columns]).isNotNull()
    merged["updated_at"] = F.when(touched, now).otherwise(F.col("updated_at"))
    return joined.withColumns(merged).select(*companies.columns)


def upsert_watermarks(current: DataFrame, incoming: DataFrame, now: Column) -> DataFrame:
    """Last write wins per source; a source that brought nothing keeps its mark."""
    old = current.select("source", "watermark", "updated_at", F.lit(0).alias("_g"))
    new = incoming.where("watermark is not null").select(
        "source", "watermark", now.alias("updated_at"), F.lit(1).alias("_g")
    )
    both = old.unionByName(new)
    return S.conform(latest(both, ["source"], F.struct("_g", "updated_at", "watermark")), S.WATERMARK)


def empty(spark, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)
