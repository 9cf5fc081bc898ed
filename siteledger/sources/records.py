"""Landed responses -> raw records, one reader per source kind."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siteledger import config as C
from siteledger.functions import dates, geo, payload as P
from siteledger.functions.text import first_present, null_if_empty
from siteledger.schemas import COMPANY_STRUCT, texts

Reader = Callable[[str, C.SourceConfig, DataFrame], DataFrame]

PLACE = (
    T.StructType()
    .add("city", texts("name"))
    .add("state", texts("name", "code"))
    .add("zip", T.StringType())
    .add("streetAddress", T.StringType())
    .add("streetAddress2", T.StringType())
)

#: An object whose values keep their types.
TYPED = "map<string,variant>"


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """Whole response documents, one per landed file (a response page is small by construction)."""
    return spark.read.text(path, wholetext=True).select(F.col("value").alias("response"))


def read_response_lines(spark: SparkSession, path: str) -> DataFrame:
    """Response documents landed one per line; files split freely."""
    return spark.read.text(path).select(F.col("value").alias("response"))


def extract_records(responses: DataFrame, record_path: str | None = None) -> DataFrame:
    """Explode responses to one canonical JSON object per record; other list items are left out."""
    parsed = responses.select(F.try_parse_json("response").alias("doc"))
    items = parsed.select(F.explode(P.record_list(F.col("doc"), record_path)).alias("item"))
    # Of all JSON values only an object starts with a brace.
    return P.once(items, "payload", F.to_json("item")).where(F.startswith("payload", F.lit("{"))).select("payload")


def _finish(df: DataFrame, name: str, record_id: Column, source_url: Column, contact: bool = False) -> DataFrame:
    """Add identity, URL and hash. ``df`` holds ``payload`` and, with ``contact``, the joined contact."""
    contact_col = F.col("contact") if contact else F.lit(None).cast(COMPANY_STRUCT)
    digest_col = F.col("contact_digest") if contact else F.lit(None).cast("string")
    staged = df.select(
        F.lit(name).alias("source"),
        null_if_empty(record_id).alias("given_id"),
        "payload",
        contact_col.alias("contact"),
        digest_col.alias("contact_digest"),
        source_url.alias("source_url"),
    ).withColumn("content_hash", P.digest(F.col("payload"), F.col("contact_digest"), F.col("source_url")))
    return staged.select(
        "source",
        F.coalesce("given_id", "content_hash").alias("source_record_id"),
        "payload",
        "contact",
        "contact_digest",
        "source_url",
        "content_hash",
    )


def _identified(df: DataFrame, name: str, cfg: C.SourceConfig, template: str | None, contact: bool = False) -> DataFrame:
    fm = cfg.field_map
    wanted = [fm.record_id, *([fm.permit_number] if fm.permit_number else []), *P.template_fields(template)]
    staged = P.once(df, "_f", P.flat_fields(F.col("payload"), wanted))
    ids = [F.col("_f")[fm.record_id]] + ([F.col("_f")[fm.permit_number]] if fm.permit_number else [])
    return _finish(staged, name, first_present(*ids), P.fill_template(template, F.col("_f")), contact)


def not_before(records: DataFrame, field: str, since: str | None, strict: bool = False) -> DataFrame:
    """Records whose ``field`` (ISO time, other accepted date, epoch milliseconds) is at or, if ``strict``, after ``since``.

    The sources filter by time themselves, so a record without a readable time is left out as it is there.
    """
    if not since:
        return records
    names, value = records.columns, F.col("_t")
    dated = P.once(records, "_t", P.flat_fields(F.col("payload"), [field])[field])
    time = F.coalesce(F.try_to_timestamp(value), F.try_to_timestamp(dates.date_only(dates.epoch_ms_day(value))))
    start = F.lit(since).cast("timestamp")
    return dated.where(time > start if strict else time >= start).select(*names)


def permit_array(
    name: str, cfg: C.SourceConfig, responses: DataFrame, contacts: DataFrame | None = None, since: str | None = None
) -> DataFrame:
    """Responses that are one JSON array of permits, with an optional contacts table; later than ``since``."""
    records = not_before(extract_records(responses), cfg.date_field, since, strict=True)
    if contacts is None or not cfg.field_map.permit_number:
        return _identified(records, name, cfg, cfg.source_url_template)
    from siteledger.operators.contacts import attach_contacts

    permit = P.flat_fields(F.col("payload"), [cfg.field_map.permit_number])[cfg.field_map.permit_number]
    joined = attach_contacts(records.withColumn("_permit", null_if_empty(permit)), "_permit", contacts, "permit_number")
    return _identified(joined, name, cfg, cfg.source_url_template, contact=True)


def _day_value(value: Column) -> Column:
    """The day of an epoch number in a variant, as a variant; a number that is none stays as text."""
    day = dates.epoch_ms_day(F.try_variant_get(value, "$", "string"))
    return F.try_parse_json(F.concat(F.lit('"'), day, F.lit('"')))


def feature_layer(name: str, cfg: C.SourceConfig, responses: DataFrame, since: str | None = None) -> DataFrame:
    """Feature responses: attributes flattened, numeric project dates turned from epoch ms to ISO days; from ``since`` on.

    Other values keep their types: numbers, booleans, lists and objects stay what they are in the payload.
    """
    parsed = responses.select(F.try_parse_json("response").alias("doc"))
    features = parsed.select(
        F.explode(F.try_variant_get("doc", "$.features", "array<variant>")).alias("feature")
    ).select(F.try_variant_get("feature", "$.attributes", "variant").alias("attributes"))
    values = F.try_variant_get("attributes", "$", TYPED)
    numeric = [
        F.when(
            F.schema_of_variant(F.try_variant_get("attributes", f"$['{field}']", "variant")).rlike(
                "^(BIGINT|INT|DECIMAL|DOUBLE|FLOAT)"
            ),
            F.lit(field),
        )
        for field in cfg.field_map.project_date
    ]
    converted = features.withColumn("_dates", F.array_compact(F.array(*numeric))).withColumn(
        "_map",
        F.transform_values(
            values, lambda k, v: F.when(F.array_contains(F.col("_dates"), k), _day_value(v)).otherwise(v)
        ),
    )
    records = P.once(converted, "payload", P.canonical_json(F.to_json("_map", {"ignoreNullFields": "false"}))).select("payload")
    records = not_before(records, cfg.date_field, since)
    return _identified(records, name, cfg, cfg.source_url_template)


def portal(name: str, cfg: C.SourceConfig, responses: DataFrame, since: str | None = None) -> DataFrame:
    """Portal responses at a configured record path; recency is checked here when the server cannot."""
    records = extract_records(responses, cfg.record_path)
    if since and not cfg.since_param:
        columns = [cfg.date_field, *cfg.field_map.project_date]
        fields = P.flat_fields(F.col("payload"), columns)
        records = records.where(dates.is_recent(first_present(*[fields[c] for c in columns]), F.lit(since)))
    return _identified(records, name, cfg, cfg.source_url_template or cfg.detail_url_template)


def merge_details(records: DataFrame, details: DataFrame) -> DataFrame:
    """Records left-joined with their detail document, whose keys get the prefix ``detail_``.

    ``details`` holds ``case_id`` and ``response``; the detail object sits under ``Result``. Values of both sides keep
    their types, nested ones too; a detail key replaces a record's key of the same name.
    """
    case = P.flat_fields(F.col("payload"), ["CaseId", "PermitId"])
    left = records.withColumn("_case", first_present(case["CaseId"], case["PermitId"]))
    result = F.to_json(F.try_variant_get(F.try_parse_json("response"), "$.Result", "map<string,variant>"))
    right = (
        details.select(F.col("case_id").cast("string").alias("_case"), result.alias("_detail"))
        .where("_detail is not null")
        .groupBy("_case")
        .agg(F.max("_detail").alias("_detail"))
    )
    joined = left.join(right, "_case", "left").withColumns(
        {
            "_base": F.try_variant_get(F.try_parse_json("payload"), "$", TYPED),
            "_more": F.transform_keys(F.try_variant_get(F.try_parse_json("_detail"), "$", TYPED), lambda k, v: F.concat(F.lit("detail_"), k)),
        }
    )
    kept = F.map_filter("_base", lambda k, v: ~F.map_contains_key(F.col("_more"), k))
    merged = F.when(F.col("_more").isNull(), F.col("_base")).otherwise(F.map_concat(kept, F.col("_more")))
    return joined.select(P.canonical_json(F.to_json(merged, {"ignoreNullFields": "false"})).alias("payload"))


def portal_with_detail(
    name: str, cfg: C.SourceConfig, responses: DataFrame, details: DataFrame | None = None
) -> DataFrame:
    """Search results plus their detail documents; a record without detail is kept as it is."""
    records = extract_records(responses, cfg.record_path or "Result.EntityResults")
    if details is not None and cfg.detail_url_template:
        records = merge_details(records, details)
    return _identified(records, name, cfg, cfg.source_url_template or cfg.detail_url_template)


def place_columns(place: Column) -> tuple[Column, Column, Column]:
    """City, ZIP and state of a place-of-performance struct."""
    street, street2 = place["streetAddress"], place["streetAddress2"]
    return (
        place["city"]["name"],
        geo.place_zip(place["zip"], street, street2),
        geo.place_state(place["state"]["code"], street, street2),
    )


def opportunities(name: str, cfg: C.SourceConfig, responses: DataFrame, since: str | None = None) -> DataFrame:
    """Solicitations: industry code, notice type, region and first posting day are filters on the landed rows."""
    records = not_before(extract_records(responses, "opportunitiesData"), "postedDate", since)
    template = cfg.source_url_template
    wanted = ["noticeId", "uiLink", "naicsCode", "type", *P.template_fields(template)]
    staged = P.once(records, "_f", P.flat_fields(F.col("payload"), wanted, {"placeOfPerformance": PLACE}))
    if cfg.naics_codes:
        staged = staged.where(F.col("_f.naicsCode").isin(*cfg.naics_codes))
    if cfg.ptype:
        staged = staged.where(F.col("_f.type") == cfg.ptype)
    if cfg.region:
        staged = staged.where(geo.region_predicate(cfg.region, *place_columns(F.col("_f.placeOfPerformance"))))
    url = F.coalesce(null_if_empty(F.col("_f.uiLink")), P.fill_template(template, F.col("_f")))
    return _finish(staged, name, F.col("_f.noticeId"), url)


READERS: dict[str, Reader] = {
    C.PERMIT_ARRAY: permit_array,
    C.FEATURE_LAYER: feature_layer,
    C.OPPORTUNITIES: opportunities,
    C.PORTAL: portal,
    C.PORTAL_ACCELA: portal,
    C.PORTAL_DETAIL: portal_with_detail,
}


def register_reader(kind: str, reader: Reader) -> None:
    """Add a source kind; the reader gets (name, config, responses) and returns raw records."""
    READERS[kind] = reader


def read_source(name: str, cfg: C.SourceConfig, responses: DataFrame, **inputs) -> DataFrame:
    if cfg.type not in READERS:
        raise ValueError(f"unsupported source type {cfg.type!r} of {name!r}")
    return READERS[cfg.type](name, cfg, responses, **inputs)


def union_sources(parts: list[DataFrame]) -> DataFrame:
    """One table of all sources; columns a source lacks become NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def list_sources(spark: SparkSession, configs: dict[str, C.SourceConfig]) -> DataFrame:
    rows = [(n, c.type, c.jurisdiction, c.county) for n, c in configs.items()]
    return spark.createDataFrame(rows, "name string, type string, jurisdiction string, county string")


def payload_keys(records: DataFrame, payload: str = "payload") -> DataFrame:
    """Sorted union of the top-level keys seen in the payloads."""
    return (
        records.select(F.explode(F.json_object_keys(payload)).alias("payload_key")).distinct().orderBy("payload_key")
    )


def sample(records: DataFrame, n: int = 3) -> DataFrame:
    """The first ``n`` records, for a dry run of a new source."""
    return records.select("source_record_id", "payload").limit(n)


def high_water(records: DataFrame, date_text: Column, by_date: bool = False) -> DataFrame:
    """Largest date per source: as text, or by parsed date where layouts are mixed."""
    staged = records.select("source", date_text.alias("_w")).where("_w is not null")
    best = F.max("_w")
    if by_date:
        best = F.max_by("_w", F.struct(dates.parse_date(F.col("_w")), F.col("_w")))
    return staged.groupBy("source").agg(best.alias("watermark"))
