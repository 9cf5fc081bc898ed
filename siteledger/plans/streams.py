"""Registered queries on Structured Streaming; each must equal its batch result."""

from __future__ import annotations

from pyspark.sql import functions as F

from siteledger import config as C
from siteledger import schemas as S
from siteledger.plans.tables import table
from siteledger.session import scratch_path
from siteledger.sources import landing, records
from siteledger.streaming import cohorts, incremental, keyed_state

QUERIES = {}
ORACLES = {}


def stream_week_counts(spark, sf_dir):
    """Events per Monday week and type, streamed from their file."""
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    stream = stream.select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    counts = cohorts.run_weekly_counts(spark, stream, "ts", ["event_type"], scratch_path(spark, "weeks"), None).counts
    return counts.select(F.col("monday").cast("string").alias("monday"), "event_type", "n")


QUERIES["stream_week_counts"] = stream_week_counts
ORACLES["stream_week_counts"] = """SELECT CAST(CAST(date_trunc('week', ts) AS DATE) AS VARCHAR) AS monday, event_type, count(*) AS n FROM events GROUP BY 1, 2"""


def stream_late(spark, sf_dir):
    """Events in three deliveries, the last with days that the first two have passed by more than the delay."""
    schema = table(spark, sf_dir, "events").schema
    root, events = scratch_path(spark, "late"), table(spark, sf_dir, "events")
    stream = spark.readStream.schema(schema).parquet(f"{root}/in/*").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    for name, part in (("a", "day(ts) BETWEEN 8 AND 15"), ("b", "day(ts) > 15 AND event_id % 3 <> 0"), ("c", "day(ts) < 8 OR (day(ts) > 15 AND event_id % 3 = 0)")):
        events.where(part).write.parquet(f"{root}/in/{name}")
        found = cohorts.run_weekly_counts(spark, stream, "ts", ["event_type"], f"{root}/state", "10 days")
    return found.counts.select(F.col("monday").cast("string").alias("monday"), "event_type", "n", F.lit(found.arrived).alias("arrived"), F.lit(found.late).alias("late"))


QUERIES["stream_late"] = stream_late
ORACLES["stream_late"] = """WITH e AS (SELECT *, CAST(date_trunc('week', ts) AS DATE) AS monday, day(ts) < 8 OR (day(ts) > 15 AND event_id % 3 = 0) AS third FROM events),
 mark AS (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 10 DAY AS passed FROM e WHERE NOT third),
 k AS (SELECT e.*, third AND monday + INTERVAL 7 DAY <= passed AS late FROM e, mark)
 SELECT CAST(monday AS VARCHAR) AS monday, event_type, count(*) AS n, (SELECT count(*) FROM k)::BIGINT AS arrived, (SELECT count(*) FROM k WHERE late)::BIGINT AS late
 FROM k WHERE NOT late GROUP BY monday, event_type"""


def stream_distinct(spark, sf_dir):
    """Two deliveries of the events, streamed; repeats are dropped with bounded state."""
    schema = table(spark, sf_dir, "events").schema
    root = scratch_path(spark, "distinct")
    events = table(spark, sf_dir, "events")
    events.write.parquet(f"{root}/in/a")
    events.where("event_type = 'click'").write.parquet(f"{root}/in/b")
    stream = spark.readStream.schema(schema).parquet(f"{root}/in/*").withColumn("ts", F.col("ts").cast("timestamp"))
    unique = incremental.distinct_events(stream, ["event_id"], "ts", "60 days")
    query = (
        unique.writeStream.format("parquet").option("checkpointLocation", f"{root}/_stream").option("path", f"{root}/out")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.parquet(f"{root}/out").groupBy("event_type").agg(F.count("*").alias("n"))


QUERIES["stream_distinct"] = stream_distinct
ORACLES["stream_distinct"] = "SELECT event_type, count(*) AS n FROM events GROUP BY 1"

_CONFIG = C.SourceConfig(
    type=C.PORTAL,
    name="customers",
    jurisdiction="Lake City",
    record_path="items",
    field_map=C.FieldMap(
        record_id="id", permit_number="id", description=("what",), address=("where",), project_date=("day",), company_name="who", company_phone="tel"
    ),
)


def stream_upsert(spark, sf_dir):
    """Customers landed twice, the second time with new balances: only changed ones are re-mapped."""
    root = scratch_path(spark, "landing")
    customer = table(spark, sf_dir, "customer")

    def land(label: str, what: str, rows):
        doc = rows.selectExpr(
            f"to_json(named_struct('items', array(named_struct('id', c_custkey, 'what', {what}, 'where', c_mktsegment, 'day', '2001-07-0{label}', "
            "'who', c_name, 'tel', '415-555-1234')))) AS value"
        )
        doc.write.mode("append").text(f"{root}/in")

    def step(now: str) -> None:
        incremental.run_landing(
            spark, f"{root}/in", lambda df: records.portal("customers", _CONFIG, df), _CONFIG, f"{root}/state", F.lit(now).cast("timestamp")
        )

    land("1", "concat('office for ', c_name)", customer)
    step("2001-07-01")
    land("1", "concat(CASE WHEN c_acctbal < 0 THEN 'hotel' ELSE 'office' END, ' for ', c_name)", customer.where("c_mktsegment <> 'BUILDING'"))
    step("2001-07-02")
    raw = incremental.Snapshots(spark, f"{root}/state/raw", S.RAW).before()
    projects = incremental.Snapshots(spark, f"{root}/state/projects", S.PROJECT).before()
    joined = raw.select("source_record_id", "changed").join(projects, "source_record_id")
    return joined.select(
        "source_record_id", "changed", "description", "category", "company_key", "address", F.col("first_seen").cast("string").alias("first_seen"),
        F.col("last_seen").cast("string").alias("last_seen"),
    )


QUERIES["stream_upsert"] = stream_upsert
ORACLES["stream_upsert"] = """SELECT CAST(c_custkey AS VARCHAR) AS source_record_id, false AS changed,
    CASE WHEN c_acctbal < 0 AND c_mktsegment <> 'BUILDING' THEN 'hotel for ' ELSE 'office for ' END || c_name AS description, 'OFFICE_LAB' AS category,
    lower(c_name) AS company_key, c_mktsegment AS address, '2001-07-01 00:00:00' AS first_seen,
    CASE WHEN c_acctbal < 0 AND c_mktsegment <> 'BUILDING' THEN '2001-07-02 00:00:00' ELSE '2001-07-01 00:00:00' END AS last_seen FROM customer"""


_SUPPLIERS = C.SourceConfig(
    type=C.PERMIT_ARRAY,
    name="suppliers",
    jurisdiction="Lake City",
    field_map=C.FieldMap(record_id="id", permit_number="id", description=("what",), address=("where",), project_date=("day",), company_name="who"),
)


def stream_state(spark, sf_dir):
    """Two kinds of sources in three deliveries: revisions and sightings of every record, its project and category."""
    root = scratch_path(spark, "state")
    customer, supplier = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    customers = "to_json(named_struct('items', array(named_struct('id', c_custkey, 'what', concat({}, ' for ', c_name), 'where', c_mktsegment, 'day', '2001-07-01', 'who', c_name))))"
    suppliers = "to_json(array(named_struct('id', s_suppkey, 'what', concat({}, ' for ', s_name), 'where', s_name, 'day', '2001-07-01', 'who', s_name)))"
    moved = "CASE WHEN c_acctbal < 0 THEN 'hotel' ELSE 'office' END"
    deliveries = {
        "2001-07-01": [("customers", customer, customers.format("'office'"))],
        "2001-07-02": [("customers", customer.where("c_mktsegment <> 'BUILDING'"), customers.format(moved)), ("suppliers", supplier, suppliers.format("'office'"))],
        "2001-07-03": [("customers", customer.where("c_custkey % 2 = 0"), customers.format("'office'")), ("suppliers", supplier.where("s_suppkey % 2 = 0"), suppliers.format("'hotel'"))],
    }
    configs = {"customers": _CONFIG}
    for day, parts in deliveries.items():
        for source, rows, response in parts:
            landing.land(rows.selectExpr(f"{response} AS response"), f"{root}/in", source, F.lit(day))
        if any(source == "suppliers" for source, _, _ in parts):  # a source that comes later
            configs["suppliers"] = _SUPPLIERS
        keyed_state.run_sources(spark, f"{root}/in", configs, f"{root}/out", F.lit(day).cast("timestamp"))
    key = ["source", "source_record_id"]
    sightings = spark.read.parquet(f"{root}/out/records/*/*").groupBy(*key).agg(F.count("*").alias("sightings"))
    known = keyed_state.records_table(spark, f"{root}/out").join(sightings, key)
    known = known.select(*key, "revision", "sightings", *[F.col(c).cast("string").alias(c) for c in ("first_seen", "last_seen")])
    return known.join(keyed_state.projects_table(spark, f"{root}/out").select(*key, "description", "category", "company_key"), key)


QUERIES["stream_state"] = stream_state
ORACLES["stream_state"] = """WITH c AS (SELECT *, c_mktsegment <> 'BUILDING' AS second, c_custkey % 2 = 0 AS third FROM customer),
 k AS (SELECT *, second AND c_acctbal < 0 AS moved, third AND second AND c_acctbal < 0 AS back FROM c)
 SELECT 'customers' AS source, CAST(c_custkey AS VARCHAR) AS source_record_id, CAST(1 + moved::INT + back::INT AS BIGINT) AS revision,
  CAST(1 + second::INT + third::INT AS BIGINT) AS sightings, '2001-07-01 00:00:00' AS first_seen,
  CASE WHEN third THEN '2001-07-03' WHEN second THEN '2001-07-02' ELSE '2001-07-01' END || ' 00:00:00' AS last_seen,
  CASE WHEN moved AND NOT back THEN 'hotel for ' ELSE 'office for ' END || c_name AS description, 'OFFICE_LAB' AS category, lower(c_name) AS company_key FROM k
 UNION ALL SELECT 'suppliers', CAST(s_suppkey AS VARCHAR), 1 + (s_suppkey % 2 = 0)::INT, 1 + (s_suppkey % 2 = 0)::INT, '2001-07-02 00:00:00',
  CASE WHEN s_suppkey % 2 = 0 THEN '2001-07-03' ELSE '2001-07-02' END || ' 00:00:00',
  CASE WHEN s_suppkey % 2 = 0 THEN 'hotel for ' ELSE 'office for ' END || s_name, 'OFFICE_LAB', lower(s_name) FROM supplier"""
