"""The driver tables read as permit, solicitation, company and lead tables.

The expressions are plain SQL that any engine reads, so a checker can render the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TODAY = "2001-07-20"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def wide_table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """A table for expensive row work, dealt out evenly: four tasks a core, more where the file has more splits.

    Splits say little about rows: all rows of a row group are in one split, and the others of its file are empty.
    """
    df = table(spark, sf_dir, name)
    df = df.select(*columns) if columns else df
    return df.repartition(4 * max(spark.sparkContext.defaultParallelism, df.rdd.getNumPartitions()))


def orders_with_customers(spark: SparkSession, sf_dir: str, wide: bool = False) -> DataFrame:
    """Orders with their customer, nation and region."""
    orders = wide_table(spark, sf_dir, "orders") if wide else table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer")
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return (
        orders.join(customer, orders.o_custkey == customer.c_custkey)
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    )


ORDERS_SQL = (
    "orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey "
    "JOIN region ON n_regionkey = r_regionkey"
)

_DAY = "CAST(o_orderdate AS DATE)"

# Lead columns over ``orders_with_customers``.
LEAD = {
    "source": "CASE WHEN o_orderpriority = '1-URGENT' THEN 'samgov-orders' ELSE concat('permits-', lower(o_orderstatus)) END",
    "source_record_id": "lpad(CAST(o_orderkey AS STRING), 12, '0')",
    "category": "CASE WHEN o_orderpriority = '5-LOW' THEN NULL WHEN c_mktsegment = 'BUILDING' THEN 'COMMERCIAL_TI' "
    "WHEN c_mktsegment = 'MACHINERY' THEN 'PUBLIC_WORKS' WHEN c_mktsegment = 'HOUSEHOLD' THEN 'RESIDENTIAL_REMODEL' "
    "WHEN c_mktsegment = 'FURNITURE' THEN 'OFFICE_LAB' ELSE '' END",
    "city": "CASE WHEN c_acctbal < 0 THEN '' ELSE n_name END",
    "county": "r_name",
    "address": "concat(CAST(c_custkey AS STRING), ' ', n_name, ' Street')",
    "description": "concat(o_orderpriority, ' order for ', lower(c_mktsegment), CASE WHEN o_orderstatus = 'F' THEN repeat(' with more scope', 25) ELSE '' END, ' by ', c_name)",
    "project_date": f"CASE WHEN o_orderstatus = 'P' THEN NULL ELSE CAST({_DAY} AS STRING) END",
    "bid_deadline": f"CASE WHEN o_orderpriority = '1-URGENT' THEN CAST({_DAY} + 30 AS STRING) END",
    "first_seen": f"CASE WHEN o_totalprice < 3000 THEN NULL ELSE concat(CAST({_DAY} AS STRING), 'T08:30:00') END",
    "company_name": "CASE WHEN c_acctbal > 9500 THEN NULL ELSE c_name END",
    "company_key": "CASE WHEN c_acctbal > 9500 THEN NULL ELSE lower(c_name) END",
    "email": "CASE WHEN c_acctbal BETWEEN 5000 AND 9500 THEN lower(concat(replace(c_name, '#', '.'), '@example.com')) END",
    "phone": "CASE WHEN c_acctbal BETWEEN 2000 AND 6000 THEN concat('(415) 555-', right(lpad(CAST(c_custkey AS STRING), 4, '0'), 4)) "
    "WHEN c_acctbal < 0 THEN '' END",
    "website": "CASE WHEN c_mktsegment = 'BUILDING' THEN concat('www.', lower(replace(c_name, '#', '-')), '.com/') END",
    "license_number": "CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN lpad(CAST(c_custkey AS STRING), 8, '0') END",
    "source_url": "concat('https://permits.example.gov/', CAST(o_orderkey AS STRING))",
    "duplicate_of": "CASE WHEN o_totalprice > 450000 THEN 'other' END",
}


def leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders_with_customers(spark, sf_dir).selectExpr(*[f"{e} AS {n}" for n, e in LEAD.items()])


def lead_cte(name: str = "leads") -> str:
    body = ", ".join(f"{e} AS {n}" for n, e in LEAD.items())
    return f"{name} AS (SELECT {body} FROM {ORDERS_SQL})"


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as companies with licence numbers in several spellings."""
    return table(spark, sf_dir, "customer").selectExpr(*[f"{e} AS {n}" for n, e in COMPANY.items()])


COMPANY = {
    "company_key": "lower(c_name)",
    "name": "c_name",
    "license_number": "CASE WHEN c_mktsegment = 'BUILDING' THEN lpad(CAST(c_custkey AS STRING), 8, '0') "
    "WHEN c_mktsegment = 'MACHINERY' THEN CAST(c_custkey AS STRING) "
    "WHEN c_mktsegment = 'HOUSEHOLD' THEN concat('LIC', CAST(c_custkey AS STRING)) "
    "WHEN c_mktsegment = 'FURNITURE' THEN concat(' ', CAST(c_custkey AS STRING), ' ') END",
    "website": "CASE WHEN c_acctbal > 0 THEN concat('HTTPS://', replace(c_name, '#', '-'), '.Example.com/Home/?q=1') END",
    "email": "CASE WHEN c_acctbal > 5000 THEN lower(concat(replace(c_name, '#', '.'), '@example.com')) END",
    "phone": "CAST(NULL AS STRING)",
}


def company_cte(name: str = "companies") -> str:
    body = ", ".join(f"{e} AS {n}" for n, e in COMPANY.items())
    return f"{name} AS (SELECT {body} FROM customer)"
