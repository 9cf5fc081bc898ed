"""Duplicates kept up to date: a delivery costs the blocks it touches, not the table.

Components never cross a block, so a new or changed record can only change the plan of the block it is in and of the
block it was in. The state below ``root`` is three Parquet tables, each in ``buckets`` folders:

* ``records``: prepared records (token sets, rank, block) by bucket of the block;
* ``plan``: (id, canonical_id, block) of every duplicate, by the same buckets;
* ``places``: (id, block) by bucket of the id, to find where a changed record was.

A delivery reads and rewrites only folders that hold a touched block or a delivered id; only touched blocks are
compared again. Writing replaces whole folders after the new contents were written elsewhere, and a delivery that is
repeated after a failure gives the same state: its records replace themselves.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siteledger.operators.dedupe import ADDRESS_THRESHOLD, TILE_ROWS, TITLE_THRESHOLD, plan_of, prepare
from siteledger.session import cut

BUCKETS = 256


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("bucket")


def _read(spark: SparkSession, path: str, touched: list[int], schema: str) -> DataFrame:
    """The folders of ``touched`` buckets; none before the first delivery."""
    try:
        return spark.read.schema(f"{schema}, bucket int").parquet(path).where(F.col("bucket").isin(touched))
    except AnalysisException:
        return spark.createDataFrame([], f"{schema}, bucket int")


def _replace(rows: DataFrame, path: str, touched: list[int]) -> None:
    """Make ``rows`` the contents of the touched buckets. Folders left without rows get one row without block, which
    readers skip, as a folder that nothing is written to would keep its old rows."""
    spark = rows.sparkSession
    held = [c for c in rows.columns if c != "bucket"]
    marks = spark.createDataFrame([(b,) for b in touched], "bucket int").select(
        *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in held], "bucket"
    )
    whole = cut(rows.select(*held, "bucket").unionByName(marks))
    whole.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != "bucket")


def deliver(
    batch: DataFrame,
    root: str,
    address_threshold: float = ADDRESS_THRESHOLD,
    title_threshold: float = TITLE_THRESHOLD,
    block: Column | None = None,
    tile_rows: int = TILE_ROWS,
    buckets: int = BUCKETS,
) -> DataFrame:
    """Take in new and changed records (one row an id) and return the plan of all blocks they touch: (id, canonical_id).

    ``batch`` has the columns of ``dedupe.prepare``. A record whose new version has no block, address or title leaves the
    state. The bucket numbers that a delivery touches, ``buckets`` at most, are all that reaches the driver.
    """
    spark = batch.sparkSession
    ids = cut(batch.select("id").distinct().withColumn("id_bucket", _bucket("id", buckets)))
    fresh = cut(prepare(batch, block))
    id_buckets = [r.id_bucket for r in ids.select("id_bucket").distinct().collect()]
    id_type = batch.schema["id"].dataType.simpleString()
    places = _read(spark, f"{root}/places", id_buckets, f"id {id_type}, block string").where("block IS NOT NULL")
    before = places.join(ids.select("id"), "id", "left_semi").select("block")
    touched = cut(before.union(fresh.select("block")).distinct().withColumn("block_bucket", _bucket("block", buckets)))
    block_buckets = [r.block_bucket for r in touched.select("block_bucket").distinct().collect()]

    held = _read(spark, f"{root}/records", block_buckets, _ddl(fresh)).where("block IS NOT NULL")
    others = held.join(ids.select("id"), "id", "left_anti")
    affected = cut(others.drop("bucket").join(touched.select("block"), "block", "left_semi").select(*fresh.columns).unionByName(fresh))
    plan = cut(
        plan_of(affected, address_threshold, title_threshold, tile_rows).join(affected.select("id", "block"), "id").select("id", "canonical_id", "block")
    )
    untouched = others.join(touched.select("block"), "block", "left_anti")
    _replace(untouched.unionByName(affected.withColumn("bucket", _bucket("block", buckets))), f"{root}/records", block_buckets)
    old_plan = _read(spark, f"{root}/plan", block_buckets, _ddl(plan)).where("block IS NOT NULL").join(touched.select("block"), "block", "left_anti")
    _replace(old_plan.unionByName(plan.withColumn("bucket", _bucket("block", buckets))), f"{root}/plan", block_buckets)
    # Last, so a delivery that failed before still finds where its records were.
    rest = places.join(ids.select("id"), "id", "left_anti")
    _replace(rest.unionByName(fresh.select("id", "block").withColumn("bucket", _bucket("id", buckets))), f"{root}/places", id_buckets)
    return plan.select("id", "canonical_id")


def current_plan(spark: SparkSession, root: str) -> DataFrame:
    """(id, canonical_id) of every duplicate of all deliveries so far."""
    return spark.read.parquet(f"{root}/plan").where("block IS NOT NULL").select("id", "canonical_id")
