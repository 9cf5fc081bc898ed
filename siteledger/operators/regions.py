"""Membership of places in a table of regions: cities by name, ZIP ranges by an interval join on range buckets.

Regions are rows, not expressions, so a plan has the same size for ten regions and for a hundred thousand. Rows are
first reduced to their distinct places; hot places (one city may hold a third of all rows) meet the regions once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siteledger.functions import geo
from siteledger.functions.text import null_if_empty

BUCKET = 100
CITY_SCHEMA = "region string, state string, city string"
RANGE_SCHEMA = "region string, state string, low int, high int"


def named_regions(spark: SparkSession, regions: dict[str, geo.Region]) -> tuple[DataFrame, DataFrame]:
    """(cities, ranges) tables of regions that are given as values."""
    cities = [(name, r.state, c) for name, r in regions.items() for c in r.cities]
    ranges = [(name, r.state, low, high) for name, r in regions.items() for low, high in r.zip_ranges]
    return spark.createDataFrame(cities, CITY_SCHEMA), spark.createDataFrame(ranges, RANGE_SCHEMA)


def disjoint(ranges: DataFrame) -> DataFrame:
    """Ranges of a region with overlapping and repeated ones merged; those without a ZIP (low above high, NULL) go."""
    key = ["region", "state"]
    earlier = Window.partitionBy(*key).orderBy("low", "high")
    reach = F.max("high").over(earlier.rowsBetween(Window.unboundedPreceding, -1))
    started = ranges.where("low <= high").withColumn("_new", F.when(F.col("low") <= reach, 0).otherwise(1))
    numbered = started.withColumn("_island", F.sum("_new").over(earlier.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*key, "_island").agg(F.min("low").alias("low"), F.max("high").alias("high")).drop("_island")


def place_regions(places: DataFrame, cities: DataFrame, ranges: DataFrame) -> DataFrame:
    """(city, zip, state, region) for the distinct places of ``places`` (city, zip, state) and each region they lie in.

    ``cities`` has one row per city name of a region (normal form), ``ranges`` one per inclusive ZIP range; both carry
    the region's state. A place that names another state is out; a ZIP in a range is in; else the city decides. A region
    with neither city nor range holds nothing; NULL places lie nowhere.
    """
    own = ["city", "zip", "state"]
    keyed = places.select(*own).distinct().withColumns(
        {"_city": geo.normalize_city(F.col("city")), "_zip": geo.zip_number(F.col("zip")), "_state": F.upper(null_if_empty(F.col("state")))}
    )
    guard = F.col("_state").isNull() | (F.col("_state") == F.col("r_state"))
    spread = disjoint(ranges).select(
        "region", F.col("state").alias("r_state"), "low", "high",
        F.explode(F.sequence(F.floor(F.col("low") / BUCKET), F.floor(F.col("high") / BUCKET))).alias("_bucket"),
    )
    by_zip = keyed.withColumn("_bucket", F.floor(F.col("_zip") / BUCKET)).join(spread, "_bucket").where(F.col("_zip").between(F.col("low"), F.col("high")) & guard)
    names = cities.select("region", F.col("state").alias("r_state"), F.col("city").alias("_city")).distinct()
    by_city = keyed.join(names, "_city").where(guard)
    return by_zip.select(*own, "region").unionByName(by_city.select(*own, "region")).distinct()


def with_regions(rows: DataFrame, cities: DataFrame, ranges: DataFrame) -> DataFrame:
    """``rows`` (city, zip, state and more) once for each region that they lie in, named in ``region`` (which replaces such a column)."""
    found = place_regions(rows, cities, ranges).toDF("_r_city", "_r_zip", "_r_state", "_region")
    same = [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in ("city", "zip", "state")]
    return rows.drop("region").join(found, same[0] & same[1] & same[2]).drop("_r_city", "_r_zip", "_r_state").withColumnRenamed("_region", "region")
