"""Landing folder -> raw records, projects, companies, one snapshot per micro-batch.

State lives in ``<root>/<table>/batch=<n>``. Batch n reads the newest finished snapshot before n
and writes its own, so a batch that runs again after a failure gives the same result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siteledger import schemas as S
from siteledger.config import SourceConfig
from siteledger.operators import upsert as U
from siteledger.operators.classify import classify_projects
from siteledger.operators.normalize import companies_of, normalize

Reader = Callable[[DataFrame], DataFrame]


class Snapshots:
    """Numbered parquet snapshots of one table."""

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema

    def _finished(self) -> list[int]:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        names = [(s.getPath().getName(), s.getPath()) for s in fs.listStatus(path)]
        done = [
            int(name.split("=", 1)[1])
            for name, p in names
            if name.startswith("batch=") and fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))
        ]
        return sorted(done)

    def before(self, batch: int | None = None) -> DataFrame:
        """Newest finished snapshot older than ``batch`` (or the newest of all)."""
        older = [n for n in self._finished() if batch is None or n < batch]
        if not older:
            return U.empty(self.spark, self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.root}/batch={older[-1]}")

    def write(self, df: DataFrame, batch: int) -> DataFrame:
        target = f"{self.root}/batch={batch}"
        S.conform(df, self.schema).write.mode("overwrite").parquet(target)
        return self.spark.read.schema(self.schema).parquet(target)


def process_batch(
    spark: SparkSession, incoming: DataFrame, cfg: SourceConfig, root: str, batch: int, now: Column, watermark: Column | None = None
) -> None:
    """One micro-batch of raw records of one source: upsert, normalise what changed, classify."""
    raw_table = Snapshots(spark, f"{root}/raw", S.RAW)
    project_table = Snapshots(spark, f"{root}/projects", S.PROJECT)
    company_table = Snapshots(spark, f"{root}/companies", S.COMPANY)
    mark_table = Snapshots(spark, f"{root}/watermarks", S.WATERMARK)

    stage = Snapshots(spark, f"{root}/raw_stage", S.RAW)
    raw = stage.write(U.upsert_raw(raw_table.before(batch), incoming, now), batch)
    projects = project_table.before(batch)
    todo = U.needs_normalizing(raw, projects)
    fresh = normalize(todo, cfg)
    project_table.write(classify_projects(U.upsert_projects(projects, fresh, now)), batch)
    company_table.write(U.upsert_companies(company_table.before(batch), companies_of(fresh), now), batch)
    raw_table.write(U.mark_processed(raw, todo), batch)
    if watermark is not None:
        marks = incoming.groupBy("source").agg(F.max(watermark).alias("watermark"))
        mark_table.write(U.upsert_watermarks(mark_table.before(batch), marks, now), batch)


def run_landing(
    spark: SparkSession,
    landing: str,
    reader: Reader,
    cfg: SourceConfig,
    root: str,
    now: Column | None = None,
    watermark: Column | None = None,
    one_per_line: bool = True,
) -> None:
    """Process every landed response not seen before, then stop.

    Files hold one response per line, so a large file is split; without ``one_per_line`` a file is
    one response and has to fit a task. ``reader`` maps response rows to raw records. Which files were seen is kept in the stream's
    checkpoint below ``root``.
    """
    stamp = now if now is not None else F.current_timestamp()
    stream = spark.readStream.format("text").option("wholetext", not one_per_line).load(landing).select(F.col("value").alias("response"))

    def batch(df: DataFrame, number: int) -> None:
        process_batch(df.sparkSession, reader(df), cfg, root, number, stamp, watermark)

    query = (
        stream.writeStream.trigger(availableNow=True)
        .option("checkpointLocation", f"{root}/_stream")
        .foreachBatch(batch)
        .start()
    )
    query.awaitTermination()


def distinct_events(stream: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """Late re-deliveries dropped by key, with state bounded by the watermark."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)
