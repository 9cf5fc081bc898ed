"""Landed responses of several sources -> logs of new and changed records, projects and company sightings.

What a record was when last seen is keyed state of the stream (RocksDB below the checkpoint), so a micro-batch reads and
writes the buckets of the keys it brings and nothing else; no table is rewritten. Every batch appends a folder to each log
and a repeated batch replaces its own folder. The tables of records, projects and companies are mergeable aggregates over
the logs.

All sources land in one table (`sources.landing`). Each is a stream of its own, over its own folder and by the reader of its
kind, with a checkpoint of its own: sources come and go between runs, and one that fails holds up no other.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from siteledger import schemas as S
from siteledger.config import SourceConfig
from siteledger.operators import upsert as U
from siteledger.operators.classify import classify_projects
from siteledger.operators.normalize import companies_of, normalize
from siteledger.sources import landing as L
from siteledger.sources.records import read_source

_VALUES = ["payload", "contact", "contact_digest", "source_url", "content_hash", "fetched_at"]
#: A record as it came; values are NULL where the content is that of the revision before.
CHANGE = T.StructType(
    [S.RAW[c] for c in [*U.KEY, *_VALUES, "first_seen", "last_seen"]] + [T.StructField("revision", T.LongType()), T.StructField("changed", T.BooleanType())]
)
#: Keys of a source share so many state values: a value costs Python some milliseconds, whatever it holds, a key in it some hundredths.
#: A checkpoint is bound to this number.
_BUCKETS = 4_096
_STATE = "ids array<string>, hashes array<string>, first_seen array<bigint>, revisions array<bigint>"
#: State in RocksDB; a batch commits what it changed, not the whole store.
_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


_NOTHING = [None] * len(_VALUES)


class _LastSeen(StatefulProcessor):
    """Keeps hash, first sighting and revision of the keys of a bucket; a sighting is one row out, with its values if they are new."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._seen = handle.getValueState("seen", _STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        newest = {}
        for frame in rows:
            for record, *values in zip(frame["source_record_id"], *[frame[c] for c in _VALUES]):
                order, held = (values[-1], values[-2]), newest.get(record)
                if held is None or order > held[0]:
                    newest[record] = (order, values)
        ids, *columns = self._seen.get() or ([], [], [], [])
        seen, found = dict(zip(ids, zip(*columns))), []
        for record, ((fetched, content), values) in newest.items():
            known, first, revision = seen.get(record, (None, fetched, 0))
            changed = record not in seen or known != content
            if changed:
                seen[record] = (content, first, revision := revision + 1)
            found.append((key[0], record, *(values if changed else _NOTHING), first, fetched, revision, changed))
        if any(row[-1] for row in found):
            self._seen.update((list(seen), *map(list, zip(*seen.values()))))
        # Columns of objects: a number that is missing leaves the others whole numbers.
        yield pd.DataFrame({c: pd.Series(v, dtype=object) for c, v in zip(CHANGE.names, zip(*found))})

    def close(self) -> None:
        pass


def newest_of_each_arrow_batch(records: DataFrame) -> DataFrame:
    """Drops rows of a key that a later one of the same Arrow batch replaces, before anything is shuffled.

    A key that a third of all rows carry then goes on as a row per batch.
    """

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            rows = rows.take(pc.sort_indices(rows, [(c, "ascending") for c in [*U.KEY, "fetched_at", "content_hash"]]))
            same = [pc.equal(rows[c][:-1], rows[c][1:]).combine_chunks() for c in U.KEY]
            last = pa.chunked_array([pc.invert(pc.and_(*same)), pa.array([True])])
            yield from rows.filter(pc.fill_null(last, True)).to_batches()

    return records.mapInArrow(keep, records.schema)


def changes(records: DataFrame) -> DataFrame:
    """One row per key and micro-batch of a stream of raw records with ``fetched_at``; see `CHANGE`."""
    rows = newest_of_each_arrow_batch(S.conform(records, T.StructType([S.RAW[c] for c in [*U.KEY, *_VALUES]])))
    # Times go through Python as numbers, contacts as text.
    rows = rows.withColumns({"fetched_at": F.unix_micros("fetched_at"), "contact": F.to_json("contact"), "bucket": F.pmod(F.xxhash64("source_record_id"), F.lit(_BUCKETS))})
    plain = {"timestamp": T.LongType(), "struct": T.StringType()}
    flat = T.StructType([T.StructField(f.name, plain.get(f.dataType.typeName(), f.dataType)) for f in CHANGE])
    found = rows.groupBy("source", "bucket").transformWithStateInPandas(_LastSeen(), flat, "Append", "None")
    back = {f.name: F.timestamp_micros(f.name) for f in CHANGE if f.dataType.typeName() == "timestamp"}
    return found.withColumns(back | {"contact": F.from_json("contact", CHANGE["contact"].dataType)})


def run_sources(
    spark: SparkSession, landing: str, configs: Mapping[str, SourceConfig], root: str, now: Column | None = None, at_once: int = 8
) -> None:
    """Process every response that landed since the last run, ``at_once`` sources side by side, then stop.

    A source that fails is raised after the others of all sources have run.
    """
    names = [n for n in configs if L.has_landed(spark, landing, n)]
    stamp = F.current_timestamp() if now is None else now
    before, failed = {k: spark.conf.get(k, None) for k in _STORE}, []
    for k, v in _STORE.items():
        spark.conf.set(k, v)
    try:
        for k in range(0, len(names), at_once):
            for query in [_start(spark, landing, n, configs[n], root, stamp) for n in names[k : k + at_once]]:
                try:
                    query.awaitTermination()
                except StreamingQueryException as error:
                    failed.append(error)
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    if failed:
        raise failed[0]


def _start(spark: SparkSession, landing: str, name: str, cfg: SourceConfig, root: str, now: Column) -> StreamingQuery:
    def batch(df: DataFrame, number: int) -> None:
        def log(rows: DataFrame, table: str) -> DataFrame:
            path = f"{root}/{table}/{L.folder(spark, name)}/batch={number}"
            rows.write.mode("overwrite").parquet(path)
            return rows.sparkSession.read.schema(rows.schema).parquet(path)

        # Read back: the state must not be asked again for what follows.
        changed = log(df, "records").where("changed")
        fresh = normalize(changed, cfg)
        projects = U.upsert_projects(U.empty(df.sparkSession, S.PROJECT), fresh, now).drop("first_seen", "last_seen")
        log(classify_projects(projects.join(changed.select(*U.KEY, "revision", "first_seen", "last_seen"), U.KEY)), "projects")
        log(companies_of(fresh), "companies")

    # A file that one task wrote is one task here; its responses are dealt out before they are parsed.
    responses = L.landed_stream(spark, landing, source=name).select("response").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    records = read_source(name, cfg, responses).withColumn("fetched_at", now)
    query = changes(records).writeStream.trigger(availableNow=True).foreachBatch(batch)
    return query.option("checkpointLocation", f"{root}/_stream/{L.folder(spark, name)}").start()


def _log(spark: SparkSession, root: str, table: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(f"{root}/{table}/*/*")


def records_table(spark: SparkSession, root: str) -> DataFrame:
    """Every record with the values of its last revision, first and last sighting, and its number of revisions."""
    rows = _log(spark, root, "records", CHANGE)
    values = F.max_by(F.struct(*_VALUES), F.when(F.col("changed"), F.col("revision"))).alias("_v")
    last = rows.groupBy(*U.KEY).agg(values, F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.max("revision").alias("revision"))
    return last.select(*U.KEY, "_v.*", "first_seen", "last_seen", "revision")


def projects_table(spark: SparkSession, root: str, reclassify_changed: bool = False) -> DataFrame:
    """Every project as of the last revision of its record; last_seen is when that revision came.

    A changed project keeps its first category, unless ``reclassify_changed``.
    """
    rows = _log(spark, root, "projects")
    rest = [c for c in rows.columns if c not in (*U.KEY, "category", "confidence")]
    verdict = F.struct("category", "confidence")
    kept = F.max_by(verdict, "revision") if reclassify_changed else F.min_by(verdict, "revision")
    last = rows.groupBy(*U.KEY).agg(F.max_by(F.struct(*rest), "revision").alias("_v"), kept.alias("_k"))
    return S.conform(last.select(*U.KEY, "_v.*", "_k.*"), S.PROJECT)


def companies_table(spark: SparkSession, root: str, now: Column) -> DataFrame:
    """All company sightings consolidated, the latest value that is not NULL first."""
    return U.upsert_companies(U.empty(spark, S.COMPANY), _log(spark, root, "companies"), now)
