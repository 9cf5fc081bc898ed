"""Documents in chunks of bounded size, and an exchange that answers questions about keys of the whole corpus.

A chunk holds a few MB of whole texts. For keys that occur by the hundred million (positions, shingles, words)
one Spark row each would cost more than the work itself, so a chunk sends its distinct keys as packed arrays: one
row per (bucket of the key space, chunk). A bucket sorts what all chunks sent, decides, and answers every chunk in
the order of its own keys. A key is sent once by a chunk however often it occurs there, so no key, source or group
of copies makes a hot task. Rows never outnumber the keys, and both sides are plain shuffles that Spark repeats
when an executor is lost: the same chunk always yields the same sorted keys.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK_BYTES = 4 << 20
#: Stands for a doc_id that is NULL: larger than every other.
NO_ID = np.int64(2**63 - 1)
REPLY = "chunk long, step int, bucket long, reply binary"


@dataclass(frozen=True)
class Chunks:
    """``df`` has (chunk, doc_id, text as bytes); keys are dealt to ``2 ** bits`` buckets, a quarter or
    so of the number of chunks."""

    df: DataFrame
    bits: int


def chunked(docs: DataFrame, carried: tuple[str, ...] = (), chunk_bytes: int = CHUNK_BYTES) -> Chunks:
    """Whole texts of ``docs`` (doc_id, text and ``carried``), dealt by hash to chunks of about ``chunk_bytes``.

    The number of chunks follows the bytes of the table, so a chunk is as large at any scale; one text is never split.
    """
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(2 * partitions, -(-size // chunk_bytes))
    buckets = max(2 * partitions, -(-size // CHUNK_BYTES))
    chunk = F.pmod(F.xxhash64("doc_id", "text"), F.lit(count)).alias("chunk")
    df = docs.select(chunk, F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), *carried)
    return Chunks(df, max(1, (buckets - 1).bit_length() - 2))


def in_batches(docs: DataFrame, function: Callable, extra: str = "") -> DataFrame:
    """``docs`` through ``mapInArrow`` with all its columns, whatever their names, and the columns of ``extra`` after them.

    ``function`` finds the text under its name; other columns keep their place.
    """
    inner = [c if c == "text" else f"c{i}" for i, c in enumerate(docs.columns)]
    ddl = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(inner, docs.schema.fields, strict=True))
    out = docs.toDF(*inner).mapInArrow(function, ddl + extra)
    return out.toDF(*docs.columns, *out.columns[len(inner) :])


def texts_of(table: pa.Table) -> tuple[np.ndarray, list[bytes]]:
    """The ids (``NO_ID`` for NULL) and the bytes (empty for NULL) of a chunk's rows."""
    ids = table.column("doc_id").fill_null(int(NO_ID)).to_numpy()
    return ids, [b"" if t is None else t for t in table.column("text").to_pylist()]


def ordered(rows: pa.Table) -> pa.Table:
    """A chunk's rows by id and text: a chunk that is read again has to ask the same in the same order."""
    ids, texts = texts_of(rows)
    return rows.take(pa.array(sorted(range(len(texts)), key=lambda i: (ids[i], texts[i])), pa.int64()))


def replies(table: pa.Table | None, step: int, kind: str) -> np.ndarray:
    """The answers of one exchange, in the order of the keys that the chunk had sent."""
    if table is None or not table.num_rows:
        return np.empty(0, kind)
    steps = table.column("step").to_numpy()
    rows = np.flatnonzero(steps == step)
    order = rows[np.argsort(table.column("bucket").to_numpy()[rows])]
    parts = table.column("reply")
    return np.frombuffer(b"".join(parts[int(i)].as_py() for i in order), kind)


def give_back() -> None:
    """Return freed memory to the system: workers live on from stage to stage, and the allocators would keep it all."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc; others have their own ways
    if trim is not None:
        trim(0)


def _lean(function: Callable[..., pa.Table]) -> Callable[..., pa.Table]:
    """``function`` of a group, whose arrays are given back before the next group's are made."""

    def of_group(*tables: pa.Table) -> pa.Table:
        give_back()  # what another stage has left in this worker
        out = function(*tables)
        give_back()
        return out

    return of_group


def exchange(
    chunks: Chunks,
    step: int,
    emit: Callable[[pa.Table, pa.Table | None], tuple[np.ndarray, np.ndarray]],
    settle: Callable[..., np.ndarray],
    record: np.dtype,
    known: DataFrame | None = None,
    facts: DataFrame | None = None,
    tasks: int | None = None,
) -> DataFrame:
    """Answers (chunk, step, bucket, reply) to what every chunk asks.

    ``emit(rows, known)`` gives a chunk's ascending 64-bit routing keys and one record for each; ``settle`` gets the
    records of a bucket from all chunks and gives an array of answers, one for each record. With ``facts`` (bucket and
    more columns), ``settle`` gets the bucket's rows of it as well. Few chunks may ask in as few ``tasks``.
    """
    shift, kind = np.uint64(64 - chunks.bits), np.dtype(record)

    def send(rows: pa.Table, known: pa.Table | None = None) -> pa.Table:
        chunk = rows.column("chunk")[0].as_py() if rows.num_rows else 0
        keys, records = emit(ordered(rows), known)
        buckets = (keys >> shift).astype(np.int64)
        cuts = np.flatnonzero(np.diff(buckets)) + 1
        starts = np.concatenate(([0], cuts)) if len(buckets) else np.empty(0, np.int64)
        ends = np.append(starts[1:], len(buckets)).astype(np.int64)
        blobs = [records[a:b].astype(kind, copy=False).tobytes() for a, b in zip(starts, ends, strict=False)]
        return pa.table(
            {
                "bucket": pa.array(buckets[starts.astype(np.int64)], pa.int64()),
                "chunk": pa.array([chunk] * len(blobs), pa.int64()),
                "records": pa.array(blobs, pa.binary()),
            }
        )

    def answer(rows: pa.Table, *told: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x, kind) for x in rows.column("records").to_pylist()]
        said = settle(np.concatenate([np.empty(0, kind), *parts]), *told)
        ends = np.cumsum([len(p) for p in parts])
        blobs = [said[e - len(p) : e].tobytes() for p, e in zip(parts, ends, strict=True)]
        return pa.table(
            {
                "chunk": rows.column("chunk"),
                "step": pa.array([step] * len(blobs), pa.int32()),
                "bucket": rows.column("bucket"),
                "reply": pa.array(blobs, pa.binary()),
            }
        )

    asking, answering = _lean(send), _lean(answer)
    sent = "bucket long, chunk long, records binary"
    own = chunks.df.groupBy("chunk")
    if known is None:
        asked = own.applyInArrow(lambda rows: asking(rows), sent)
    else:
        asked = own.cogroup(known.groupBy("chunk")).applyInArrow(lambda rows, told: asking(rows, told), sent)
    by_bucket = (asked if tasks is None else asked.coalesce(tasks)).groupBy("bucket")
    if facts is None:
        answers = by_bucket.applyInArrow(lambda rows: answering(rows), REPLY)
        return answers if tasks is None else answers.coalesce(tasks)
    return by_bucket.cogroup(facts.groupBy("bucket")).applyInArrow(lambda rows, told: answering(rows, told), REPLY)


def with_answers(chunks: Chunks, known: DataFrame, finish: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """``finish`` over every chunk's rows and the answers it got."""
    finishing = _lean(lambda rows, told: finish(ordered(rows), told))
    return chunks.df.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(lambda rows, told: finishing(rows, told), schema)
