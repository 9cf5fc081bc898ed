"""Removal of byte runs that already occur in an earlier document, by prefix doubling over ranked positions.

A suffix array orders all positions by what follows them; to find repeats of at least ``length`` bytes it is enough
to rank positions by their next ``length`` bytes, and prefix doubling gets there by ranking pairs of shorter ranks.
Ranks are 64-bit fingerprints built by doubling (1, 2, 4, ... bytes), so equal prefixes have equal ranks, and each
Spark round sorts the ranks of all chunks and keeps what isn't unique:

1. *Half the length* (26 of 50 bytes). Every string of 50 bytes has 25 starts of 26 bytes; the one with the least rank
   is its anchor, equal strings have equal anchors, so only anchors are sorted (one position in thirteen). An anchor
   whose rank stands in one document only is done, and with it all strings it is the anchor of.
2. *The pair of ranks at either end*. The strings of one anchor are consecutive and make one segment of 50 to 74
   bytes. Equal segments are settled by their smallest doc_id; nothing is left to do for the inside of a copy.
3. *The threshold*. Where segments of one rank differ (the edges of copies), the ranks of single 50-byte strings are
   sorted. Past the threshold no longer rank is needed.

Nothing is sampled: every string has an anchor. Equality is that of 64-bit ranks (two of them for a segment).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteledger.llm import chunks as C
from siteledger.llm.hashing import PLACE, SLICE, doubling, mix, sliding_min

LENGTH = 50
#: A worker holds a few arrays of 8 bytes for every position of a chunk.
CHUNK_BYTES = 2 << 20
_RANK = np.dtype("<u4")
_SEGMENT = np.dtype([("k", "<u4"), ("s", "<u8"), ("d", "<i8")])
_STRING = np.dtype([("k", "<u8"), ("d", "<i8")])
SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, alive boolean"


class _Runs:
    """The strings of one chunk, grouped by anchor: starts ``low`` to ``high``, rank and document of each group."""

    def __init__(self, texts: list[bytes], length: int):
        self.length = length
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        self.offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)

    def slices(self, strings: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int, np.ndarray | None]]:
        """(low, high, anchor's rank, anchor's place, first position, ranks of strings) of each slice of the chunk."""
        half = self.length // 2 + 1
        tail = self.offsets[1:] - self.length + 1
        whole = np.zeros(len(self.data) + 1, np.int8)
        fits = tail > self.offsets[:-1]
        np.add.at(whole, self.offsets[:-1][fits], 1)
        np.add.at(whole, tail[fits], -1)
        whole = np.cumsum(whole, dtype=np.int8)
        for at in range(0, len(self.data), SLICE):
            view = self.data[at : at + SLICE + self.length - 1]
            starts = np.flatnonzero(whole[at : min(at + SLICE, len(self.data))])
            if not len(starts):
                continue
            ranks, *full = doubling(view, (half, self.length) if strings else (half,))
            ranks = mix(ranks)
            low_bits = np.uint64((1 << 20) - 1)
            marked = (ranks & ~low_bits) | np.arange(len(ranks), dtype=np.uint64)
            anchor = (sliding_min(marked, self.length - half + 1)[starts] & low_bits).astype(np.int64)
            new = np.flatnonzero(np.concatenate(([True], (np.diff(anchor) != 0) | (np.diff(starts) != 1))))
            last = np.append(new[1:], len(starts)) - 1
            yield starts[new], starts[last], ranks[anchor[new]], anchor[new] - starts[new], at, mix(full[0]) if strings else None

    def owner(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, positions, "right") - 1


def _grouped(texts: list[bytes], strings: bool):
    """All groups of a chunk (low, high, rank, lead, text number) and, if asked for, the rank of every string."""
    runs, parts = _Runs(texts, LENGTH), []
    full = np.zeros(len(runs.data), np.uint64) if strings else None
    for low, high, rank, lead, at, ranks in runs.slices(strings):
        parts.append((low + at, high + at, rank, lead))
        if strings:
            n = min(SLICE, len(ranks))
            full[at : at + n] = ranks[:n]
    none = np.empty(0, np.int64)
    low, high, rank, lead = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (none, none, none.astype("u8"), none)
    return runs, low, high, rank, lead, runs.owner(low), full


def _anchors(rank: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct anchor ranks of a chunk, ascending, and whether several of its documents have them."""
    if not len(rank):
        return rank, np.empty(0, bool)
    order = np.argsort(rank, kind="stable")
    rank, owner = rank[order], owner[order]
    first = np.flatnonzero(np.concatenate(([True], rank[1:] != rank[:-1])))
    return rank[first], np.minimum.reduceat(owner, first) != np.maximum.reduceat(owner, first)


def _shared(records: np.ndarray) -> np.ndarray:
    """1 where the rank stands in at least two documents."""
    _, inverse, counts = np.unique(records >> np.uint32(1), return_inverse=True, return_counts=True)
    several = np.bincount(inverse, weights=records & np.uint32(1), minlength=len(counts)) > 0
    return ((counts > 1) | several)[inverse].astype(np.uint8)


def _settle_segments(r: np.ndarray) -> np.ndarray:
    """1: an earlier document has the segment; 2: other segments of the rank stand elsewhere; 0: nothing to do."""
    order = np.lexsort((r["s"], r["k"]))
    k, s, d = r["k"][order], r["s"][order], r["d"][order]
    new_k = np.concatenate(([True], k[1:] != k[:-1]))
    new_s = new_k | np.concatenate(([True], s[1:] != s[:-1]))
    at_s, at_k = np.flatnonzero(new_s), np.flatnonzero(new_k)
    least = np.minimum.reduceat(d, at_s)[np.cumsum(new_s) - 1]
    low, high = (f.reduceat(least, at_k)[np.cumsum(new_k) - 1] for f in (np.minimum, np.maximum))
    out = np.empty(len(r), np.uint8)
    out[order] = np.where(least < d, 1, np.where((low != d) | (high != d), 2, 0))
    return out


def _settle_strings(r: np.ndarray) -> np.ndarray:
    """1: an earlier document has the string."""
    order = np.argsort(r["k"], kind="stable")
    k, d = r["k"][order], r["d"][order]
    new = np.concatenate(([True], k[1:] != k[:-1]))
    least = np.minimum.reduceat(d, np.flatnonzero(new))[np.cumsum(new) - 1]
    out = np.empty(len(r), np.uint8)
    out[order] = least < d
    return out


def _reduce(keys: tuple[np.ndarray, ...], ids: np.ndarray) -> tuple[tuple[np.ndarray, ...], np.ndarray, np.ndarray]:
    """Distinct key tuples in ascending order, their least id, and each row's place among them."""
    if not len(ids):
        return keys, ids, np.empty(0, np.int64)
    order = np.lexsort((ids, *keys[::-1]))
    new = np.zeros(len(ids), bool)
    new[0] = True
    for k in keys:
        sorted_ = k[order]
        new[1:] |= sorted_[1:] != sorted_[:-1]
    place = np.empty(len(ids), np.int64)
    place[order] = np.cumsum(new) - 1
    at = order[new]
    return tuple(k[at] for k in keys), ids[at], place


class _Chunk:
    """What a chunk knows after the first answer: its segments whose rank other documents have."""

    def __init__(self, rows: pa.Table, told: pa.Table | None):
        self.ids, self.texts = C.texts_of(rows)
        self.runs, low, high, rank, lead, owner, self.string = _grouped(self.texts, True)
        ranks, _ = _anchors(rank, owner)
        common = ranks[C.replies(told, 1, "u1") > 0] if len(ranks) else ranks
        if len(common):
            keep = np.flatnonzero(common[np.minimum(np.searchsorted(common, rank), len(common) - 1)] == rank)
        else:
            keep = np.empty(0, np.int64)
        self.low, self.high, self.rank, lead = low[keep], high[keep], rank[keep], lead[keep]
        self.size = self.high - self.low + 1
        ends = self.string[self.low] * PLACE[0] + self.string[self.high] * PLACE[1]
        self.code = mix(ends + (self.size * 64 + lead).astype(np.uint64) * PLACE[2])
        self.doc = self.ids[owner[keep]]

    def segments(self):
        return _reduce((self.rank, self.code), self.doc)

    def settled(self, told: pa.Table | None) -> tuple[np.ndarray, np.ndarray]:
        """Segments that are gone as a whole, and those whose strings have to be looked at one by one."""
        _, least, place = self.segments()
        said = C.replies(told, 2, "u1")[place] if len(place) else np.empty(0, "u1")
        gone = (said == 1) | (self.doc > least[place]) if len(place) else np.empty(0, bool)
        return gone, (said == 2) & ~gone

    def open_strings(self, open_: np.ndarray):
        at = np.flatnonzero(open_)
        n = self.size[at]
        each = np.arange(int(n.sum()))
        each -= np.repeat(np.cumsum(n) - n, n)
        which = np.repeat(at, n)
        place = self.low[which]
        place += each
        return which, each, _reduce((self.string[place],), self.doc[which])


def _covered(begin: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` positions a run covers; overlapping runs are joined first, so one byte a position is enough."""
    edges = np.zeros(n + 1, np.int8)
    if len(begin):
        order = np.argsort(begin, kind="stable")
        begin, reach = begin[order], np.maximum.accumulate(end[order])
        new = np.concatenate(([True], begin[1:] > reach[:-1]))
        edges[begin[new]] = 1
        edges[reach[np.append(new[1:], True)]] = -1
    return np.cumsum(edges, dtype=np.int8)[:n].astype(bool)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Each text without the bytes that a ``LENGTH``-byte string of a document with a smaller doc_id covers.

    One row per row of ``docs`` (doc_id, text): doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256
    and the kept bytes. A NULL text is empty; texts under ``LENGTH`` bytes lose nothing. A NULL doc_id counts as larger
    than all others; rows of one doc_id don't remove from each other. An empty table gives no rows; other columns of
    ``docs`` are ignored.
    """
    return _removed(docs, ()).drop("alive")


def rewritten(docs: DataFrame) -> DataFrame:
    """``docs`` with the kept text in place of text, and n_chars that of it; rows of which nothing is left go.

    Whole characters are kept if any of their bytes is. Rows that lose nothing, also NULL and empty ones, stay as they
    are; all other columns pass through.
    """
    names = docs.columns
    inner = [c if c in ("doc_id", "text", "n_chars") else f"c{i}" for i, c in enumerate(names)]
    plain = docs.toDF(*inner)
    carried = plain.select("doc_id", "text", F.struct(*[c for c in inner if c != "text"]).alias("carried"))
    found = _removed(carried, ("carried",)).where("alive").withColumn("text", F.col("kept").cast("string"))
    columns = [F.col("text") if c == "text" else F.col(f"carried.{c}").alias(c) for c in inner]
    if "n_chars" in inner:
        length = F.length("text").cast(plain.schema["n_chars"].dataType)
        columns[inner.index("n_chars")] = F.when(F.col("n_removed") > 0, length).otherwise(F.col("carried.n_chars")).alias("n_chars")
    return found.select(*columns).toDF(*names)


def _whole_characters(text: bytes, removed: np.ndarray) -> bytes:
    """What is left of ``text``; a character of which some bytes stay keeps all of them."""
    data = np.frombuffer(text, np.uint8)
    starts = np.flatnonzero((data & 0xC0) != 0x80)
    if not len(starts) or starts[0]:
        starts = np.concatenate(([0], starts))
    gone = np.logical_and.reduceat(removed, starts)
    return data[~np.repeat(gone, np.diff(np.append(starts, len(data))))].tobytes()


def _removed(docs: DataFrame, carried: tuple[str, ...]) -> DataFrame:
    """The rows of ``remove_repeats``; with ``carried``, that column as it is and kept in whole characters."""
    chunks = C.chunked(docs, carried, CHUNK_BYTES)
    shift = 64 - chunks.bits - 32
    schema = SCHEMA + "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in carried)

    def ranks(rows, _):
        _, _, _, rank, _, owner, _ = _grouped(C.texts_of(rows)[1], False)
        rank, several = _anchors(rank, owner)
        short = (rank >> np.uint64(shift)) & np.uint64(0xFFFFFFFE)
        return rank, (short | several.astype(np.uint64)).astype(_RANK)

    def segments(rows, told):
        (rank, code), least, _ = _Chunk(rows, told).segments()
        out = np.empty(len(rank), _SEGMENT)
        out["k"], out["s"], out["d"] = (rank >> np.uint64(shift)).astype(np.uint32), code, least
        return rank, out

    def strings(rows, told):
        chunk = _Chunk(rows, told)
        _, _, ((key,), least, _) = chunk.open_strings(chunk.settled(told)[1])
        out = np.empty(len(key), _STRING)
        out["k"], out["d"] = key, least
        return key, out

    def finish(rows, told):
        chunk = _Chunk(rows, told)
        gone, open_ = chunk.settled(told)
        which, each, (_, least, place) = chunk.open_strings(open_)
        said = C.replies(told, 3, "u1")
        lost = (said[place] == 1) | (chunk.doc[which] > least[place]) if len(place) else np.empty(0, bool)
        begin = np.concatenate((chunk.low[gone], (chunk.low[which] + each)[lost])).astype(np.int64)
        end = np.concatenate((chunk.high[gone], (chunk.low[which] + each)[lost])).astype(np.int64) + LENGTH
        removed = _covered(begin, end, len(chunk.runs.data))
        out: dict[str, list] = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "alive")}
        nulls = rows.column("text").is_null().to_pylist()
        for a, b, text, null in zip(chunk.runs.offsets[:-1], chunk.runs.offsets[1:], chunk.texts, nulls, strict=True):
            mask = removed[a:b]
            kept = chunk.runs.data[a:b][~mask].tobytes() if mask.any() else text
            if carried and mask.any():
                kept = _whole_characters(text, mask)
            out["alive"].append(bool(kept) or not text)
            out["n_bytes"].append(len(text))
            out["n_removed"].append(len(text) - len(kept))
            out["n_spans"].append(int(mask[:1].sum() + (mask[1:] & ~mask[:-1]).sum()))
            out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            out["kept"].append(None if null else kept)
        plain = pa.table({"doc_id": rows.column("doc_id"), **out}).cast(_ARROW)
        return plain.append_column("carried", rows.column("carried")) if carried else plain

    one = C.exchange(chunks, 1, ranks, _shared, _RANK)
    two = C.exchange(chunks, 2, segments, _settle_segments, _SEGMENT, one)
    three = C.exchange(chunks, 3, strings, _settle_strings, _STRING, one.unionByName(two))
    return C.with_answers(chunks, one.unionByName(two).unionByName(three), finish, schema)


_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary()), ("alive", pa.bool_())]
)
