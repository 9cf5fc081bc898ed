"""Hard negatives by exact integer scores: a matrix product in a residue number system.

Integer components are reduced modulo several small primes to symmetric residues so small that a float32 matrix product
of them is exact: with ``half = (p - 1) / 2``, ``width * half^2 <= 2^24``, so no partial sum is ever rounded, in whatever
order it is added. The products modulo each prime give the signed score by Chinese remaindering with symmetric
mixed-radix digits; the primes multiply to more than twice the largest possible score, which is measured (norms).

Anchors come in blocks of bounded size that are broadcast; the rows of the table never move. Two passes a block:

1. *Positives*: the best rows of the anchor's label.
2. *Negatives*: of the other labels, the best rows within the window that each positive opens.

A partition keeps the best few of each anchor (and positive) and Spark merges them by a window. Thresholds from a pass
over the anchors, a sample of the rows, keep a partition from reporting what can't be among the best.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteledger.llm import vectors as V
from siteledger.session import cut

SCALE = 256
POSITIVES = 5
NEGATIVES = 10
LOW, HIGH = 30, 90
#: Anchors and bytes of anchors in a block, which is broadcast.
BLOCK_ANCHORS, BLOCK_BYTES = 1 << 14, 32 << 20
#: Components of one exact float32 product; longer vectors are added up slice by slice.
SLICE = 4096
#: Largest magnitude of an integer component.
LARGEST = 1 << 31
_TILE = 256
_NONE = np.int64(-(2**63))
_PICKED = "anchor long, place int, score long, vec_id long"
_RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def moduli(width: int, largest: int) -> list[int]:
    """Primes whose product exceeds twice ``largest`` and whose residues multiply exactly in float32."""
    if largest >= 1 << 62:
        raise ValueError("scores would not fit a long")
    half = math.isqrt((1 << 24) // max(1, min(width, SLICE)))
    primes: list[int] = []
    candidate = min(2 * half + 1, 4095)
    while math.prod(primes) <= 2 * largest + 1:
        if all(candidate % d for d in range(2, math.isqrt(candidate) + 1)):
            primes.append(candidate)
        candidate -= 2
    return primes


def residues(q: np.ndarray, primes: list[int]) -> list[np.ndarray]:
    """Symmetric residues of integer rows for each prime, as float32."""
    out = []
    for p in primes:
        r = q % p
        out.append((r - p * (r > p // 2)).astype(np.float32))
    return out


def scores(left: list[np.ndarray], right: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """Exact inner products of all rows of ``left`` with all rows of ``right``, given by their residues."""
    width = min(left[0].shape[1], right[0].shape[1])
    total, radix = np.zeros((len(left[0]), len(right[0])), np.int64), 1
    for a, b, p in zip(left, right, primes, strict=True):
        rest = np.zeros(total.shape, np.int32)
        for at in range(0, width, SLICE):
            end = min(width, at + SLICE)
            rest = (rest + (a[:, at:end] @ b[:, at:end].T).astype(np.int32)) % np.int32(p)
        digit = rest.astype(np.int64) if radix == 1 else (rest - total % p) * pow(radix, -1, p) % p
        digit -= p * (digit > p // 2)
        total += digit * radix
        radix *= p
    return total


class _Best:
    """The best ``k`` (score, then smaller id) of many slots, over blocks of rows in ascending order of ids."""

    def __init__(self, least: np.ndarray, k: int):
        self.least, self.k, self.parts, self.size = least.copy(), k, [], 0

    def take(self, slots: np.ndarray, found: np.ndarray, allowed: np.ndarray, ids: np.ndarray) -> None:
        allowed = allowed & (found >= self.least[slots][:, None])
        some = np.flatnonzero(allowed.any(axis=1))
        if not len(some):
            return
        value, pick = np.where(allowed[some], found[some], _NONE), allowed[some]
        if value.shape[1] > self.k:
            edge = np.partition(value, value.shape[1] - self.k, axis=1)[:, -self.k, None]
            pick = value > edge
            ties = (value == edge) & (edge > _NONE)
            pick |= ties & (np.cumsum(ties, axis=1) <= self.k - pick.sum(axis=1, keepdims=True))
        i, j = np.nonzero(pick)
        self.parts.append((slots[some][i], value[i, j], ids[j]))
        self.size += len(i)
        if self.size > max(1 << 16, len(self.least) * self.k):
            self.settled()

    def settled(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(slot, score, id) of the best so far, best first; their thresholds hold from now on."""
        none = np.empty(0, np.int64)
        slot, score, ids = (np.concatenate(x) for x in zip(*self.parts, strict=True)) if self.parts else (none, none, none)
        order = np.lexsort((ids, -score, slot))
        slot, score, ids = slot[order], score[order], ids[order]
        first = np.searchsorted(slot, slot)
        keep = np.arange(len(slot)) - first < self.k
        slot, score, ids = slot[keep], score[keep], ids[keep]
        last = np.flatnonzero(np.arange(len(slot)) - np.searchsorted(slot, slot) == self.k - 1)
        self.least[slot[last]] = np.maximum(self.least[slot[last]], score[last])
        self.parts, self.size = [(slot, score, ids)], len(slot)
        return slot, score, ids


class _Anchors:
    """A block of anchors: keys, ids, labels, residues; the windows of their positives once these are known."""

    def __init__(self, rows: pa.Table, primes: list[int], width: int, scale: int):
        rows = rows.combine_chunks()
        self.primes, self.scale = primes, scale
        self.keys, self.ids, self.labels = (rows.column(c).to_numpy() for c in ("anchor", "vec_id", "label"))
        column = rows.column("q").combine_chunks()
        self.residues = residues(V.matrix(column, np.arange(len(self.keys)), width), primes)

    def set_windows(self, positives: pa.Table, places: int, low: int, high: int) -> None:
        at = np.argsort(self.keys)[np.searchsorted(np.sort(self.keys), positives.column("anchor").to_numpy())]
        place, score = positives.column("place").to_numpy(), positives.column("score").to_numpy()
        self.low, self.high = np.full((len(self.keys), places), 1), np.full((len(self.keys), places), 0)
        whole, rest = score // 100, score % 100
        self.low[at, place] = whole * low - (-rest * low // 100)
        self.high[at, place] = whole * high + rest * high // 100


def _rows(batches, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, labels, components) of usable rows in blocks, by ascending id."""
    for batch in batches:
        usable, lengths, floor = V.quantised(batch.column("embedding"), scale)
        ids, labels = batch.column("vec_id"), batch.column("label")
        usable &= ~(ids.is_null().to_numpy(zero_copy_only=False) | labels.is_null().to_numpy(zero_copy_only=False))
        ids, labels = ids.fill_null(0).to_numpy(), labels.fill_null(0).to_numpy()
        for rows, width in V.blocks(batch, np.flatnonzero(usable), lengths):
            rows = rows[np.argsort(ids[rows], kind="stable")]
            q = V.matrix(floor, rows, width, np.float64)
            if q.size and np.abs(q).max() > LARGEST:
                raise ValueError(f"a component times {scale} exceeds {LARGEST}")
            yield ids[rows], labels[rows], q.astype(np.int64)


def _picked(best: _Best, anchors: _Anchors, places: int) -> pa.RecordBatch:
    slot, score, ids = best.settled()
    columns = [pa.array(anchors.keys[slot // places]), pa.array((slot % places).astype(np.int32)), pa.array(score), pa.array(ids)]
    return pa.RecordBatch.from_arrays(columns, ["anchor", "place", "score", "vec_id"])


def _positives(block, least: np.ndarray, k: int):
    def run(batches):
        anchors, best = block.value, _Best(least, k)
        for ids, labels, q in _rows(batches, anchors.scale):
            for label in np.intersect1d(labels, anchors.labels):
                rows, own = labels == label, np.flatnonzero(anchors.labels == label)
                right = residues(q[rows], anchors.primes)
                for at in range(0, len(own), _TILE):
                    tile = own[at : at + _TILE]
                    found = scores([r[tile] for r in anchors.residues], right, anchors.primes)
                    best.take(tile, found, ids[rows] != anchors.ids[tile][:, None], ids[rows])
        yield _picked(best, anchors, 1)

    return run


def _negatives(block, least: np.ndarray, k: int):
    def run(batches):
        anchors, best = block.value, _Best(least, k)
        places = anchors.low.shape[1]
        for ids, labels, q in _rows(batches, anchors.scale):
            right = residues(q, anchors.primes)
            for at in range(0, len(anchors.keys), _TILE):
                tile = np.arange(at, min(at + _TILE, len(anchors.keys)))
                found = scores([r[tile] for r in anchors.residues], right, anchors.primes)
                other = labels != anchors.labels[tile][:, None]
                for j in range(places):
                    inside = other & (found >= anchors.low[tile, j, None]) & (found <= anchors.high[tile, j, None])
                    best.take(tile * places + j, found, inside, ids)
        yield _picked(best, anchors, places)

    return run


def _bounds(scale: int):
    """Rows, longest vector and largest squared norm of a partition."""

    def run(batches):
        n, width, norm = 0, 0, 0.0
        for ids, _, q in _rows(batches, scale):
            n, width = n + len(ids), max(width, q.shape[1])
            norm = max(norm, float((q.astype(np.float64) ** 2).sum(axis=1).max()))
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([width]), pa.array([norm])], ["n", "width", "norm"])

    return run


def _integers(scale: int):
    def run(batches):
        for ids, labels, q in _rows(batches, scale):
            offsets = pa.array(np.arange(len(ids) + 1, dtype=np.int32) * q.shape[1])
            columns = [pa.array(ids), pa.array(labels), pa.ListArray.from_arrays(offsets, pa.array(q.ravel()))]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "q"])

    return run


def _merged(rows: DataFrame, sample: DataFrame, finder: Callable, slots: int, places: int, keys: np.ndarray, k: int) -> DataFrame:
    """The best ``k`` of every anchor and place over all ``rows``; ``at`` counts from 0.

    ``sample`` is part of the rows: the k-th best of it is a threshold that the k-th best of all reaches.
    """
    by_key = Window.partitionBy("anchor", "place").orderBy(F.desc("score"), "vec_id")

    def best(source, least):
        return source.mapInArrow(finder(least), _PICKED).withColumn("at", F.row_number().over(by_key) - 1).where(F.col("at") < k)

    nothing = np.full(slots, _NONE)
    known = best(sample, nothing).where(F.col("at") == k - 1).select("anchor", "place", "score").toArrow()
    at = np.argsort(keys)[np.searchsorted(np.sort(keys), known.column("anchor").to_numpy())]
    nothing[at * places + known.column("place").to_numpy()] = known.column("score").to_numpy()
    return cut(best(rows, nothing))


def mined(
    vectors: DataFrame,
    is_anchor: Column,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
    scale: int = SCALE,
    block_anchors: int = BLOCK_ANCHORS,
) -> DataFrame:
    """Hard negatives for every anchor and positive of ``vectors`` (vec_id, label, embedding).

    Components become ``floor(scale * x)``; a score is the inner product with the anchor, vectors of different length
    are compared on the components that both have. Higher scores come first, ties by smaller vec_id. An anchor's
    positives are its best rows with its label and another vec_id; its negatives are the best rows of other labels whose
    score is ``low`` to ``high`` percent of the positive's. Fewer rows give fewer results, without a negative in the
    window there is no row.

    Rows with a NULL vec_id, label or vector, or a component that is NULL or not finite, take no part. Repeated rows
    count each, as anchors and as partners. An empty table or one without anchors gives no rows; other columns are
    ignored. Components beyond ``LARGEST`` or scores that might exceed 2^62 are an error.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding")
    chosen = vectors.where(is_anchor).select(*[F.col(c).cast(t).alias(c) for c, t in (("vec_id", "long"), ("label", "long"))], "embedding")
    anchors = cut(chosen.mapInArrow(_integers(scale), "vec_id long, label long, q array<long>").withColumn("anchor", F.monotonically_increasing_id()))
    size = rows.mapInArrow(_bounds(scale), "n long, width long, norm double").agg(F.max("width").alias("width"), F.max("norm").alias("norm")).first()
    count = anchors.count()
    if not count:
        return spark.createDataFrame([], _RESULT)
    width = max(1, size.width)
    primes = moduli(width, math.ceil(size.norm * (1 + 1e-9)))
    block_count = -(-count // max(1, min(block_anchors, BLOCK_BYTES // (8 * width))))
    out = None
    for b in range(block_count):
        local = anchors.where(F.pmod(F.xxhash64("anchor"), F.lit(block_count)) == b).toArrow()
        if not local.num_rows:
            continue
        block = _Anchors(local, primes, width, scale)
        keys, sent = block.keys, spark.sparkContext.broadcast(block)
        best = _merged(rows, chosen, lambda least, s=sent: _positives(s, least, positives), len(keys), 1, keys, positives)
        best = best.select("anchor", F.col("at").alias("place"), "score", "vec_id")
        block.set_windows(best.select("anchor", "place", "score").toArrow(), positives, low, high)
        sent = spark.sparkContext.broadcast(block)
        hard = _merged(rows, chosen, lambda least, s=sent: _negatives(s, least, negatives), len(keys) * positives, positives, keys, negatives)
        pairs = best.join(anchors.select("anchor", F.col("vec_id").alias("anchor_id")), "anchor")
        pairs = pairs.select("anchor", "place", "anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
        found = hard.select("anchor", "place", (F.col("at") + 1).cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
        named = pairs.join(found, ["anchor", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
        out = named if out is None else out.unionByName(named)
    return spark.createDataFrame([], _RESULT) if out is None else out
