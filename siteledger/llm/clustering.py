"""Centroid clustering of integer vectors, with Ptolemaic lower bounds from a few pivots.

Ptolemy's inequality holds for any four points of a Euclidean space: ``d(x,c) d(p,q) >= |d(x,p) d(c,q) - d(x,q) d(c,p)|``.
So the distances of a vector to fixed pivots, measured once and written beside it, bound its distance to any centroid
from below without touching its components, the centroids having theirs to the pivots. In every round

1. the bound of each centroid is the largest over the pivot pairs, rounded down by more than the arithmetic can err;
2. the centroid with the least bound is measured exactly, in integers;
3. only centroids whose bound doesn't exceed that distance are measured as well (equality stays in: ties go to the
   smaller number).

The rows stay where they are: a partition reports the sums of its clusters, which Spark adds up as decimals, so a
centroid is the exact floor of the mean. What reaches the driver is centroids and totals, whose number is a parameter.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteledger.llm import vectors as V
from siteledger.session import cut

CLUSTERS = 16
ROUNDS = 3
SCALE = 64
DIMENSIONS = 64
PIVOTS = 4
#: Largest magnitude of a component: squared distances of 64 such components still fit a long.
LARGEST = (1 << 27) - 1
#: Relative error allowed for; sums, products and roots of a bound err by less than 32 units of 2^-53.
SLACK = 2.0**-47
_RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def squared(rows: np.ndarray, centre: np.ndarray) -> np.ndarray:
    apart = rows - centre
    return np.einsum("ij,ij->i", apart, apart)


class Pivots:
    """Fixed pivots, far from one another, and the pairs among them that are apart."""

    def __init__(self, candidates: np.ndarray, most: int = PIVOTS):
        chosen = [0]
        nearest = squared(candidates, candidates[0])
        while len(chosen) < most and nearest.max() > 0:
            chosen.append(int(nearest.argmax()))
            nearest = np.minimum(nearest, squared(candidates, candidates[chosen[-1]]))
        self.points = candidates[chosen]
        apart = self.distances(self.points)
        self.pairs = [(i, j, apart[i, j]) for i in range(len(chosen)) for j in range(i)]

    def distances(self, rows: np.ndarray) -> np.ndarray:
        return np.sqrt(np.stack([squared(rows, p) for p in self.points], axis=1).astype(np.float64))

    def bounds(self, away: np.ndarray, centres_away: np.ndarray) -> np.ndarray:
        """Lower bounds of the squared distances between rows and centres, from their distances to the pivots."""
        least = np.zeros((len(away), len(centres_away)))
        for i, j, apart in self.pairs:
            one, two = away[:, i, None] * centres_away[:, j], away[:, j, None] * centres_away[:, i]
            np.maximum(least, (np.abs(one - two) - SLACK * (one + two)) / apart, out=least)
        return least * least * (1 - SLACK)


def nearest(rows: np.ndarray, away: np.ndarray, centres: np.ndarray, pivots: Pivots) -> tuple[np.ndarray, np.ndarray, int]:
    """Number of the nearest centre (ties: the smaller), squared distance to it, and how many distances were measured."""
    bounds = pivots.bounds(away, pivots.distances(centres))
    first = bounds.argmin(axis=1)
    cluster, best, measured = first.copy(), squared(rows, centres[first]), len(rows)
    for c, centre in enumerate(centres):
        left = np.flatnonzero((bounds[:, c] <= best) & (first != c))
        measured += len(left)
        found = squared(rows[left], centre)
        closer = (found < best[left]) | ((found == best[left]) & (c < cluster[left]))
        best[left[closer]], cluster[left[closer]] = found[closer], c
    return cluster, best, measured


def _quantise(scale: int, dimensions: int):
    def run(batches):
        for batch in batches:
            column = batch.column("embedding")
            usable, lengths, floor = V.quantised(column, scale)
            rows = np.flatnonzero(usable & (lengths == dimensions))
            q = V.matrix(floor, rows, dimensions, np.float64)
            if len(rows) and np.abs(q).max() > LARGEST:
                raise ValueError(f"a component times {scale} exceeds {LARGEST}: squared distances would not fit a long")
            offsets = np.arange(len(rows) + 1, dtype=np.int32) * dimensions
            kept = pa.ListArray.from_arrays(pa.array(offsets), pa.array(q.astype(np.int32).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(rows)), kept], ["vec_id", "q"])

    return run


def _blocks(batches, dimensions: int, pivots: int):
    """(ids, components, distances to the pivots) of the written rows."""
    for batch in batches:
        every = np.arange(batch.num_rows)
        for rows, _ in V.blocks(batch, every, np.full(batch.num_rows, dimensions)):
            yield batch.column("vec_id").take(pa.array(rows)), V.matrix(batch.column("q"), rows, dimensions), V.matrix(batch.column("away"), rows, pivots, np.float64)


def clusters(
    vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE, dimensions: int = DIMENSIONS, seed: int = 1
) -> DataFrame:
    """One row per vector of exactly ``dimensions`` components, none NULL or not finite; all other rows of ``vectors``
    (vec_id, embedding) are left out. Components become ``floor(scale * x)``.

    Centroids start as the vectors with the smallest sha256 of ``<seed>:<vec_id>`` (a NULL vec_id comes last, equal ids
    by their components); there are fewer if the table has fewer vectors. An empty centroid stays. Repeated rows count
    each; an empty table gives no rows; other columns are ignored. A magnitude beyond ``LARGEST`` is an error.
    """
    spark = vectors.sparkSession
    plain = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    whole = plain.mapInArrow(_quantise(scale, dimensions), "vec_id long, q array<int>")
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    start = whole.orderBy(name.asc_nulls_last(), "q").limit(clusters).select("q").collect()
    if not start:
        return spark.createDataFrame([], _RESULT)
    centres = np.array([r.q for r in start], np.int64)
    pivots = Pivots(centres)

    def measured(batches):
        for batch in batches:
            q = V.matrix(batch.column("q"), np.arange(batch.num_rows), dimensions)
            away = pivots.distances(q)
            offsets = pa.array(np.arange(len(q) + 1, dtype=np.int32) * away.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("q"), pa.ListArray.from_arrays(offsets, pa.array(away.ravel()))], ["vec_id", "q", "away"])

    cached = cut(whole.mapInArrow(measured, "vec_id long, q array<int>, away array<double>"))
    for _ in range(rounds):
        centres = _moved(cached, centres, pivots)
    assigned = cut(cached.mapInArrow(_assign(centres, pivots), "vec_id long, cluster int, distance long"))
    totals = assigned.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()
    every = sum(r.inertia for r in totals)
    named = [(r.cluster, r.inertia, every, hashlib.sha256(",".join(map(str, centres[r.cluster].tolist())).encode()).hexdigest()) for r in totals]
    facts = spark.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _assign(centres: np.ndarray, pivots: Pivots):
    def run(batches):
        for ids, q, away in _blocks(batches, centres.shape[1], len(pivots.points)):
            cluster, best, _ = nearest(q, away, centres, pivots)
            yield pa.RecordBatch.from_arrays([ids, pa.array(cluster, pa.int32()), pa.array(best, pa.int64())], ["vec_id", "cluster", "distance"])

    return run


def _moved(cached: DataFrame, centres: np.ndarray, pivots: Pivots) -> np.ndarray:
    """The centroids after a round."""

    def sums(batches):
        total, count = np.zeros(centres.shape, np.int64), np.zeros(len(centres), np.int64)
        for _, q, away in _blocks(batches, centres.shape[1], len(pivots.points)):
            cluster, _, _ = nearest(q, away, centres, pivots)
            count += np.bincount(cluster, minlength=len(centres))
            for c in np.unique(cluster):
                total[c] += q[cluster == c].sum(axis=0)
        held = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(count[held]), pa.array(total[held].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "total"])

    parts = cached.mapInArrow(sums, "cluster int, n long, total array<long>").select("cluster", "n", F.posexplode("total").alias("place", "x"))
    added = parts.groupBy("cluster", "place").agg(F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect()
    out = centres.copy()
    for r in added:
        out[r.cluster, r.place] = int(r.x) // r.n
    return out
