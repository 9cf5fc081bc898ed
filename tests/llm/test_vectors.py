"""Hard negatives and clusters against brute force in Python integers, and odd rows."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siteledger.llm import clustering, hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int, q int, anchor string, `a.b` int"
NAN, INF = float("nan"), float("inf")


def table(spark, rows, parts=3):
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA).repartition(parts)


def rows_of(seed=3, n=420, width=64):
    """Vectors around a few centres, with ties, copies and rows that take no part."""
    rng = random.Random(seed)
    middles = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(6)]
    rows = []
    for i in range(n):
        v = [round(x + rng.gauss(0, 0.4), 3) for x in rng.choice(middles)]
        if rows and rng.random() < 0.2:
            v = rng.choice(rows)[1]
        rows.append((i, v, rng.randrange(4)))
    odd = [(1000, None, 1), (1001, [0.5] * 63 + [None], 1), (1100, [NAN] * width, 2), (1101, [INF] * width, 2), (1102, rows[0][1], None)]
    return rows + odd + [(None, rows[1][1], 1), (1200, [0.0] * width, 3), (1300, [-x for x in rows[0][1]], rows[0][2]), rows[5], rows[100], (1201, [], 1), (1202, [0.5] * 80, 2)]


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def whole(v, scale):
    return [math.floor(scale * float(np.float32(x))) for x in v]


def brute_negatives(rows, places, k):
    kept = [(i, whole(v, 256), y) for i, v, y in rows if i is not None and y is not None and usable(v)]
    out = []
    for a, q, y in kept:
        if a % 100:
            continue
        scored = sorted((-sum(x * z for x, z in zip(q, p, strict=False)), i, z) for i, p, z in kept if i != a)
        for minus, i, z in [s for s in scored if s[2] == y][:places]:
            window = [(j, -s) for s, j, w in scored if w != y and 30 * -minus <= 100 * -s <= 90 * -minus]
            out += [(a, i, at + 1, j, -minus, s) for at, (j, s) in enumerate(window[:k])]
    return sorted(out)


@pytest.mark.parametrize("block", [1, 1 << 14])
def test_hard_negatives(spark, block):
    rows = rows_of()
    got = hard_negatives.mined(table(spark, rows), F.col("vec_id") % 100 == 0, block_anchors=3 if block == 1 else block)
    assert sorted(map(tuple, got.collect())) == brute_negatives(rows, 5, 10)


def test_few_positives_and_no_rows(spark):
    rows = [(0, [1.0, 0.5], 1), (1, [1.0, 0.25], 1), (2, [0.5, 0.5], 2), (3, [0.5, 0.5], 2), (4, [-1.0, 0.0], 2), (100, [0.0, 0.0], 3), (5, [9.0], 1)]
    got = hard_negatives.mined(table(spark, rows), F.col("vec_id") % 100 == 0, negatives=1)
    assert sorted(map(tuple, got.collect())) == brute_negatives(rows, 5, 1)
    for empty in ([], rows[1:5]):
        got = hard_negatives.mined(table(spark, empty, 1), F.col("vec_id") % 100 == 0)
        assert got.count() == 0 and got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def test_large_components(spark):
    rows = [(0, [2.0e6, -1.0e6, 3.0], 1), (1, [1.9e6, 1.0e6, 5.0], 1), (2, [1.0e6, 7.0, 0.1], 2), (3, [9.0e5, 0.3, -0.1], 2)]
    got = hard_negatives.mined(table(spark, rows), F.col("vec_id") % 100 == 0)
    assert sorted(map(tuple, got.collect())) == brute_negatives(rows, 5, 10)


@pytest.mark.parametrize(("width", "size"), [(1, 1 << 20), (64, 300), (700, 1 << 15), (5000, 90), (64, 1 << 27)])
def test_residue_scores_are_exact(width, size):
    rng = np.random.default_rng(width)
    a, b = rng.integers(-size, size, (17, width)), rng.integers(-size, size, (23, width))
    a[0], b[0] = -size, size
    primes = hard_negatives.moduli(width, width * size * size)
    assert math.prod(primes) > 2 * width * size * size
    got = hard_negatives.scores(hard_negatives.residues(a, primes), hard_negatives.residues(b, primes), primes)
    assert (got == a @ b.T).all()


def brute_clusters(rows, k=16, rounds=3):
    kept = [(i, whole(v, 64)) for i, v, _ in rows if usable(v) and len(v) == 64]
    name = lambda i: hashlib.sha256(f"1:{i}".encode()).hexdigest() if i is not None else "~"
    centres = [q for _, q in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:k]]
    far = lambda q, c: sum((x - y) ** 2 for x, y in zip(q, c, strict=True))
    for step in range(rounds + 1):
        found = [min((far(q, c), at) for at, c in enumerate(centres)) for _, q in kept]
        if step < rounds:
            for at in range(len(centres)):
                own = [q for (_, q), (_, c) in zip(kept, found, strict=True) if c == at]
                centres[at] = [sum(x) // len(own) for x in zip(*own, strict=True)] if own else centres[at]
    inertia = [sum(d for d, c in found if c == at) for at in range(len(centres))]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    out = [(i, c, d, inertia[c], sum(inertia), digest[c]) for (i, _), (d, c) in zip(kept, found, strict=True)]
    return sorted(out, key=str)


def test_clusters(spark):
    rows = rows_of(4)
    got = clustering.clusters(table(spark, rows)).collect()
    assert sorted(map(tuple, got), key=str) == brute_clusters(rows)


def test_clusters_of_few_rows(spark):
    one = [(i, [0.25 * (i // 2)] * 64, 1) for i in range(5)]
    assert sorted(map(tuple, clustering.clusters(table(spark, one)).collect()), key=str) == brute_clusters(one)
    same = [(i, [1.0] * 64, None) for i in range(40)]
    assert sorted(map(tuple, clustering.clusters(table(spark, same)).collect()), key=str) == brute_clusters(same)
    assert clustering.clusters(table(spark, [(1, [1.0], 1), (2, None, 1)], 1)).count() == 0
    assert clustering.clusters(table(spark, [], 1)).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_ptolemaic_bounds_hold_and_settle_most(spark):
    rng = np.random.default_rng(1)
    middles = rng.integers(-90, 90, (16, 64))
    rows = middles[rng.integers(0, 16, 3000)] + rng.integers(-9, 9, (3000, 64))
    pivots = clustering.Pivots(middles)
    bounds = pivots.bounds(pivots.distances(rows), pivots.distances(middles))
    exact = ((rows[:, None] - middles) ** 2).sum(axis=2)
    assert (bounds <= exact).all()
    cluster, best, measured = clustering.nearest(rows, pivots.distances(rows), middles, pivots)
    assert (cluster == exact.argmin(axis=1)).all() and (best == exact.min(axis=1)).all()
    assert measured < 0.5 * exact.size
