"""Connected components by alternating star contraction, all in joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteledger.session import cut, release

#: Edges that are a task's work: a few edges need not go through as many tasks as a shuffle has partitions.
EDGES = 50_000


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    linked = both.join(least, "u")
    return linked.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, is linked to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    linked = edges.join(least, "u")
    down = linked.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return down.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, tasks: int | None = None) -> DataFrame:
    """(node, component) of every node in ``edges`` (src, dst); the component is its smallest node.

    The number of rounds grows with the logarithm of the longest chain. One summary row per round
    reaches the driver. Edges that are known to be few are first written in ``tasks``.
    """
    ordered = edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
    distinct = ordered.where("u != v").distinct()
    current = cut(distinct if tasks is None else distinct.coalesce(tasks))
    seen = None
    while True:
        summary = current.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 31)))).first()
        if summary == seen or summary[0] == 0:
            break
        seen = summary
        tasks = max(8, summary[0] // EDGES)
        before, current = current, cut(_small_star(_large_star(current).coalesce(tasks)).coalesce(tasks))
        release(before)
    roots = current.select(F.col("v").alias("node")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )
