"""Which pages of a crawl can be wanted: a Bloom filter of addresses, tested beside the scan.

A crawl is large in bytes (html), so it must not be shuffled to meet the list of wanted addresses, however long that
is. The filter is one row with an array of bits, built by aggregates and broadcast: ``BITS_PER_KEY`` bits an address,
16 MB at most. Beyond that more pages pass than are wanted; they are dropped by a join after parsing, so the filter
decides cost, never results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HASHES = 4
BITS_PER_KEY = 16
MOST_BITS = 1 << 27


def _places(address: Column, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(k), address), F.lit(bits)) for k in range(HASHES)]


def address_filter(addresses: DataFrame, most_bits: int = MOST_BITS) -> tuple[DataFrame, int]:
    """(one row ``words``, number of bits) for ``addresses`` (page_url)."""
    spark = addresses.sparkSession
    bits = min(most_bits, max(1 << 10, 1 << (addresses.count() * BITS_PER_KEY).bit_length()))
    places = addresses.select(F.explode(F.array(*_places(F.col("page_url"), bits))).alias("place"))
    words = places.groupBy(F.shiftright("place", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, CAST(place & 63 AS INT))")).alias("mask")
    )
    every = spark.range(bits // 64).join(words, F.col("id") == F.col("word"), "left")
    entry = F.struct("id", F.coalesce("mask", F.lit(0).cast("long")).alias("mask"))
    return every.agg(F.array_sort(F.collect_list(entry))["mask"].alias("words")), bits


def possibly_wanted(pages: DataFrame, addresses: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """The rows of ``pages`` (page_url and more) whose address may be one of ``addresses``; rows stay where they are."""
    words, bits = address_filter(addresses, most_bits)
    tests = [F.getbit(F.get("words", F.shiftright(p, 6).cast("int")), F.pmod(p, F.lit(64)).cast("int")) == 1 for p in _places(F.col("page_url"), bits)]
    condition = tests[0]
    for test in tests[1:]:
        condition = condition & test
    return pages.join(F.broadcast(words), condition).select(*pages.columns)
