"""Mixing sources to target weights by Sainte-Laguë apportionment, in DataFrame operations only.

The mix is counted in blocks of ``block`` words. Sources get blocks by their highest quotients target / (2j + 1), then
each source's shards share its blocks the same way. Only the few quotients around the last seat are ranked: all above
``bound_low`` are sure to be seated, none below ``bound_high`` can be, so rows grow with the parties, not the seats.
Within a shard, documents lie end to end in seeded order, and seeded blocks are taken until the shard's quota is
reached; a quota above the shard's words takes every block once and goes round again. Shards are of bounded size, so
a source with a third of all words is work for many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteledger.session import cut

WEIGHTS = (3, 1, 2)
SHARE = 1.5
LIMIT = 2.0
BLOCK = 128
SHARD_WORDS = 1 << 17
SEED = 20240501
_WORD = "[^\\x20\\x09-\\x0D]+"
_SOURCE = ["absent", "name"]


def sizes(docs: DataFrame) -> DataFrame:
    """Words of each row, its source as (absent, name) so that NULL is a value, and a hash that breaks ties."""
    return docs.select(
        "doc_id",
        F.col("source").isNull().alias("absent"),
        F.coalesce("source", F.lit("")).alias("name"),
        F.coalesce(F.regexp_count("text", F.lit(_WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64("text").alias("tie"),
    )


def targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> DataFrame:
    """Source, source_size and target: shares by weight, none above ``limit`` times its size, the excess reshared.

    With sources in order of limit / weight, those before the level at which the rest fits are full. One row a source.
    """
    order = Window.orderBy(*_SOURCE)
    everything, by_ratio = Window.partitionBy(), Window.orderBy("ratio", *_SOURCE)
    before, rest = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1)
    return (
        sized.groupBy(*_SOURCE)
        .agg(F.sum("size").alias("source_size"))
        .withColumn("weight", weight)
        .withColumn("most", F.col("source_size") * limit)
        .withColumn("ratio", F.col("most") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(everything) * share)
        .withColumn("level", (F.col("total") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
        .withColumn("level", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(everything))
        .select(*_SOURCE, "source_size", F.least("most", F.coalesce(F.col("level") * F.col("weight"), "most")).alias("target"))
    )


def apportion(parties: DataFrame, within: list[str], key: list[str], votes: str, seats: Column, out: str) -> DataFrame:
    """``parties`` with their seats by Sainte-Laguë, apart for each value of ``within``; ties go by ``key``."""
    group = Window.partitionBy(*within)
    table = (
        parties.withColumn("_seats", seats.cast("long"))
        .withColumn("_votes", F.sum(F.col(votes).cast("double")).over(group))
        .withColumn("_n", F.count("*").over(group))
    )
    share = F.col(votes) / F.col("_votes")
    sure = F.greatest(F.lit(0), F.floor(share * (F.col("_seats") - F.col("_n") / 2) + 0.5 - 1e-9))
    most = F.ceil(share * (F.col("_seats") + F.col("_n") / 2) + 0.5 + 1e-9)
    table = table.withColumn("_sure", F.coalesce(sure, F.lit(0))).withColumn("_most", F.coalesce(most, F.lit(0)))
    table = table.withColumn("_open", F.col("_seats") - F.sum("_sure").over(group))
    tried = table.where("_most > _sure").withColumn("_j", F.explode(F.sequence(F.col("_sure"), F.col("_most") - 1)))
    ranked = tried.withColumn("_rank", F.row_number().over(group.orderBy((F.col(votes) / (2 * F.col("_j") + 1)).desc(), *key)))
    won = ranked.where(F.col("_rank") <= F.col("_open")).groupBy(*within, *key).agg(F.count("*").alias("_won"))
    keys = list(dict.fromkeys([*within, *key]))
    return table.join(won, keys, "left").select(*parties.columns, (F.col("_sure") + F.coalesce("_won", F.lit(0))).alias(out))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, limit: float = LIMIT, block: int = BLOCK, shard_words: int = SHARD_WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) for every row of ``docs`` (doc_id, text, source).

    A NULL or blank text has size 0 and is never taken; a NULL source is a source of its own, the last one. Equal rows
    are told apart by their place only. No document is taken more than ``limit`` times; an empty table gives no rows.
    Everything is ordered by seeded hashes, so reruns agree.
    """
    sized = cut(sizes(docs))
    by_source = targets(sized, weights, share, limit).withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words)))
    all_seats = F.round(F.sum("target").over(Window.partitionBy()) / block)
    seated = cut(apportion(by_source.withColumn("one", F.lit(0)), ["one"], _SOURCE, "target", all_seats, "blocks").drop("one"))
    dealt = sized.join(seated, _SOURCE).withColumn("shard", F.pmod(F.xxhash64("doc_id", "tie", F.lit(seed)), F.col("shards")))
    place = [*_SOURCE, "shard"]
    shards = dealt.groupBy(*place).agg(F.sum("size").alias("words"), F.first("blocks").alias("blocks"), F.first("target").alias("target"))
    quotas = apportion(shards, _SOURCE, ["shard"], "words", F.col("blocks"), "quota")
    largest = F.row_number().over(Window.partitionBy(*_SOURCE).orderBy(F.col("words").desc(), "shard")) == 1
    left_over = F.when(largest, F.col("target") - F.col("blocks") * block).otherwise(0.0)
    quotas = quotas.select(*place, "words", F.round(F.least(F.greatest(F.col("quota") * block + left_over, F.lit(0.0)), limit * F.col("words"))).cast("long").alias("quota"))
    line = Window.partitionBy(*place).orderBy(F.xxhash64("doc_id", F.lit(seed + 1)), "doc_id", "tie", "size")
    laid = (
        dealt.withColumn("seat", F.row_number().over(line))
        .withColumn("start", F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
        .join(quotas, place)
    )
    last = F.floor((F.col("start") + F.col("size") - 1) / block)
    blocks = laid.withColumn("block", F.explode_outer(F.when(F.col("size") > 0, F.sequence(F.floor(F.col("start") / block), last))))
    piece = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block) - F.greatest(F.col("start"), F.col("block") * block)
    drawn = Window.partitionBy(*place).orderBy(F.xxhash64("block", "shard", F.lit(seed + 2)), "block", "start", "seat")
    taken = (
        blocks.withColumn("piece", F.coalesce(piece, F.lit(0)))
        .withColumn("before", F.sum("piece").over(drawn.rowsBetween(Window.unboundedPreceding, 0)) - F.col("piece"))
        .withColumn("once", F.least(F.greatest(F.col("quota") - F.col("before"), F.lit(0)), F.col("piece")))
        .withColumn("again", F.least(F.greatest(F.col("quota") - F.col("words") - F.col("before"), F.lit(0)), F.col("piece")))
    )
    return (
        taken.groupBy(*place, "seat", "doc_id", "size", "source_size", "target")
        .agg(F.sum(F.col("once") + F.col("again")).alias("taken"))
        .select("doc_id", F.when(~F.col("absent"), F.col("name")).alias("source"), "size", "source_size", "target", "taken")
    )
