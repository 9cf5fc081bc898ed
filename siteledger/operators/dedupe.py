"""Duplicate projects: same block, similar address, similar title.

1. Rows with equal block, address tokens and title tokens collapse to one representative (their
   scores are 100 by definition), so copies cost one aggregate.
2. Blocks of up to ``tile_rows`` representatives are compared in one bounded group each and give
   their components at once.
3. Larger blocks are first contracted by shared title parts long enough to prove similarity (a
   linear pass), then cut into tiles of bounded size. Tiles whose rows are already one component
   are never made; a tile gives spanning links only, and star contraction joins the tiles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteledger.functions.address import block_key, normalize_address
from siteledger.functions.similarity import FEW_PAIRS, Similar, few_links, tile_links, token_set, token_set_similarity
from siteledger.operators.components import connected_components
from siteledger.operators.joins import dealt
from siteledger.session import cut

ADDRESS_THRESHOLD = 92.0
TITLE_THRESHOLD = 72.0
TILE_ROWS = 1024
NEIGHBOUR_ROWS = 4096


def prepare(records: DataFrame, block: Column | None = None) -> DataFrame:
    """Block, token sets and copy digest of every record that can have a duplicate.

    ``records``: id, description, address, has_company, first_seen. ``block`` replaces the
    default blocking key.
    """
    staged = records.select(
        "id",
        normalize_address(F.col("address")).alias("_norm"),
        F.coalesce("description", F.lit("")).alias("_title"),
        F.struct(
            F.when(F.col("has_company"), 0).otherwise(1).alias("no_company"),
            F.coalesce(F.nullif(F.col("first_seen").cast("string"), F.lit("")), F.lit("9999")).alias("first_seen"),
            F.col("id").alias("id"),
        ).alias("_rank"),
        *([block.alias("block")] if block is not None else []),
    )
    if block is None:
        staged = staged.withColumn("block", block_key(F.col("_norm")))
    sets = staged.select(
        "id", "block", "_rank", token_set(F.col("_norm")).alias("address"), token_set(F.col("_title")).alias("title")
    ).where((F.length("block") > 0) & (F.length("address") > 0) & (F.length("title") > 0))
    return sets.withColumn("node", F.md5(F.concat_ws("\u0001", "block", "address", "title")))


def _representatives(prepared: DataFrame) -> DataFrame:
    return prepared.groupBy("node").agg(
        F.first("block").alias("block"),
        F.first("address").alias("address"),
        F.first("title").alias("title"),
        F.min("_rank").alias("best"),
        F.count("*").alias("copies"),
    )


def _block_components(reps: DataFrame, address_threshold: float, title_threshold: float) -> DataFrame:
    """Components of blocks that fit one row; blocks go to Python by the batch."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        same_place, same_title = Similar(address_threshold), Similar(title_threshold)
        for batch in batches:
            linked: list[str] = []
            components: list[str] = []
            for members in batch.column(0).to_pylist():
                nodes = [m["node"] for m in members]
                addresses, titles = [m["address"] for m in members], [m["title"] for m in members]
                if len(nodes) ** 2 <= FEW_PAIRS:
                    every = list(range(len(nodes)))
                    links = few_links(addresses, titles, nodes, every, every, same_place, same_title)
                else:
                    rows = np.arange(len(nodes))
                    links = tile_links(addresses, titles, nodes, rows, rows, address_threshold, title_threshold)
                root = {i: i for pair in links for i in pair}

                def find(i: int) -> int:
                    while root[i] != i:
                        i = root[i]
                    return i

                for i, j in links:
                    a, b = find(i), find(j)
                    root[max(a, b)] = min(a, b)
                linked += [nodes[i] for i in root]
                components += [nodes[find(i)] for i in root]
            yield pa.RecordBatch.from_arrays([pa.array(linked, pa.string()), pa.array(components, pa.string())], ["node", "component"])

    members = F.array_sort(F.collect_list(F.struct("node", "address", "title"))).alias("members")
    blocks = dealt(reps, "block").groupBy("block").agg(members).where(F.size("members") > 1)
    return blocks.select("members").mapInArrow(compare, "node string, component string")


def _hub_links(reps: DataFrame, title_threshold: float) -> DataFrame:
    """Links between representatives of one address that share a title part.

    A part of joined length q proves a score of at least t for every pair of titles that contain it
    if the length L of one of them satisfies q >= L * t / (200 - t). Parts tried: the whole title, the
    title without its numbered words, and (short titles) without any one word. Where no title is short
    enough, neighbours by the word left out are scored instead.
    """
    tokens = F.split("title", " ")
    share = title_threshold / (200.0 - title_threshold)

    def part(text: Column, word: Column) -> Column:
        return F.struct(text.alias("text"), word.alias("word"))

    parts = F.concat(
        F.array(part(F.col("title"), F.lit("")), part(F.array_join(F.filter(tokens, lambda t: ~t.rlike("[0-9]")), " "), F.lit(""))),
        F.when(
            F.size(tokens) <= 16,
            F.transform(tokens, lambda drop: part(F.array_join(F.filter(tokens, lambda t: t != drop), " "), drop)),
        ).otherwise(F.array().cast("array<struct<text:string,word:string>>")),
    )
    keyed = (
        reps.select("node", "block", "address", "title", F.explode(F.array_distinct(parts)).alias("p"))
        .where(F.length("p.text") > 0)
        .select(
            "node",
            "block",
            "title",
            F.col("p.word").alias("word"),
            F.md5(F.concat_ws("\u0001", "address", "p.text")).alias("hub"),
            (F.length("p.text") < F.length("title") * F.lit(share) + 1e-6).alias("open"),
        )
        .where("NOT open OR word <> ''")
    )
    hubs = keyed.groupBy("block", "hub").agg(F.min(F.struct("open", "node")).alias("first"), F.count("*").alias("n")).where("n > 1")
    linked = keyed.drop("open").join(hubs, ["block", "hub"])
    proved = linked.where("NOT first.open AND node != first.node").select(F.col("node").alias("src"), F.col("first.node").alias("dst"))
    # Groups of any size are cut into windows of about NEIGHBOUR_ROWS rows.
    salt = F.pmod(F.xxhash64("word"), F.ceil(F.col("n") / NEIGHBOUR_ROWS))
    order = Window.partitionBy("block", "hub", "salt").orderBy("word", "node")
    apart = linked.where("first.open").withColumn("salt", salt)
    near = apart.select("node", "title", *[F.lag(F.struct("node", "title"), k).over(order).alias(f"near{k}") for k in (1, 2)])
    pairs = near.select("node", "title", F.explode(F.array_compact(F.array("near1", "near2"))).alias("near"))
    scored = pairs.where(token_set_similarity(F.col("title"), F.col("near.title")) >= title_threshold)
    return proved.unionByName(scored.select(F.col("node").alias("src"), F.col("near.node").alias("dst")))


def _chunks(reps: DataFrame, tile_rows: int) -> DataFrame:
    """Give every representative of a large block a chunk of about ``tile_rows`` rows.

    A large component gets chunks of its own (``owner``); the rest of the block shares chunks.
    """
    sizes = reps.groupBy("block", "label").agg(F.count("*").alias("n"))
    own = sizes.where(F.col("n") * 4 > tile_rows).select(
        "block", "label", F.ceil(F.col("n") / tile_rows).cast("int").alias("own_chunks")
    )
    rest = (
        sizes.where(F.col("n") * 4 <= tile_rows)
        .groupBy("block")
        .agg(F.ceil(F.sum("n") / tile_rows).cast("int").alias("shared_chunks"))
    )
    placed = reps.join(own, ["block", "label"], "left").join(rest, "block", "left")
    owned = F.col("own_chunks").isNotNull()
    return placed.select(
        "node",
        "block",
        "address",
        "title",
        "label",
        F.when(owned, F.col("label")).otherwise(F.lit("")).alias("owner"),
        F.when(owned, F.pmod(F.xxhash64("node"), F.col("own_chunks")))
        .otherwise(F.pmod(F.xxhash64("label"), F.col("shared_chunks")))
        .cast("int")
        .alias("chunk"),
    )


def _tiles(chunked: DataFrame) -> DataFrame:
    """Pairs of chunks that may still hold new links: never two chunks of one component."""
    groups = chunked.groupBy("block", "owner").agg((F.max("chunk") + 1).alias("k"))
    shared = groups.where("owner = ''")
    inner = shared.select("block", "owner", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("ca"), "k").select(
        "block",
        F.col("owner").alias("oa"),
        "ca",
        F.col("owner").alias("ob"),
        F.explode(F.sequence(F.col("ca"), F.col("k") - 1)).alias("cb"),
    )
    a = groups.select("block", F.col("owner").alias("oa"), F.col("k").alias("ka"))
    b = groups.select("block", F.col("owner").alias("ob"), F.col("k").alias("kb"))
    outer = (
        a.join(b, "block")
        .where("oa < ob")
        .select("block", "oa", F.explode(F.sequence(F.lit(0), F.col("ka") - 1)).alias("ca"), "ob", "kb")
        .select("block", "oa", "ca", "ob", F.explode(F.sequence(F.lit(0), F.col("kb") - 1)).alias("cb"))
    )
    return inner.unionByName(outer)


def _tile_links(chunked: DataFrame, address_threshold: float, title_threshold: float) -> DataFrame:
    tiles = _tiles(chunked).withColumn("tile", F.md5(F.concat_ws("\u0001", "block", "oa", "ca", "ob", "cb")))
    same = (F.col("oa") == F.col("ob")) & (F.col("ca") == F.col("cb"))
    sides = F.when(
        same, F.array(F.struct(F.lit(2).alias("side"), F.col("oa").alias("owner"), F.col("ca").alias("chunk")))
    ).otherwise(
        F.array(
            F.struct(F.lit(0).alias("side"), F.col("oa").alias("owner"), F.col("ca").alias("chunk")),
            F.struct(F.lit(1).alias("side"), F.col("ob").alias("owner"), F.col("cb").alias("chunk")),
        )
    )
    routed = tiles.select("block", "tile", F.explode(sides).alias("s")).select("block", "tile", "s.*")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node", ignore_index=True)
        side = pdf["side"].to_numpy()
        nodes = pdf["node"].tolist()
        links = tile_links(
            pdf["address"].tolist(),
            pdf["title"].tolist(),
            pdf["label"].tolist(),
            np.flatnonzero(side != 1),
            np.flatnonzero(side != 0),
            address_threshold,
            title_threshold,
        )
        return pd.DataFrame({"src": [nodes[i] for i, _ in links], "dst": [nodes[j] for _, j in links]}, dtype=object)

    rows = chunked.join(routed, ["block", "owner", "chunk"])
    wanted = rows.select("tile", "side", "node", "address", "title", "label")
    return dealt(wanted, "tile").groupBy("tile").applyInPandas(compare, "src string, dst string")


def _large_components(reps: DataFrame, address_threshold: float, title_threshold: float, tile_rows: int) -> DataFrame:
    hubs = cut(_hub_links(reps, title_threshold))
    known = connected_components(hubs).withColumnRenamed("component", "label")
    labelled = reps.join(known, "node", "left").withColumn("label", F.coalesce("label", "node"))
    chunked = cut(_chunks(labelled, tile_rows))
    links = _tile_links(chunked, address_threshold, title_threshold)
    return connected_components(hubs.unionByName(links))


def duplicate_plan(
    records: DataFrame,
    address_threshold: float = ADDRESS_THRESHOLD,
    title_threshold: float = TITLE_THRESHOLD,
    block: Column | None = None,
    tile_rows: int = TILE_ROWS,
) -> DataFrame:
    """(id, canonical_id) of every record that is a duplicate of another.

    The canonical record of a component has a company, else was seen first, else has the lowest id.
    """
    return plan_of(cut(prepare(records, block)), address_threshold, title_threshold, tile_rows)


def plan_of(
    prepared: DataFrame,
    address_threshold: float = ADDRESS_THRESHOLD,
    title_threshold: float = TITLE_THRESHOLD,
    tile_rows: int = TILE_ROWS,
) -> DataFrame:
    """The plan of records that went through ``prepare`` (a written table: it is read several times)."""
    reps = cut(_representatives(prepared))
    crowded = cut(reps.groupBy("block").agg(F.count("*").alias("n")).where(F.col("n") > tile_rows).select("block"))
    compared = reps.select("block", "node", "address", "title")
    if crowded.isEmpty():
        components = _block_components(compared, address_threshold, title_threshold)
    else:
        components = _block_components(compared.join(crowded, "block", "left_anti"), address_threshold, title_threshold)
        large = cut(compared.join(crowded, "block", "left_semi"))
        components = components.unionByName(_large_components(large, address_threshold, title_threshold, tile_rows))
    grouped = reps.select("node", "best", "copies").join(components, "node", "left")
    grouped = grouped.where("component is not null or copies > 1").withColumn(
        "component", F.coalesce("component", "node")
    )
    grouped = cut(grouped)
    canonical = grouped.groupBy("component").agg(F.min("best")["id"].alias("canonical_id"))
    targets = grouped.select("node", "component").join(canonical, "component")
    members = prepared.select("id", "node")
    pairs = members.join(targets.select("node", "canonical_id"), "node")
    return pairs.where("id != canonical_id").select("id", "canonical_id")


def duplicate_stats(records: DataFrame, plan: DataFrame) -> DataFrame:
    """Scanned records, duplicates and groups, as one row."""
    scanned = records.select(F.lit(1).alias("scanned"), F.lit(None).cast("string").alias("canonical"))
    found = plan.select(F.lit(0).alias("scanned"), F.col("canonical_id").cast("string").alias("canonical"))
    return scanned.unionByName(found).agg(
        F.sum("scanned").alias("projects"),
        F.count("canonical").alias("duplicates"),
        F.count_distinct("canonical").alias("duplicate_groups"),
    )


def mark_duplicates(projects: DataFrame, plan: DataFrame, key: str = "id") -> DataFrame:
    """Recompute ``duplicate_of`` from scratch; running it again changes nothing."""
    marks = plan.select(F.col("id").alias(key), F.col("canonical_id").alias("duplicate_of"))
    return projects.drop("duplicate_of").join(marks, key, "left")


def is_duplicate(
    address_a: Column,
    title_a: Column,
    address_b: Column,
    title_b: Column,
    address_threshold: float = ADDRESS_THRESHOLD,
    title_threshold: float = TITLE_THRESHOLD,
) -> Column:
    """The pair rule on its own, for given pairs."""
    a, b = normalize_address(address_a), normalize_address(address_b)
    named = (F.length(a) > 0) & (F.length(b) > 0)
    return (
        named
        & (token_set_similarity(a, b) >= address_threshold)
        & (token_set_similarity(title_a, title_b) >= title_threshold)
    )
