"""Shards of equal size that keep linked documents together: balanced label propagation.

Documents are linked when they are of one group (equal texts). Labels are shards. Linked documents start anywhere, in
equal numbers a shard; in every round, all in joins and aggregates,

1. each group counts its members by shard, and its fullest shards, as many as it needs to fit, are its homes;
2. a document outside the homes wants to move to one of them; what it gains is the number of neighbours it meets there;
3. *quotas*: documents that want to move from shard i to j against those from j to i change places freely, the rest share
   the room that is left in j; within a quota the largest gains go first, groups together;
4. moves within their quota are made, which cuts fewer links than before, and no shard exceeds its capacity.

It ends when no document wants to move or after ``rounds``. Documents without links have nothing to lose: they fill the shards up
at the end, so counts are at most one apart whatever the links are. A group never is a task: its members meet
only its counts (one row a group), and ranks come from counts of buckets (``ranks``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siteledger.llm.ranks import bucket_count, hashed, ranked
from siteledger.session import cut

SHARDS = 40
ROUNDS = 12
#: Bytes that a document takes besides its text.
OVERHEAD = 16


def equal_texts(text: str = "text") -> Column:
    """The group of a text: its 64-bit hash. NULL counts as empty."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def quotas(rows: int, shards: int) -> list[int]:
    """Rows of each shard, at most one apart."""
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def _homes(labels: DataFrame, quota: int, step: int) -> DataFrame:
    """(grp, homes): the fullest shards of each group with its counts there, as many as hold it; one row a group.

    Which of equally full shards it is changes with the round, so what finds no room in one may find some in the next.
    """
    counts = labels.groupBy("grp", "shard").agg(F.count("*").alias("n"))
    entry = F.struct((-F.col("n")).alias("less"), F.xxhash64(F.lit(step), "grp", "shard").alias("tie"), "shard")
    listed = counts.groupBy("grp").agg(F.sum("n").alias("total"), F.sort_array(F.collect_list(entry)).alias("all"))
    needed = F.ceil(F.col("total") / max(1, quota)).cast("int")
    if step >= 3:  # what stands in the way of a large group is there to stay: one more shard for the rest of it
        needed = needed + F.when(needed > 1, 1).otherwise(0)
    return listed.select("grp", F.slice("all", F.lit(1), needed).alias("homes"), F.map_from_arrays("all.shard", "all.less").alias("own"))


def _wishes(labels: DataFrame, quota: int, step: int) -> DataFrame:
    """``labels`` with the shard a document wants to move to (NULL: it stays) and the logarithm of its gain."""
    met = labels.join(_homes(labels, quota, step), "grp")
    home = F.element_at("homes", (F.pmod(F.xxhash64(F.lit(step), "mark"), F.size("homes")) + 1).cast("int"))
    away = ~F.array_contains("homes.shard", F.col("shard"))
    gain = F.element_at("own", F.col("shard")) - home["less"] + 1
    return met.select(
        *labels.columns, F.when(away, home["shard"]).alias("wanted"), F.when(away, F.floor(F.log2(F.greatest(gain, F.lit(1))))).cast("int").alias("level")
    )


def allowed(wishes: dict[tuple[int, int], int], room: list[int]) -> dict[tuple[int, int], int]:
    """How many of the documents that want to move from i to j may: as many as come back, and a share of the room in j.

    No shard takes more than it loses plus its room, whatever the wishes are.
    """
    out = {(i, j): min(n, wishes.get((j, i), 0)) for (i, j), n in wishes.items()}
    rest: dict[int, int] = {}
    for (i, j), n in wishes.items():
        rest[j] = rest.get(j, 0) + n - out[i, j]
    return {(i, j): took + (n - took if rest[j] <= room[j] else (n - took) * room[j] // rest[j]) for (i, j), n in wishes.items() for took in (out[i, j],)}


def _round(labels: DataFrame, capacity: list[int], step: int) -> tuple[DataFrame, int]:
    """Labels after a round, and how many documents wanted to move."""
    wished = cut(_wishes(labels, min(capacity), step))
    counted = wished.groupBy("shard", "wanted").agg(F.count("*").alias("n")).collect()  # shards x shards rows at most
    room = list(capacity)
    for r in counted:
        room[r.shard] -= r.n
    wishes = {(r.shard, r.wanted): r.n for r in counted if r.wanted is not None}
    may = allowed(wishes, room)
    if not sum(may.values()):
        return labels, sum(wishes.values())
    limits = labels.sparkSession.createDataFrame([(i, j, n) for (i, j), n in may.items()], "shard int, wanted int, most long")
    movers = wished.where("wanted IS NOT NULL")
    # Large gains first; a group's documents stand together, the largest groups in several buckets.
    bucket = (64 - F.col("level")) * 256 + hashed("grp", 16) * 16 + F.when(F.col("level") > 12, hashed("mark", 16, 1)).otherwise(0)
    order = ranked(movers, ["shard", "wanted"], bucket, [F.col("grp"), F.col("mark"), F.col("node")])
    moved = order.join(F.broadcast(limits), ["shard", "wanted"])
    shard = F.when(F.col("rank") < F.col("most"), F.col("wanted")).otherwise(F.col("shard")).alias("shard")
    now = [c for c in labels.columns if c != "shard"]
    after = moved.select(*now, shard).unionByName(wished.where("wanted IS NULL").select(*now, "shard"))
    return cut(after), sum(wishes.values())


def propagated(linked: DataFrame, capacity: list[int], count: int, rounds: int = ROUNDS) -> DataFrame:
    """``linked`` (node, mark, grp; none NULL, node unique; a written table of ``count`` rows) with a shard each."""
    shards = len(capacity)
    start = ranked(linked, [], hashed("mark", bucket_count(count), 2), [F.col("mark"), F.col("node")])
    labels = cut(start.select(*linked.columns, F.pmod("rank", F.lit(shards)).cast("int").alias("shard")))
    for step in range(rounds):
        labels, wishes = _round(labels, capacity, step)
        if not wishes:
            break
    return labels


def _filled(single: DataFrame, room: list[int], count: int) -> DataFrame:
    """Documents without links, dealt to the room that is left, which is as large as they are many."""
    ends, total = [], 0
    for n in room:
        total += n
        ends.append(total)
    order = ranked(single, [], hashed("mark", bucket_count(count), 3), [F.col("mark"), F.col("node")])
    shard = F.size(F.filter(F.array(*[F.lit(e).cast("long") for e in ends]), lambda e: e <= F.col("rank")))
    return order.select(*single.columns, shard.cast("int").alias("shard"))


def sharded(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS, group: Column | None = None) -> DataFrame:
    """A shard and a slot for every row of ``docs`` (doc_id, text): law ``rows``, counts of shards are at most one apart.

    doc_id, size (UTF-8 bytes of the text, plus ``OVERHEAD``), text_crc32, law, shard, slot (from 0 within the shard,
    without gaps) and grown_shard (NULL under this law). Rows of one ``group`` (equal texts if not given) are linked; a
    NULL group links nothing. NULL texts count as empty. Repeated rows and rows without doc_id are placed each. An empty
    table gives no rows; with fewer rows than shards some stay empty; other columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    size = (F.octet_length(text) + OVERHEAD).cast("long").alias("size")
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), size, F.crc32(text.cast("binary")).alias("text_crc32"), (equal_texts() if group is None else group).alias("grp"))
    # All choices hang on ``mark``, so another layout of the files gives the same shards; ``node`` tells equal rows apart.
    nodes = cut(plain.withColumns({"mark": F.xxhash64("doc_id", "grp"), "node": F.monotonically_increasing_id()}))
    copies = nodes.where("grp IS NOT NULL").groupBy("grp").agg(F.count("*").alias("copies")).where("copies > 1")
    marked = cut(nodes.join(copies, "grp", "left"))
    single, linked = marked.where("copies IS NULL").drop("copies"), marked.where("copies > 1").drop("copies")
    alone, together = single.count(), linked.count()
    capacity = quotas(alone + together, shards)
    labels = propagated(linked, capacity, together, rounds)
    room = list(capacity)
    for r in labels.groupBy("shard").count().collect():
        room[r.shard] -= r["count"]
    placed = cut(labels.unionByName(_filled(single, room, alone)))
    slots = ranked(placed, ["shard"], hashed("mark", bucket_count((alone + together) // shards, 8), 4), [F.col("mark"), F.col("node")], "slot")
    return slots.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def split_groups(placed: DataFrame) -> DataFrame:
    """(copies, parts) of each group of equal texts in a result of ``sharded``: how many shards it lies in."""
    return placed.groupBy("text_crc32", "size").agg(F.count("*").alias("copies"), F.count_distinct("shard").alias("parts"))


def write_shards(docs: DataFrame, placed: DataFrame, path: str) -> None:
    """Shard files of whole rows of ``docs``, in the order of their slots; doc_id has to be unique in both."""
    spark: SparkSession = docs.sparkSession
    inner = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*inner)
    key = inner[docs.columns.index("doc_id")]
    rows = plain.join(placed.select("doc_id", "shard", "slot"), plain[key] == F.col("doc_id"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    named = rows.repartition(parts, "shard").sortWithinPartitions("shard", "slot")
    named.select("shard", "slot", F.struct(*[F.col(i).alias(c) for i, c in zip(inner, docs.columns, strict=True)]).alias("row")).write.partitionBy("shard").parquet(path)
