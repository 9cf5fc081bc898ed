"""Near-duplicate documents: an exact n-gram Jaccard join over a token-group matrix.

Tokens are the 64-bit fingerprints of word shingles. Two sets link when ``100 * |A & B| >= 80 * |A | B|``; then at least
80 % of either set is common. The steps, each exact:

1. Every chunk asks which of its tokens stand in another document. A document with less than 80 % such tokens has no
   partner, which settles all but copies. Equal sets become one class.
2. *Similar sets are put in groups*: four independent min-hashes bring most partners together, each class is compared
   with the most central class of its groups (a star, never all pairs), and linked classes form components. A token that
   stands in one component only can't lead to a new link; classes with too few other tokens are done.
3. Each open class is compared with the class of another component that is the centre of most of its tokens; what is
   linked becomes one component, and its tokens cross no more. This goes on until nothing links.
4. *Token-group matrix* over what is open then: components, cut into parts of about ``PART`` classes, are the groups, and
   each group's token union is stored. A query meets a group by tokens that are among the rarest of both (so many that
   partners must share one), ``|Q & union|`` bounds its overlap with every member, and only groups that reach 80 % of Q
   are opened and compared set by set. Groups of the query's own component stay closed: they are connected already.

Components come from alternating stars over the links, so neither links nor components pass through the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteledger.llm import chunks as C
from siteledger.llm.hashing import PLACE, mix, shingles
from siteledger.operators.components import connected_components
from siteledger.session import cut, release

WIDTH = 5
PERCENT = 80
PART = 64
#: Tokens that are a task's work: a stage over fewer than its shuffle has partitions for gets fewer tasks.
TASK = 1 << 17
#: Ids (8 bytes each) that may be broadcast.
MOST_BROADCAST = 1 << 20
_SETS = "doc_id long, n_shingles long, sig_a long, sig_b long, tokens array<long>, hashes array<long>"
_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("sig_a", pa.int64()), ("sig_b", pa.int64()), ("tokens", pa.list_(pa.int64())), ("hashes", pa.list_(pa.int64()))]
)


def _distinct(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct tokens of a chunk, ascending, which of them several sets have, and every token's place among them."""
    everything = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    tokens, place, counts = np.unique(everything, return_inverse=True, return_counts=True)
    return tokens, counts > 1, place


def _sets(docs: DataFrame) -> DataFrame:
    """Set size and signature of every document; tokens and min-hashes only where 80 % of the tokens occur elsewhere."""
    chunks = C.chunked(docs)
    shift = np.uint64(64 - chunks.bits - 32)

    def ask(rows, _):
        tokens, several, _ = _distinct(shingles(C.texts_of(rows)[1], WIDTH))
        return tokens, (((tokens >> shift) & np.uint64(0xFFFFFFFE)) | several.astype(np.uint64)).astype("<u4")

    def settle(records):
        _, inverse, counts = np.unique(records >> np.uint32(1), return_inverse=True, return_counts=True)
        several = np.bincount(inverse, weights=records & np.uint32(1), minlength=len(counts)) > 0
        return ((counts > 1) | several)[inverse].astype("u1")

    def finish(rows, told):
        sets = shingles(C.texts_of(rows)[1], WIDTH)
        _, _, place = _distinct(sets)
        shared = C.replies(told, 1, "u1")[place] if len(place) else np.empty(0, "u1")
        out: dict[str, list] = {k: [] for k in _ARROW.names[1:]}
        at = 0
        for tokens in sets:
            n = len(tokens)
            alive = n > 0 and 100 * int(shared[at : at + n].sum()) >= PERCENT * n
            at += n
            out["n_shingles"].append(n)
            out["sig_a"].append(int(mix(tokens).sum(dtype=np.uint64).view(np.int64)))
            out["sig_b"].append(int(mix(tokens ^ PLACE[7]).sum(dtype=np.uint64).view(np.int64)))
            out["tokens"].append(tokens.view(np.int64) if alive else None)
            out["hashes"].append([int(mix(tokens * PLACE[k]).min().view(np.int64)) for k in range(4)] if alive else None)
        return pa.table({"doc_id": rows.column("doc_id"), **{k: pa.array(v, _ARROW.field(k).type) for k, v in out.items()}}).cast(_ARROW)

    told = C.exchange(chunks, 1, ask, settle, np.dtype("<u4"))
    return C.with_answers(chunks, told, finish, _SETS)


def _tasks(classes: DataFrame) -> int:
    """How many tasks the tokens of ``classes`` are worth."""
    return max(8, (classes.agg(F.sum(F.size("tokens"))).first()[0] or 0) // TASK)


def _large(table: DataFrame) -> DataFrame:
    """``table``, which grows with the corpus, for joins that shuffle and sort whatever size they are planned with.

    A plan knows the bytes of files. Ids and tokens that many classes share take far less there than as rows, so a table
    that looks small enough would go through the driver as a broadcast many times that size.
    """
    return table.hint("merge")


def _verified(pairs: DataFrame, classes: DataFrame, tasks: int) -> DataFrame:
    """The pairs (src, dst) whose sets are alike; ``classes`` has (rep, n, tokens).

    ``tokens`` may leave out what no partner of another component has; a set has ``n`` tokens in all.
    """
    left = pairs.join(_large(classes.select(F.col("rep").alias("src"), F.col("n").alias("na"), F.col("tokens").alias("a"))), "src")
    both = left.coalesce(tasks).join(_large(classes.select(F.col("rep").alias("dst"), F.col("n").alias("nb"), F.col("tokens").alias("b"))), "dst")
    common = F.size(F.array_intersect("a", "b"))
    return both.where(100 * common >= PERCENT * (F.col("na") + F.col("nb") - common)).select("src", "dst")


def _commonness(classes: DataFrame, tasks: int) -> DataFrame:
    """(rep, common): how widespread the tokens of a class are on average, in thousandths of powers of two."""
    tokens = _large(classes.select("rep", F.size("tokens").alias("n"), F.explode("tokens").alias("token")))
    spread = tokens.groupBy("token").agg(F.floor(F.log2(F.count("*"))).alias("power"))
    sums = tokens.join(spread, "token").coalesce(tasks).groupBy("rep", "n").agg(F.sum("power").alias("power"))
    return sums.select("rep", F.floor(1000 * F.col("power") / F.col("n")).alias("common"))


def _stars(classes: DataFrame, tasks: int) -> DataFrame:
    """Links between each class and the centre of the groups it is in.

    The centre is the class with the most widespread tokens: copies with edits of their own are often too far from one
    another, but not from the text they were made of, which has no tokens of its own.
    """
    keys = classes.join(_commonness(classes, tasks), "rep").select("rep", "common", F.posexplode("hashes").alias("k", "hash"))
    keys = cut(keys.coalesce(tasks))
    centre = keys.groupBy("k", "hash").agg(F.max_by("rep", F.struct("common", F.bitwise_not("rep"))).alias("dst"))
    pairs = _large(keys).join(centre, ["k", "hash"]).where("rep != dst").select(F.col("rep").alias("src"), "dst").coalesce(tasks).distinct()
    links = cut(_verified(pairs.coalesce(tasks), classes.select("rep", F.size("tokens").alias("n"), "tokens"), tasks).coalesce(tasks))
    release(keys)
    return links


def _needed(n: str) -> Column:
    """The least number of common tokens that a set of ``n`` tokens has with a partner."""
    return F.ceil(F.lit(PERCENT) * F.col(n) / 100)


def _slots(records: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``records`` summed up by token, slot of components and class of sizes, and every record's place among the sums.

    A slot with several components stands for all of them: the least size, the largest reach.
    """
    sizes = np.floor(8 * np.log2(np.maximum(records["n"], 1))).astype(np.uint64)
    kind = sizes * np.uint64(16) + (mix(records["low"].view(np.uint64)) & np.uint64(15))
    order = np.lexsort((kind, records["token"]))
    ordered, kind = records[order], kind[order]
    new = np.ones(len(ordered), bool)
    new[1:] = (ordered["token"][1:] != ordered["token"][:-1]) | (kind[1:] != kind[:-1])
    at = np.flatnonzero(new)
    out = ordered[at]
    if len(at):
        for name, reduce in (("n", np.minimum), ("reach", np.maximum), ("low", np.minimum), ("high", np.maximum)):
            out[name] = reduce.reduceat(ordered[name], at)
    place = np.empty(len(records), np.int64)
    place[order] = np.cumsum(new) - 1
    return out, place


def _partners(records: np.ndarray) -> np.ndarray:
    """1 where the token of a record stands in another component, in a class that is within reach in both directions."""
    options, _ = _slots(records)
    begin = np.searchsorted(options["token"], records["token"], "left")
    end = np.searchsorted(options["token"], records["token"], "right")
    found = np.zeros(len(records), np.uint8)
    todo = np.arange(len(records))
    while len(todo):  # one option of every token at a time
        mine, other = records[todo], options[begin[todo]]
        near = (PERCENT * other["n"] <= mine["reach"]) & (PERCENT * mine["n"] <= other["reach"])
        near &= (other["low"] != mine["low"]) | (other["high"] != mine["high"]) | (mine["low"] != mine["high"])
        found[todo[near]] = 1
        begin[todo] += 1
        todo = todo[~near & (begin[todo] < end[todo])]
    return found


def _flat(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(tokens, sums, every token's place among the sums, number of tokens of each class) of a chunk of classes."""
    lists = rows.column("tokens").combine_chunks()
    tokens = lists.flatten().to_numpy(zero_copy_only=False)
    counts = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    comp, n = (rows.column(c).to_numpy() for c in ("comp", "n"))
    records = np.empty(len(tokens), _RECORD)
    records["token"] = tokens.view(np.uint64)
    records["n"], records["reach"] = np.repeat(n, counts), np.repeat((100 + PERCENT) * counts - PERCENT * n, counts)
    records["low"] = records["high"] = np.repeat(comp, counts)
    return tokens, *_slots(records), counts


_RECORD = np.dtype([("token", "<u8"), ("n", "<i8"), ("reach", "<i8"), ("low", "<i8"), ("high", "<i8")])


def _met(classes: DataFrame, tasks: int) -> DataFrame:
    """``classes`` (rep, comp, n, tokens) with the tokens that a class of another component within reach has.

    Tokens go through the chunk exchange: a chunk sends each once for a slot of components and class of sizes.
    """
    bits = max(1, (tasks - 1).bit_length())
    chunk = F.pmod(F.xxhash64("rep"), F.lit(tasks)).alias("chunk")
    plain = classes.select(chunk, F.col("rep").alias("doc_id"), F.lit(None).cast("binary").alias("text"), "comp", "n", "tokens")
    chunks = C.Chunks(plain, bits)

    def ask(rows, _):
        _, sums, _, _ = _flat(rows)
        return sums["token"], sums

    def finish(rows, told):
        tokens, _, place, counts = _flat(rows)
        usable = C.replies(told, 1, "u1")[place] > 0 if len(place) else np.empty(0, bool)
        ends = np.concatenate(([0], np.cumsum(counts)))
        left = np.diff(np.concatenate(([0], np.cumsum(usable)))[ends])
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(left))), pa.int32()), pa.array(tokens[usable], pa.int64()))
        out = pa.table({"rep": rows.column("doc_id"), "comp": rows.column("comp"), "n": rows.column("n"), "tokens": lists})
        return out.filter(pa.array(100 * left >= PERCENT * rows.column("n").to_numpy()))

    told = C.exchange(chunks, 1, ask, _partners, _RECORD, tasks=tasks)
    return cut(C.with_answers(chunks, told, finish, "rep long, comp long, n long, tokens array<long>").coalesce(tasks))


def _crossing(classes: DataFrame, tasks: int, rounds: int = 2) -> DataFrame:
    """Classes of (rep, comp, n, tokens) that may have a partner in another component: rep, comp, n, reach, cross.

    ``cross`` are the tokens that other components have. Common tokens I with a partner are among the ``cross`` of
    either, and a link needs ``180 I >= 80 (n + n of the partner)``; so ``reach = 180 |cross| - 80 n`` bounds 80 times the
    partner's size, in both directions. A token that no class within reach has in another component can't be common, so
    it goes, and classes left with under 80 % of their tokens go as well; what went shortens the reach of the next round.
    A passage that makes up most of many texts so costs nothing as long as the rest of these texts differs too much.
    """
    left = classes
    for k in range(rounds):
        before, left = left, _met(left, tasks)
        if k:
            release(before)
    crossing = left.withColumnRenamed("tokens", "cross").withColumn("reach", _reach())
    crossing.scratch = left.scratch
    return crossing


def _reach() -> Column:
    return (100 + PERCENT) * F.size("cross") - PERCENT * F.col("n")


def _centres(active: DataFrame, tasks: int) -> DataFrame:
    """(src, dst): each class and the centre, in another component, that it has most tokens in common with.

    The centre of a token is the class with the fewest tokens of its own, the most likely partner of all that have the
    token; a class of the centre's component gets the best class of another component in its place. One row per class
    and token before the count, one per class after it.
    """
    tokens = _large(active.select("rep", "comp", "n", F.explode("cross").alias("token"), F.struct((F.col("n") - F.size("cross")).alias("own"), "rep", "comp").alias("one")))
    first = tokens.groupBy("token").agg(F.min("one").alias("first"))
    marked = tokens.join(first, "token")
    second = marked.where("comp != first.comp").groupBy("token").agg(F.min("one").alias("second"))
    offered = _large(marked).join(second, "token")
    centre = F.when(F.col("comp") != F.col("first.comp"), F.col("first.rep")).otherwise(F.col("second.rep"))
    counts = offered.select("rep", "n", centre.alias("dst")).coalesce(tasks).groupBy("rep", "n", "dst").agg(F.count("*").alias("common"))
    best = counts.coalesce(tasks).groupBy("rep").agg(F.max_by("dst", F.struct("common", "dst")).alias("dst"))
    return best.select(F.col("rep").alias("src"), "dst").coalesce(tasks)


def _contracted(active: DataFrame, links: DataFrame, tasks: int) -> DataFrame:
    """``active`` with the components that ``links`` connect made one."""
    comp = active.select("rep", "comp")
    edges = links.join(comp.select(F.col("rep").alias("src"), F.col("comp").alias("a")), "src").join(comp.select(F.col("rep").alias("dst"), F.col("comp").alias("b")), "dst")
    merged = connected_components(edges.select(F.col("a").alias("src"), F.col("b").alias("dst")), tasks).withColumnRenamed("node", "comp")
    return active.join(merged, "comp", "left").select("rep", F.coalesce("component", "comp").alias("comp"), "n", F.col("cross").alias("tokens"))


def _opened(classes: DataFrame, tasks: int) -> DataFrame:
    """All links that connect classes (rep, comp, tokens) of different components.

    First rounds of centres: what they link becomes one component, whose tokens then cross no more. What is left, classes
    that hold tokens of others without a link to their centre, goes through the token-group matrix.
    """
    active = _crossing(classes.select("rep", "comp", F.size("tokens").cast("long").alias("n"), "tokens"), tasks, 3)
    found = None
    while True:
        tasks = _tasks(active.withColumnRenamed("cross", "tokens"))
        links = cut(_verified(_centres(active, tasks), active.withColumnRenamed("cross", "tokens"), tasks).coalesce(tasks))
        if links.isEmpty():
            break
        found = links if found is None else found.unionByName(links)
        before, active = active, _crossing(_contracted(active, links, tasks), tasks)
        release(before)
    last = cut(_matrix_links(active, tasks).coalesce(tasks))
    release(active)
    return last if found is None else found.unionByName(last)


def _matrix_links(active: DataFrame, tasks: int) -> DataFrame:
    """Links between classes of different components: a query meets groups by tokens that are among the rarest of both.

    Two sets of a link have the rarest of their common tokens among the first ``|cross| - needed + 1`` of either, in one
    order of all tokens; so a group shows those of its members to queries, and its union only to the bound. Classes of the
    smaller of two components are the queries.
    """
    sizes = active.groupBy("comp").agg(F.count("*").alias("members"))
    part = F.pmod(F.xxhash64("rep"), F.ceil(F.col("members") / PART))
    grouped = cut(_large(active).join(sizes, "comp").withColumn("part", part).coalesce(tasks))
    exploded = grouped.select("rep", "comp", "part", F.explode("cross").alias("token"))
    matrix = cut(exploded.select("comp", "part", "token").distinct().coalesce(tasks))
    rarity = matrix.groupBy("token").agg(F.count("*").alias("groups"))
    ranked = _large(exploded).join(rarity, "token").coalesce(tasks).groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("groups", "token"))).alias("order"))
    shown = F.slice("order", F.lit(1), (F.size("order") - _needed("n") + 1).cast("int"))
    probes = cut(
        _large(grouped).join(ranked, "rep")
        .select("rep", "comp", "part", "members", "n", "reach", F.explode(shown).alias("probe"))
        .select("rep", "comp", "part", "members", "n", "reach", F.col("probe.token").alias("token"))
        .coalesce(tasks)
    )
    groups = probes.groupBy(F.col("token").alias("held"), F.col("members").alias("of"), F.col("comp").alias("other"), F.col("part").alias("place")).agg(
        F.min("n").alias("least"), F.max("reach").alias("most")
    )
    smaller = F.struct("members", "comp") < F.struct(F.col("of").alias("members"), F.col("other").alias("comp"))
    near = (PERCENT * F.col("least") <= F.col("reach")) & (PERCENT * F.col("n") <= F.col("most"))
    met = _large(probes).join(groups, (F.col("token") == F.col("held")) & smaller & near).select("rep", "other", "place").coalesce(tasks).distinct()
    unions = matrix.groupBy(F.col("comp").alias("other"), F.col("part").alias("place")).agg(F.collect_list("token").alias("held"))
    bound = met.join(_large(active.select("rep", "n", "cross")), "rep").coalesce(tasks).join(_large(unions), ["other", "place"])
    open_ = bound.where(F.size(F.array_intersect("cross", "held")) >= _needed("n")).select("rep", "other", "place").coalesce(tasks)
    members = grouped.select(F.col("comp").alias("other"), F.col("part").alias("place"), F.col("rep").alias("dst"))
    pairs = open_.join(members, ["other", "place"]).select(F.col("rep").alias("src"), "dst")
    return _verified(pairs.coalesce(tasks), active.withColumnRenamed("cross", "tokens"), tasks)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs`` (doc_id, text); nothing is dropped or capped.

    A set holds the distinct shingles of ``WIDTH`` words (A-Z lower-cased), of fewer words the whole sequence; NULL or
    blank text has an empty set and no link. component_id is the smallest doc_id reachable by links. Rows of one doc_id
    are one node. A row without doc_id takes part in no link and has no component_id. Other columns are ignored.
    """
    whole = cut(_sets(docs.select("doc_id", "text")))
    signature = ["sig_a", "sig_b", "n_shingles"]
    full = cut(
        whole.where("tokens IS NOT NULL AND doc_id IS NOT NULL")
        .groupBy(*signature)
        .agg(F.min("doc_id").alias("rep"), F.first("tokens").alias("tokens"), F.first("hashes").alias("hashes"))
    )
    # Tokens are most of the bytes: they stay on disk only as long as they are read.
    sets = cut(whole.select("doc_id", *signature, (F.col("tokens").isNotNull() & F.col("doc_id").isNotNull()).alias("alive")))
    release(whole)
    alive = sets.where("alive")
    classes = cut(full.select(*signature, "rep"))
    # Rows of one doc_id with different texts are one node.
    twins = alive.join(classes, signature).where("doc_id != rep").select(F.col("doc_id").alias("src"), F.col("rep").alias("dst"))
    repeated = alive.groupBy("doc_id").agg(F.min("sig_a").alias("low"), F.max("sig_a").alias("high")).where("low != high").select(F.col("doc_id").alias("src"))
    twins = twins.join(repeated, "src", "left_semi")
    tasks = _tasks(full)
    stars = _stars(full, tasks)
    first = connected_components(stars, tasks).withColumnRenamed("node", "rep")
    placed = cut(full.join(_large(first), "rep", "left").select("rep", "tokens", F.coalesce("component", "rep").alias("comp")).coalesce(tasks))
    release(full)
    links = stars.unionByName(_opened(placed, tasks)).unionByName(twins)
    release(placed)
    final = connected_components(links, tasks)
    named = classes.withColumnRenamed("rep", "node").join(_large(final), "node", "left").select(*signature, F.coalesce("component", "node").alias("component_id"))
    found = alive.join(named, signature).select("doc_id", "n_shingles", "component_id")
    # A repeated doc_id belongs to one component, also for rows whose own text has no partner.
    rest = sets.where("NOT alive").select("doc_id", "n_shingles")
    same = repeated_ids(sets)
    moved = found.join(same, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    rest = rest.join(moved, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return found.unionByName(rest)


def representatives(docs: DataFrame, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """One row of ``docs``, with all its columns, for each component; rows without doc_id all stay.

    Ids that go are broadcast if there are at most ``most_broadcast``, so texts aren't shuffled again; else they are joined.
    """
    found = cut(near_duplicates(docs))
    gone = found.where("component_id != doc_id").select(F.col("doc_id").alias("gone")).distinct()
    side = F.broadcast(gone) if gone.count() <= most_broadcast else gone
    inner = ["doc_id" if c == "doc_id" else f"c{i}" for i, c in enumerate(docs.columns)]
    kept = docs.toDF(*inner).join(side, F.col("doc_id") == F.col("gone"), "left_anti")
    if not repeated_ids(found).isEmpty():
        kept = kept.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).union(kept.where("doc_id IS NULL"))
    return kept.toDF(*docs.columns)


def repeated_ids(sets: DataFrame) -> DataFrame:
    return sets.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
