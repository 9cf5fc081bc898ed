from __future__ import annotations

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from siteledger.functions.similarity import token_set_score
from siteledger.operators import dedupe as D
from siteledger.operators import dedupe_state as S
from siteledger.operators.components import connected_components
from siteledger.session import scratch_path

SCHEMA = "id bigint, description string, address string, has_company boolean, first_seen string"


def plan_of(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA)
    return {r["id"]: r["canonical_id"] for r in D.duplicate_plan(df, **options).collect()}


def brute_force(spark, rows, address_threshold=92, title_threshold=72):
    """All pairs of a block, straight from the definition, with a plain union-find."""
    df = spark.createDataFrame(rows, SCHEMA)
    from siteledger.functions.address import block_key, normalize_address

    norm = normalize_address(F.col("address"))
    base = [r.asDict() for r in df.select("*", norm.alias("n"), block_key(norm).alias("b")).collect()]
    root = {r["id"]: r["id"] for r in base}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, p in enumerate(base):
        for q in base[i + 1:]:
            if p["b"] and p["b"] == q["b"] and token_set_score(p["n"], q["n"]) >= address_threshold:
                if token_set_score(p["description"], q["description"]) >= title_threshold:
                    root[find(p["id"])] = find(q["id"])
    groups = {}
    for r in base:
        groups.setdefault(find(r["id"]), []).append(r)
    plan = {}
    for members in groups.values():
        best = min(members, key=lambda r: (not r["has_company"], r["first_seen"] or "9999", r["id"]))
        plan.update({r["id"]: best["id"] for r in members if r is not best})
    return plan


def record(i, title, address, company=False, seen="2026-01-01"):
    return (i, title, address, company, seen)


def test_published_cases(spark):
    rows = [
        record(1, "Reroof single family residence", "123 Oak Ave"),
        record(2, "Re-roof single family residence", "123 Oak Avenue", True, "2026-02-01"),
        record(3, "Reroof single family residence", "987 Elm Ave"),
        record(4, "Solar panel installation on roof", "77 Pine St"),
        record(5, "Demolish detached garage structure", "77 Pine Street"),
        record(6, "Tenant improvement", "500 Market St Suite 200"),
        record(7, "Tenant improvement", "500 Market St Suite 450"),
        record(8, "Same title", None),
        record(9, "Same title", None),
        record(10, "Reroof single family residence", "123 Oak Avenue #1"),
        record(11, "  ", "5 Blank Rd"),
        record(12, "  ", "5 Blank Rd"),
    ]
    assert plan_of(spark, rows) == {1: 2, 10: 2}
    assert plan_of(spark, rows) == brute_force(spark, rows)


def random_rows(n, seed):
    rng = random.Random(seed)
    words = ["roof", "re-roof", "kitchen", "kitchens", "bath", "new", "unit", "solar", "solr", "pv", "deck", "demo", "wall"]
    rows = []
    for i in range(n):
        title = " ".join(rng.choices(words, k=rng.randint(0, 4))) + rng.choice(["", " #%d" % rng.randint(1, 40)])
        address = rng.choice(["12 Oak Ave", "12 Oak Avenue", "12 Oakland Road", "San Jose, California", "San Mateo", "12 Oak Ave #3", ""])
        rows.append(record(i, title, address, rng.random() < 0.3, rng.choice(["", "2026-01-0%d" % rng.randint(1, 9)])))
    return rows


@pytest.mark.parametrize("tile_rows", [1024, 16])
def test_equals_brute_force(spark, tile_rows):
    """One group per block, and the hub + tile + star path, against all pairs."""
    rows = random_rows(260, 11)
    assert plan_of(spark, rows, tile_rows=tile_rows) == brute_force(spark, rows)


def test_crowded_block_and_copies(spark):
    """A third of all rows are copies, another third near copies of one title at one address."""
    rows = [record(i, "kitchen remodel first floor", "1 Main St") for i in range(60)]
    rows += [record(100 + i, f"kitchen remodel first floor lot {i}", "1 Main St") for i in range(60)]
    rows += [record(300 + i, f"{w} {w}s", "1 Main St") for i, w in enumerate("abcdefghijklmnop")]
    plan = plan_of(spark, rows, tile_rows=8)
    assert plan == brute_force(spark, rows)
    assert len(plan) >= 119


def test_order_does_not_matter_and_marks_repeat(spark):
    rows = random_rows(120, 5)
    shuffled = rows[:]
    random.Random(3).shuffle(shuffled)
    plan = plan_of(spark, rows)
    assert plan == plan_of(spark, shuffled)
    assert not set(plan.values()) & set(plan)
    projects = spark.createDataFrame(rows, SCHEMA).select("id")
    frame = spark.createDataFrame(list(plan.items()), "id bigint, canonical_id bigint")
    once = D.mark_duplicates(projects, frame)
    twice = D.mark_duplicates(once, frame)
    assert {tuple(r) for r in once.collect()} == {tuple(r) for r in twice.collect()}


def test_pair_rule(spark):
    df = spark.createDataFrame(
        [("123 Oak Ave", "Reroof house", "123 Oak Avenue", "Re-roof house", True), ("", "a", "", "a", False)],
        "aa string, at string, ba string, bt string, want boolean",
    )
    got = df.select("want", D.is_duplicate(F.col("aa"), F.col("at"), F.col("ba"), F.col("bt")).alias("got")).collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]


def test_components(spark):
    rng = random.Random(1)
    edges = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(0, 40)]
    edges += [(f"m{rng.randint(0, 60):03d}", f"m{rng.randint(0, 60):03d}") for _ in range(40)]
    rng.shuffle(edges)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src string, dst string")).collect()}
    root = {n: n for e in edges for n in e}
    for _ in range(100):
        for a, b in edges:
            low = min(root[a], root[b])
            root[a] = root[b] = low
    linked = {n for a, b in edges if a != b for n in (a, b)}
    assert got == {n: r for n, r in root.items() if n in linked}


def delivered(spark, root, rows, **options):
    S.deliver(spark.createDataFrame(rows, SCHEMA), root, buckets=8, **options)
    return {r["id"]: r["canonical_id"] for r in S.current_plan(spark, root).collect()}


def test_deliveries_equal_the_full_plan(spark):
    root, rng = scratch_path(spark, "state"), random.Random(8)
    rows = random_rows(60, 11)
    now = {r[0]: r for r in rows[:30]}
    assert delivered(spark, root, rows[:30]) == brute_force(spark, rows[:30])
    # New records, changed ones (other block, other title, no address any more), and a delivery that comes twice.
    changed = [record(i, now[i][1], rng.choice(["12 Oak Ave", "77 Pine St", None])) for i in rng.sample(sorted(now), 8)]
    second = rows[30:50] + changed
    now |= {r[0]: r for r in second}
    for _ in range(2):
        assert delivered(spark, root, second) == brute_force(spark, list(now.values()))
    third = rows[50:] + [record(rows[31][0], "", "12 Oak Ave")]
    now |= {r[0]: r for r in third}
    assert delivered(spark, root, third) == brute_force(spark, list(now.values()))


def test_delivery_reads_touched_folders_only(spark):
    """Files of all folders without a touched block or a delivered id are made unreadable."""
    root = scratch_path(spark, "state")
    rows = [record(i, "new roof", f"{100 + i // 2} Oak Ave") for i in range(60)]
    assert delivered(spark, root, rows) == brute_force(spark, rows)
    more = [record(1000, "new roof", "100 Oak Ave", True)]
    expr = [F.pmod(F.xxhash64(x), F.lit(8)) for x in (F.lit(1000).cast("long"), F.lit("100:oak"))]
    id_bucket, block_bucket = spark.range(1).select(*expr).first()
    for name, kept in (("places", id_bucket), ("records", block_bucket), ("plan", block_bucket)):
        for file in Path(root.removeprefix("file:")).glob(f"{name}/bucket=*/*.parquet"):
            if file.parent.name != f"bucket={kept}":
                file.write_bytes(b"not a table")
    S.deliver(spark.createDataFrame(more, SCHEMA), root, buckets=8)
    kept = spark.read.parquet(f"{root}/plan/bucket={block_bucket}").where("block = '100:oak'")
    assert {r["id"]: r["canonical_id"] for r in kept.collect()} == {0: 1000, 1: 1000}


def test_titles_too_short_to_prove_are_joined_by_neighbours(spark):
    """Titles that differ in one long word: no part proves a score of 90, so all pairs went through tiles."""
    titles = [f"lot {900 + k / 10} nut red small" for k in range(60)]
    reps = spark.createDataFrame([(f"n{k:03d}", "7:smal", "7 small st", t) for k, t in enumerate(titles)], "node string, block string, address string, title string")
    links = D._hub_links(reps, 90.0).collect()
    assert all(token_set_score(titles[int(r.src[1:])], titles[int(r.dst[1:])]) >= 90 for r in links)
    found = connected_components(spark.createDataFrame(links, "src string, dst string")).collect()
    assert len(found) == 60 and {r.component for r in found} == {"n000"}


def test_small_blocks_go_to_python_in_batches(spark):
    """One call for many blocks, not one group each."""
    rows = [(f"n{b:03d}{k}", f"{b}:oak", f"{b} oak st", title) for b in range(50) for k, title in enumerate(("new roof", "new roofs", "pool"))]
    reps = spark.createDataFrame(rows, "node string, block string, address string, title string")
    found = D._block_components(reps, 92.0, 72.0)
    assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().toString()
    assert sorted(map(tuple, found.collect())) == sorted((f"n{b:03d}{k}", f"n{b:03d}0") for b in range(50) for k in (0, 1))
