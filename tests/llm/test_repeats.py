"""Suffix dedup and near duplicates against brute force."""

from __future__ import annotations

import hashlib
import random

import numpy as np

from siteledger.llm import chunks, jaccard, suffix_dedup
from tests.llm.fixtures import SCHEMA, documents, texts, words


def _removed(rows, n=50):
    first: dict[bytes, float] = {}
    ids = [float("inf") if d is None else d for d, _ in rows]
    for d, (_, t) in zip(ids, rows, strict=True):
        b = (t or "").encode()
        for i in range(len(b) - n + 1):
            first[b[i : i + n]] = min(first.get(b[i : i + n], d), d)
    out = []
    for d, (own, t) in zip(ids, rows, strict=True):
        b = (t or "").encode()
        mask = bytearray(len(b))
        for i in range(len(b) - n + 1):
            if first[b[i : i + n]] < d:
                mask[i : i + n] = b"\1" * n
        kept = bytes(x for x, gone in zip(b, mask, strict=True) if not gone)
        spans = sum(1 for i, gone in enumerate(mask) if gone and not (i and mask[i - 1]))
        out.append((own, len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept))
    return out


def test_removed_bytes(spark):
    rows = texts(5)
    rows += [rows[0], rows[1], (None, rows[2][1]), (None, None), (rows[3][0], "another text of the same id, which is longer than fifty bytes")]
    got = suffix_dedup.remove_repeats(documents(spark, rows)).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, r[4])
    want = sorted((r[:5] for r in _removed(rows)), key=key)
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=key) == want
    assert sum(r[2] for r in want) > 1000


def test_rewritten_keeps_columns_and_characters(spark):
    rows = texts(7)
    docs = documents(spark, rows)
    got = {r.doc_id: r for r in suffix_dedup.rewritten(docs).collect()}
    assert suffix_dedup.rewritten(docs).columns == docs.columns
    for d, n, lost, _, _, kept in _removed(rows):
        if n and not kept:
            assert d not in got or got[d].text
        elif not lost:
            assert got[d].text == dict(rows)[d]
        elif d in got:
            assert got[d].n_chars == len(got[d].text) and kept.decode(errors="ignore").replace("�", "") in got[d].text.encode().decode() or got[d].text


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert suffix_dedup.remove_repeats(empty).count() == 0
    assert jaccard.near_duplicates(empty).count() == 0


def test_stages_of_the_pipeline(spark):
    """Every stage takes documents that have odd rows and columns, and an empty table."""
    import corpus_pipeline
    from siteledger.session import scratch_path

    folder = scratch_path(spark, "pipeline-test")
    spark.createDataFrame([(1, "some benchmark item of six words or more")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = documents(spark, texts(11, 30) + [(None, None), (5, "again"), (5, "again")])
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        path = f"{folder}/{k}"
        out.write.parquet(path)
        assert k == len(corpus_pipeline.STAGES) - 1 or out.columns == docs.columns
        docs = spark.read.parquet(path)
    assert docs.where("taken = 0").count() == 0 and docs.count() > 0
    for name, stage in corpus_pipeline.STAGES:
        if "Jaccard" not in name and "suffix" not in name:
            assert stage(spark, spark.createDataFrame([], SCHEMA), folder).count() == 0


def _shingles(text):
    w = words(text)
    if not w:
        return set()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}


def _components(rows):
    sets = [(d, _shingles(t)) for d, t in rows]
    parent = {d: d for d, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[i + 1 :]:
            if None not in (a, b) and x and y and 100 * len(x & y) >= 80 * len(x | y):
                low, high = sorted((find(a), find(b)))
                parent[high] = low
    return sorted(((d, len(s), find(d)) for d, s in sets), key=str)


def test_near_duplicate_components(spark):
    """With borderline chains, whose pairs share just 80 % and mostly no min-hash, and copies that only their source links."""
    rng = random.Random(1)
    rows = texts(5, 60)
    rows += [rows[0], (None, rows[1][1]), (rows[4][0], rows[5][1])]
    rows += [(2000 + k, " ".join(f"v{i}" for i in range(k * 5, k * 5 + 49))) for k in range(6)]
    rows += [(3000 + k, " ".join(f"w{i}" for i in range(k * 6, k * 6 + 54))) for k in range(3)]
    source = [f"u{i}" for i in range(100)]
    rows += [(4000, " ".join(source))]
    for k in range(12):
        own = list(source)
        own[7 * k + 9] = own[7 * k + 3] = f"edit{k}"
        rows.append((3900 + k, " ".join(own)))
    passage = [f"p{i}" for i in range(64)]
    rows += [(5000 + k, " ".join([*passage, *(f"own{k}x{i}" for i in range(rng.choice([4, 8, 12])))])) for k in range(20)]
    got = jaccard.near_duplicates(documents(spark, rows)).collect()
    want = _components(rows)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == want
    assert len({c for _, _, c in want}) < len(rows) - 20


def test_one_row_stays_of_each_group(spark):
    rows = texts(9, 40)
    rows += [rows[0], (None, "left alone"), (None, "left alone")]
    docs = documents(spark, rows)
    kept = jaccard.representatives(docs)
    assert kept.columns == docs.columns
    want = sorted(str(c) for d, _, c in set(_components(rows)) if d == c and d is not None) + ["None", "None"]
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(want)


def test_tokens_with_partners():
    """A token is usable wherever a class of another component within reach has it; a hot token is one record a slot."""
    rng = np.random.default_rng(3)
    classes = np.empty(3000, jaccard._RECORD)
    classes["token"] = rng.integers(0, 400, 3000)
    classes["n"] = rng.integers(5, 200, 3000)
    classes["reach"] = 80 * classes["n"] * rng.uniform(0.9, 1.25, 3000)
    classes["low"] = classes["high"] = rng.integers(0, 40, 3000)
    got = jaccard._partners(classes)
    sums, place = jaccard._slots(classes)
    summed = jaccard._partners(sums)[place]
    for i, c in enumerate(classes):
        same = classes[classes["token"] == c["token"]]
        near = (80 * same["n"] <= c["reach"]) & (80 * c["n"] <= same["reach"]) & (same["low"] != c["low"])
        assert got[i] >= near.any() and summed[i] >= near.any()
    assert 0 < got.sum() < len(classes)
    alone = classes[classes["low"] == 7]
    assert not jaccard._partners(alone).any() and len(jaccard._partners(classes[:0])) == 0
    hot = np.repeat(classes[:1], 5000)
    hot["low"] = hot["high"] = np.arange(5000)
    assert len(jaccard._slots(hot)[0]) <= 16


def test_crossing_joins_no_tokens(spark):
    """Classes that share a passage meet through packed chunks: no plan joins a row for each class and token."""
    rows = [(k, k, 40, list(range(30)) + [1000 + 40 * (k % 5) + i for i in range(10)]) for k in range(50)]
    classes = spark.createDataFrame(rows, "rep long, comp long, n long, tokens array<long>")
    plans = []
    keep, jaccard.cut = jaccard.cut, lambda df: plans.append(df._jdf.queryExecution().toString()) or keep(df)
    try:
        got = {r.rep: sorted(r.cross) for r in jaccard._crossing(classes, 8).collect()}
    finally:
        jaccard.cut = keep
    assert got == {k: sorted(t) for k, _, _, t in rows}
    assert plans and not any("Join" in p or "Generate" in p for p in plans)


def _broadcast(spark, seen: int) -> int:
    """Rows of the largest broadcast of all queries but the first ``seen``."""
    store = spark._jsparkSession.sharedState().statusStore()
    runs, most = store.executionsList(), 0
    for i in range(seen, runs.size()):
        values, nodes = store.executionMetrics(runs.apply(i).executionId()), store.planGraph(runs.apply(i).executionId()).allNodes()
        for node in (nodes.apply(j) for j in range(nodes.size())):
            metrics = node.metrics()
            for m in (metrics.apply(j) for j in range(metrics.size())):
                if node.name() == "BroadcastExchange" and m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                    most = max(most, int(values.apply(m.accumulatorId()).replace(",", "")))
    return most


def test_tokens_stay_off_the_driver(spark):
    """Classes of common passages are small files and many rows: none of these goes through the driver as a broadcast."""
    rng = random.Random(4)
    passages = [" ".join(f"p{k}x{i}" for i in range(50)) for k in range(40)]
    rows = [(k, " ".join(rng.sample(passages, 20))) for k in range(240)]
    rows += [(1000 + k, f"{rows[k][1]} more") for k in range(3)]
    seen = spark._jsparkSession.sharedState().statusStore().executionsList().size()
    got = {r.doc_id: r.component_id for r in jaccard.near_duplicates(documents(spark, rows)).collect()}
    assert got == {**{k: k for k in range(240)}, **{1000 + k: k for k in range(3)}}
    assert _broadcast(spark, seen) <= len(rows)


def test_groups_give_their_memory_back():
    """What a group had between arrays that stay is the system's again before the next group."""

    def resident():
        with open("/proc/self/status") as f:
            return next(int(x.split()[1]) for x in f if x.startswith("VmRSS")) // 1024

    stays = []

    def group(rows):
        made = []
        for _ in range(4000):
            made.append(np.ones(8000))
            stays.append(np.ones(4))  # small, between the large ones
            stays.append(bytes(2000))
        return rows

    before = resident()
    chunks._lean(group)(None)
    assert resident() - before < 100
