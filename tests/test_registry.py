from __future__ import annotations

import __spark_entry__ as entry


def test_every_query_is_registered_once_and_checked():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries)
    own = {n for n in queries if n != "pipeline" and not n.startswith("op")}
    assert own - set(oracles) == {"dedupe_parts", "pipeline_tail"}


def test_entry_runs(spark):
    rows = entry.entry(spark).collect()
    assert [r["category"] for r in rows] == sorted(r["category"] for r in rows) and rows
