from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from siteledger.session import local_session  # noqa: E402

SESSION = local_session(4, "6g", "siteledger-tests")
SESSION.sparkContext.setLogLevel("ERROR")


@pytest.fixture(scope="session")
def spark():
    yield SESSION
    SESSION.stop()


@pytest.fixture(scope="session")
def values(spark):
    """Evaluate column expressions over one column of texts and return plain lists."""

    def run(texts, *exprs):
        df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string")
        rows = df.select("i", *[e.alias(f"v{k}") for k, e in enumerate(exprs)]).orderBy("i").collect()
        if len(exprs) == 1:
            return [r["v0"] for r in rows]
        return [tuple(r[1:]) for r in rows]

    return run
