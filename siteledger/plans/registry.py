"""All registered queries and their SQL."""

from __future__ import annotations

from siteledger.plans import enrichment, ingest, pipeline, reporting, resolve, state, streams

MODULES = (reporting, ingest, state, resolve, enrichment, streams, pipeline)


def queries() -> dict:
    return {name: run for module in MODULES for name, run in module.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
