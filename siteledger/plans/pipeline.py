"""Registered query: the whole run over the orders as permits."""

from __future__ import annotations

from pyspark.sql import functions as F

from siteledger import schemas as S
from siteledger.operators import leads as L
from siteledger.operators import upsert as U
from siteledger.plans import flows
from siteledger.plans.ingest import PERMIT_CONFIG, permit_responses
from siteledger.plans.state import NOW
from siteledger.sources import records

QUERIES = {}
ORACLES = {}


def pipeline_tail(spark, sf_dir):
    """Fetch, normalise, classify, dedupe, enrich and export; leads and contacts per sheet."""
    now = F.lit(NOW).cast("timestamp")
    start = flows.State(U.empty(spark, S.RAW), U.empty(spark, S.PROJECT), U.empty(spark, S.COMPANY))
    raw = records.read_source("orders", PERMIT_CONFIG, permit_responses(spark, sf_dir))
    state = flows.refresh_source(start, "orders", raw, PERMIT_CONFIG, now)
    rules = (("OFFICE_LAB", 0.84, ("automobile",)), ("RESIDENTIAL_REMODEL", 0.8, ("furniture", "household")))
    _, leads, _ = flows.run_tail(state, now, rules=rules)
    out = L.export_rows(L.exportable(leads))
    return out.groupBy("sheet").agg(F.count("*").alias("n"), F.count("phone").alias("with_phone"))


QUERIES["pipeline_tail"] = pipeline_tail
