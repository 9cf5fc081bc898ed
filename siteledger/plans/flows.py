"""Composed runs: refresh one source, and the tail classify -> dedupe -> enrich -> export."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteledger import schemas as S
from siteledger.config import Settings, SourceConfig
from siteledger.functions.rules import DEFAULT_RULES, Rule
from siteledger.operators import classify as CL
from siteledger.operators import dedupe as D
from siteledger.operators import enrich as E
from siteledger.operators import leads as L
from siteledger.operators import upsert as U
from siteledger.operators.normalize import companies_of, normalize
from siteledger.session import cut


@dataclass(frozen=True)
class State:
    """The three keyed tables of a run."""

    raw: DataFrame
    projects: DataFrame
    companies: DataFrame


def refresh_source(state: State, name: str, incoming: DataFrame, cfg: SourceConfig, now: Column) -> State:
    """Raw upsert, then new and changed rows of this source become projects and companies."""
    raw = cut(U.upsert_raw(state.raw, incoming, now))
    todo = U.needs_normalizing(raw.where(F.col("source") == name), state.projects.where(F.col("source") == name))
    fresh = cut(normalize(todo, cfg))
    return State(
        raw=U.mark_processed(raw, fresh),
        projects=U.upsert_projects(state.projects, fresh, now),
        companies=U.upsert_companies(state.companies, companies_of(fresh), now),
    )


def lead_id() -> Column:
    """One text id of a project, ordered like its natural key."""
    return F.concat_ws("/", "source", "source_record_id")


def run_tail(
    state: State,
    now: Column,
    master: DataFrame | None = None,
    pages: DataFrame | None = None,
    rules: Sequence[Rule] = DEFAULT_RULES,
    settings: Settings = Settings(),
) -> tuple[State, DataFrame, DataFrame]:
    """Classify, mark duplicates, enrich the contactless companies.

    Returns the new state, the lead view and the attempt log. ``master`` is the keyed licence
    file, ``pages`` are crawled pages (url, html).
    """
    projects = CL.classify_projects(state.projects, rules)
    records = projects.select(
        lead_id().alias("id"), "description", "address", F.col("company_key").isNotNull().alias("has_company"), "first_seen"
    )
    plan = D.duplicate_plan(records, settings.address_threshold, settings.title_threshold)
    keyed = D.mark_duplicates(projects.withColumn("_id", lead_id()), plan, "_id").drop("_id")
    projects = cut(S.conform(keyed, S.PROJECT))
    targets = L.enrichment_targets(L.with_companies(projects, state.companies))
    wanted = cut(E.target_companies(targets))
    results = [E.license_result(wanted, master)]
    if pages is not None:
        results.append(E.web_result(wanted, pages, settings.max_site_candidates, settings.min_token_len))
    results = [cut(r) for r in results]
    companies = cut(E.write_back(state.companies, E.merge_results(results), now))
    log = E.attempts(targets, results, now)
    return State(state.raw, projects, companies), L.with_companies(projects, companies), log
