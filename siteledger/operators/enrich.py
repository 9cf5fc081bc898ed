"""Contact enrichment per distinct company: licence file, known website, guessed website."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteledger.functions import web as W
from siteledger.functions.contacts import clean_phone, normalize_license
from siteledger.functions.html import page_parts
from siteledger.functions.text import company_key, join_parts, null_if_empty
from siteledger.operators.leads import enrichment_targets
from siteledger.operators.page_filter import possibly_wanted
from siteledger.operators.upsert import merge_companies
from siteledger.schemas import RESULT, conform
from siteledger.session import cut

# An enrichment provider: companies -> one result row per company.
Provider = Callable[[DataFrame], DataFrame]

UPDATED, NOT_FOUND, SKIPPED, PENDING = "updated", "not_found", "skipped", "pending"


def target_companies(leads: DataFrame, category: str | None = None) -> DataFrame:
    """Distinct companies on leads that lack a contact."""
    targets = enrichment_targets(leads, category).where("company_key is not null")
    return targets.groupBy("company_key").agg(
        F.max("company_name").alias("name"), F.max("license_number").alias("license_number"), F.max("website").alias("website")
    )


def license_result(companies: DataFrame, master: DataFrame | None) -> DataFrame:
    """Licence lookup. Address, status and class come back even when the file has no phone.

    ``master`` is the keyed licence file; None means there is no file yet.
    """
    keyed = companies.withColumn("license_key", normalize_license(F.col("license_number")))
    if master is None:
        status = F.when(F.col("license_key").isNull(), SKIPPED).otherwise(PENDING)
        detail = F.when(F.col("license_key").isNull(), "No numeric license number").otherwise("License file not found")
        return conform(keyed.select("company_key", F.lit("license").alias("provider"), status.alias("status"), detail.alias("detail")), RESULT)
    joined = keyed.join(master.withColumn("_hit", F.lit(True)), "license_key", "left")
    key, hit = F.col("license_key"), F.col("_hit")
    phone = clean_phone(F.col("BusinessPhone"))
    business = F.coalesce(null_if_empty(F.col("FullBusinessName")), null_if_empty(F.col("BusinessName")), F.col("name"))
    status = (
        F.when(key.isNull(), SKIPPED).when(hit.isNull(), NOT_FOUND).when(phone.isNull(), NOT_FOUND).otherwise(UPDATED)
    )
    detail = (
        F.when(key.isNull(), F.lit("No numeric license number"))
        .when(hit.isNull(), F.concat(F.lit("License "), key, F.lit(" not in the license file")))
        .when(phone.isNull(), F.concat(F.lit("License "), key, F.lit(" matched but has no public phone")))
        .otherwise(F.concat(F.lit("Matched license "), key, F.lit(": "), F.coalesce(business, F.lit(""))))
    )
    rows = joined.select(
        "company_key",
        F.lit("license").alias("provider"),
        status.alias("status"),
        phone.alias("phone"),
        detail.alias("detail"),
        join_parts(F.col("MailingAddress"), F.col("City"), F.col("State"), F.col("ZIPCode")).alias("address"),
        join_parts(F.col("PrimaryStatus"), F.col("SecondaryStatus"), sep=" / ").alias("license_status"),
        null_if_empty(F.col("`Classifications(s)`")).alias("license_classification"),
    )
    return conform(rows, RESULT)


def keyed_pages(pages: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Crawled pages (url, html and, if known, fetched_at) under their normal address."""
    fetched = F.col("fetched_at").cast("timestamp") if "fetched_at" in pages.columns else F.lit(None).cast("timestamp")
    return pages.select(_address(F.col("url")).alias("page_url"), fetched.alias("fetched_at"), *keep, "html")


def _address(url: Column) -> Column:
    """One row with the normal address, none where there is none. A filter on the address would compute it again."""
    return F.explode(F.array_compact(F.array(W.normalize_website(url))))


def parsed_pages(
    pages: DataFrame, hints: tuple[str, ...] = W.LINK_HINTS, max_links: int | None = None, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Crawled pages (url, html) -> page_url, fetched_at, text, email, phone, links; the HTML is parsed once.

    Links are resolved against the normal address. ``max_links`` keeps only the first ones of a page, ``keep`` names
    columns of ``pages`` to carry along.
    """
    return _parsed(keyed_pages(pages, keep), hints, max_links, keep)


def _parsed(
    keyed: DataFrame, hints: tuple[str, ...] = W.LINK_HINTS, max_links: int | None = None, keep: tuple[str, ...] = ()
) -> DataFrame:
    parts = keyed.select(
        "page_url", "fetched_at", *keep, page_parts(F.col("html"), F.col("page_url"), hints, max_links).alias("p")
    )
    return parts.select(
        "page_url",
        "fetched_at",
        *keep,
        F.col("p.text").alias("text"),
        W.page_email(F.col("p.text"), F.col("p.hrefs")).alias("email"),
        W.page_phone(F.col("p.text"), F.col("p.hrefs")).alias("phone"),
        F.col("p.links").alias("links"),
    )


def unique_pages(pages: DataFrame) -> DataFrame:
    """A URL crawled more than once counts as one page: the newest, of equally old ones that with the greatest text."""
    rest = [c for c in pages.columns if c != "page_url"]
    best = F.max_by(F.struct(*rest), F.struct("fetched_at", "text", "email", "phone")).alias("_p")
    return pages.groupBy("page_url").agg(best).select("page_url", "_p.*")


def known_site_result(companies: DataFrame, pages: DataFrame) -> DataFrame:
    """First page with a contact among the home page, the links on it and the standard paths.

    ``pages`` comes from ``parsed_pages`` and ``unique_pages``. E-mail and phone are taken from the same page.
    """
    sites = companies.select("company_key", W.normalize_website(F.col("website")).alias("site"))
    wanted = sites.where("site is not null").select("site").distinct()
    home = wanted.join(pages.select(F.col("page_url").alias("site"), "links"), "site", "left").withColumn(
        "standard", W.candidate_urls(F.col("site"))
    )
    # Pages are tried in this order: home, links found on home, then the standard paths.
    order = F.concat(
        F.slice("standard", 1, 1),
        F.coalesce(F.col("links"), F.array().cast("array<string>")),
        F.slice("standard", 2, len(W.CONTACT_PATHS)),
    )
    tries = home.select("site", F.posexplode(order).alias("rank", "try_url"))
    tries = tries.select("site", "rank", "try_url", W.normalize_website(F.col("try_url")).alias("page_url"))
    found = tries.join(pages.select("page_url", "email", "phone"), "page_url")
    first = (
        found.groupBy("site")
        .agg(
            F.expr(
                "min_by(struct(email, phone, try_url), rank) FILTER (WHERE email IS NOT NULL OR phone IS NOT NULL)"
            ).alias("c"),
            F.count("*").alias("fetched"),
        )
    )
    joined = sites.join(first, "site", "left")
    status = F.when(F.col("site").isNull(), SKIPPED).when(F.col("c").isNull(), NOT_FOUND).otherwise(UPDATED)
    detail = (
        F.when(F.col("site").isNull(), F.lit("No website"))
        .when(F.col("fetched").isNull(), F.lit("Unable to fetch website pages"))
        .when(F.col("c").isNull(), F.lit("No public email or phone found"))
        .otherwise(F.concat(F.lit("Found public contact on "), F.col("c.try_url")))
    )
    rows = joined.select(
        "company_key",
        F.lit("public_web").alias("provider"),
        status.alias("status"),
        F.col("c.email").alias("email"),
        F.col("c.phone").alias("phone"),
        F.when(status == UPDATED, F.col("site")).alias("website"),
        detail.alias("detail"),
    )
    return conform(rows, RESULT)


def discover_sites(companies: DataFrame, pages: DataFrame, max_candidates: int = 6, min_token_len: int = 4) -> DataFrame:
    """(company_key, site): the first guessed home page whose text speaks of the company."""
    guesses = companies.select(
        "company_key",
        W.company_tokens(F.col("name")).alias("tokens"),
        F.posexplode(W.site_candidates(F.col("name"), max_candidates, min_token_len)).alias("rank", "page_url"),
    )
    texts = pages.select("page_url", "text")
    matched = guesses.join(texts, "page_url").where(
        W.page_matches(F.col("tokens"), F.col("text"), F.col("page_url"))
    )
    return matched.groupBy("company_key").agg(F.min_by("page_url", "rank").alias("site"))


def wanted_pages(companies: DataFrame, crawl: DataFrame, max_candidates: int = 6, min_token_len: int = 4) -> DataFrame:
    """Parsed pages of a crawl (url, html) that ``companies`` can ask for.

    First the home pages and standard paths of known and guessed sites, then what the home pages link to. A filter of the
    wanted addresses decides beside the scan which pages are parsed, so html is never shuffled; what it lets through by
    chance goes after parsing.
    """
    keyed = keyed_pages(crawl)
    known = companies.select(_address(F.col("website")).alias("site"))
    guesses = companies.select(F.explode(W.site_candidates(F.col("name"), max_candidates, min_token_len)).alias("site"))
    sites = known.unionByName(guesses.select(W.normalize_website(F.col("site")).alias("site"))).distinct()
    tries = sites.select(F.explode(W.candidate_urls(F.col("site"))).alias("url"))
    first = cut(tries.select(_address(F.col("url")).alias("page_url")).distinct())
    home = cut(_looked_up(keyed, first))
    links = home.select(F.explode("links").alias("url")).select(_address(F.col("url")).alias("page_url")).distinct()
    more = cut(links.join(first, "page_url", "left_anti"))
    return home.unionByName(cut(_looked_up(keyed, more)))


def _looked_up(keyed: DataFrame, addresses: DataFrame) -> DataFrame:
    """The newest parsed page of each of ``addresses`` (a written table). Parsed pages are written before they are joined:
    a join that is pushed below the parser would shuffle html."""
    parsed = cut(_parsed(possibly_wanted(keyed, addresses)))
    return unique_pages(parsed.join(addresses, "page_url", "left_semi"))


def web_result(companies: DataFrame, crawl: DataFrame, max_candidates: int = 6, min_token_len: int = 4) -> DataFrame:
    """Known website first; a company without one is looked up under its guessed addresses.

    ``crawl`` holds fetched pages (url, html, fetched_at if known); only wanted ones are parsed, once.
    """
    pages = wanted_pages(companies, crawl, max_candidates, min_token_len)
    known = companies.where(W.normalize_website(F.col("website")).isNotNull())
    unknown = companies.where(W.normalize_website(F.col("website")).isNull())
    found = discover_sites(unknown, pages, max_candidates, min_token_len)
    guessed = cut(unknown.join(found, "company_key", "left").withColumn("website", F.col("site")))
    first = known_site_result(known.unionByName(guessed.where("site is not null").select(*known.columns)), pages)
    lost = guessed.where("site is null").select(
        "company_key",
        F.lit("public_web").alias("provider"),
        F.lit(NOT_FOUND).alias("status"),
        F.lit("No reliable website candidate").alias("detail"),
    )
    return first.unionByName(conform(lost, RESULT))


def merge_results(results: list[DataFrame]) -> DataFrame:
    """Provider results in order -> one update per company.

    Of each contact field the last provider that updated it wins; licence fields always merge.
    """
    both = None
    for order, result in enumerate(results):
        numbered = result.withColumn("_o", F.lit(order))
        both = numbered if both is None else both.unionByName(numbered)
    contact = [
        F.expr(f"max_by({c}, _o) FILTER (WHERE status = '{UPDATED}' AND {c} IS NOT NULL)").alias(c)
        for c in ("email", "phone", "website")
    ]
    licence = [
        F.expr(f"max_by({c}, _o) FILTER (WHERE {c} IS NOT NULL)").alias(c)
        for c in ("address", "license_status", "license_classification")
    ]
    touched = f"status = '{UPDATED}' AND (email IS NOT NULL OR phone IS NOT NULL OR website IS NOT NULL)"
    return both.groupBy("company_key").agg(*contact, *licence, F.expr(f"coalesce(bool_or({touched}), false)").alias("updated"))


def write_back(companies: DataFrame, merged: DataFrame, now: Column, fill_only: bool = False) -> DataFrame:
    columns = ["email", "phone", "website"]
    with_contact = merge_companies(companies, merged.select("company_key", *columns), now, columns, fill_only)
    info = ["address", "license_status", "license_classification"]
    return merge_companies(with_contact, merged.select("company_key", *info), now, info)


def attempts(targets: DataFrame, results: list[DataFrame], now: Column) -> DataFrame:
    """One row per (lead, provider), and one skip row per lead without a company."""
    both = None
    for result in results:
        part = result.select("company_key", "provider", "status", "detail")
        both = part if both is None else both.unionByName(part)
    leads = targets.select("source", "source_record_id", "company_key")
    listed = both.groupBy("company_key").agg(F.collect_list(F.struct("provider", "status", "detail")).alias("_a"))
    tried = (
        leads.where("company_key is not null").join(listed, "company_key").select("source", "source_record_id", F.explode("_a").alias("a"))
    )
    skipped = leads.where("company_key is null").select(
        "source",
        "source_record_id",
        F.lit("enrichment").alias("provider"),
        F.lit(SKIPPED).alias("status"),
        F.lit("No company candidate").alias("detail"),
    )
    return tried.select("source", "source_record_id", "a.*").unionByName(skipped).withColumn("created_at", now)


def enrichment_stats(targets: DataFrame, merged: DataFrame) -> DataFrame:
    """Checked, updated, pending and skipped leads."""
    flags = merged.select("company_key", "updated")
    leads = targets.select("source", "source_record_id", "company_key")
    joined = leads.join(flags, "company_key", "left")
    skipped = F.col("company_key").isNull()
    updated = F.coalesce(F.col("updated"), F.lit(False))
    return joined.agg(
        F.count("*").alias("checked"),
        F.count_if(~skipped & updated).alias("updated"),
        F.count_if(~skipped & ~updated).alias("pending"),
        F.count_if(skipped).alias("skipped"),
    )


def probe_pages(pairs: DataFrame, pages: DataFrame) -> DataFrame:
    """(url, company_name) pairs -> contact on that page and whether it speaks of the company."""
    keyed = pairs.withColumn("page_url", F.coalesce(W.normalize_website(F.col("url")), F.col("url")))
    return probe_named(keyed.join(pages, "page_url"))


def probe_named(pages: DataFrame) -> DataFrame:
    """Parsed pages that carry a ``company_name``, one row per page: contact and whether it speaks of that company."""
    matches = W.page_matches(W.company_tokens(F.col("company_name")), F.col("text"), F.col("page_url"))
    return pages.select(
        F.col("page_url").alias("url"),
        "company_name",
        "email",
        "phone",
        F.when(F.length("company_name") > 0, matches).alias("matches_company"),
    )


def pending_companies(leads: DataFrame, category: str | None = None) -> DataFrame:
    """Companies of contactless leads, each with its first lead as a sample."""
    targets = enrichment_targets(leads, category).where("company_key is not null")
    order = F.struct("first_seen", "source", "source_record_id")
    return targets.groupBy("company_key").agg(
        F.min_by("company_name", order).alias("company_name"),
        F.min_by("license_number", order).alias("license_number"),
        F.min_by("website", order).alias("website"),
        F.min_by("city", order).alias("city"),
        F.min_by(F.coalesce("description", F.lit("")), order).alias("sample_project"),
    )


def shard_of(key: Column, shards: int) -> Column:
    """Which of ``shards`` disjoint slices a company belongs to."""
    return F.pmod(F.xxhash64(key), F.lit(shards)).cast("int")


def shard(rows: DataFrame, number: int, shards: int, limit: int | None = None) -> DataFrame:
    """One slice of a company list, for one of ``shards`` parallel workers."""
    part = rows.where(shard_of(F.col("company_key"), shards) == number)
    return part.orderBy("company_key").limit(limit) if limit else part


def set_contacts(companies: DataFrame, updates: DataFrame, now: Column, fill_only: bool = False) -> DataFrame:
    """Hand-found contacts (company_name, email, phone, website) written back by company."""
    keyed = updates.withColumn("company_key", company_key(F.col("company_name")))
    columns = ["email", "phone", "website"]
    one = keyed.groupBy("company_key").agg(*[F.max(null_if_empty(F.col(c))).alias(c) for c in columns])
    return merge_companies(companies, one, now, columns, fill_only)
