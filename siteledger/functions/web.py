"""Company websites: candidates, addresses, page contacts and the match rule."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siteledger.functions.contacts import EMAIL, clean_phone, extract_phone
from siteledger.functions.text import null_if_empty, strip

# Paths, link hints, company suffixes and image suffixes.
CONTACT_PATHS = ("/contact", "/contact-us", "/about", "/about-us")
LINK_HINTS = ("contact", "about", "locations")
COMPANY_SUFFIXES = ("co", "company", "corp", "corporation", "inc", "incorporated", "llc", "lp", "ltd", "the")
IMAGE_SUFFIXES = (".png", ".jpg", ".jpeg", ".gif", ".webp", ".svg")


def company_tokens(name: Column) -> Column:
    """Words of a company name without legal suffixes and single characters."""
    words = F.regexp_extract_all(F.replace(F.lower(name), F.lit("&"), F.lit(" and ")), F.lit("([a-z0-9]+)"), F.lit(1))
    return F.filter(words, lambda w: ~w.isin(*COMPANY_SUFFIXES) & (F.length(w) > 1))


def slug_variants(tokens: Column) -> Column:
    """Joined, hyphenated (two or more tokens) and first-two (three or more) host names."""
    size = F.size(tokens)
    return F.array_distinct(
        F.array_compact(
            F.array(
                F.when(size > 0, F.array_join(tokens, "")),
                F.when(size > 1, F.array_join(tokens, "-")),
                F.when(size > 2, F.array_join(F.slice(tokens, 1, 2), "")),
            )
        )
    )


def site_candidates(name: Column, max_candidates: int = 6, min_token_len: int = 4) -> Column:
    """Guessed home pages of a company; none for a single short word."""
    tokens = company_tokens(name)
    urls = F.flatten(
        F.transform(
            slug_variants(tokens),
            lambda s: F.array(
                F.concat(F.lit("https://"), s, F.lit(".com")), F.concat(F.lit("https://www."), s, F.lit(".com"))
            ),
        )
    )
    too_short = (F.size(tokens) == 1) & (F.length(F.get(tokens, F.lit(0))) < min_token_len)
    none = F.array().cast("array<string>")
    return F.when(name.isNull() | too_short, none).otherwise(F.slice(urls, 1, max_candidates))


_URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)"
# Scheme and host; path without the last step's parameters, trailing slashes, query and fragment.
_SITE = r"(?s)^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)((?:/[^/?#]*?)*?)/*(?:;[^/?#]*)?(?:[?#].*)?$"


def normalize_website(col: Column) -> Column:
    """``scheme://host/path`` in lower-case scheme and host, no query, no trailing slash."""
    full = F.regexp_replace(strip(col), "^(?![hH][tT][tT][pP][sS]?://)", "https://")

    def part(url: Column, group: int) -> Column:
        return F.get(F.regexp_extract_all(url, F.lit(_SITE), F.lit(group)), F.lit(0))

    # Through a one-element array, so that the cleaned text is computed once for both parts.
    return F.get(F.transform(F.array(full), lambda url: F.concat(F.lower(part(url, 1)), part(url, 2))), F.lit(0))


def site_root(website: Column) -> Column:
    return null_if_empty(F.regexp_extract(website, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", 0))


def site_host(website: Column) -> Column:
    return F.lower(F.regexp_extract(website, _URL, 2))


def candidate_urls(website: Column) -> Column:
    """The site itself, then its standard contact pages."""
    root = site_root(website)
    return F.array_distinct(F.array(website, *[F.concat(root, F.lit(p)) for p in CONTACT_PATHS]))


def _clean_mail(col: Column) -> Column:
    return null_if_empty(F.regexp_replace(col, "^[.,;:)]+|[.,;:)]+$", ""))


def is_image(col: Column) -> Column:
    return F.lower(col).rlike(r"(?:" + "|".join(s.replace(".", r"\.") for s in IMAGE_SUFFIXES) + ")$")


def _after_colon(href: Column) -> Column:
    return F.substr(href, F.locate(":", href) + 1)


def _unquote(col: Column) -> Column:
    """Percent-decoding that leaves '+' alone and keeps text that is not well formed."""
    return F.coalesce(F.try_url_decode(F.replace(col, F.lit("+"), F.lit("%2B"))), col)


def page_email(text: Column, hrefs: Column) -> Column:
    """First usable mailto address, else the first address in the visible text."""
    mailtos = F.filter(hrefs, lambda h: F.lower(h).startswith("mailto:"))

    def address(h: Column) -> Column:
        body = F.split_part(F.split_part(_unquote(_after_colon(h)), F.lit("?"), F.lit(1)), F.lit(","), F.lit(1))
        return _clean_mail(strip(body))

    linked = F.filter(F.transform(mailtos, address), lambda e: e.isNotNull() & ~is_image(e))
    written = F.filter(
        F.transform(F.regexp_extract_all(text, F.lit(EMAIL), F.lit(0)), _clean_mail), lambda e: ~is_image(e)
    )
    return F.coalesce(F.get(linked, F.lit(0)), F.get(written, F.lit(0)))


def page_phone(text: Column, hrefs: Column) -> Column:
    """First tel link that formats as a number, else the first number in the visible text."""
    tels = F.filter(hrefs, lambda h: F.lower(h).startswith("tel:"))
    linked = F.filter(
        F.transform(tels, lambda h: clean_phone(_unquote(_after_colon(h)))), lambda p: p.startswith("(")
    )
    return F.coalesce(F.get(linked, F.lit(0)), extract_phone(text))


def page_matches(tokens: Column, text: Column, website: Column) -> Column:
    """Does the visible text (and the host name) speak of this company?"""
    visible = F.lower(F.coalesce(text, F.lit("")))
    matched = F.size(F.filter(tokens, lambda t: (F.length(t) > 2) & visible.contains(t)))
    host = F.regexp_replace(site_host(website), r"^www\.", "")
    compact_host = F.regexp_replace(F.regexp_replace(host, r"\.[^.]*$", ""), "[^a-z0-9]", "")
    required = F.when(F.size(tokens) == 1, 1).otherwise(2)
    needed = F.when(compact_host.contains(F.array_join(tokens, "")), 1).otherwise(required)
    return (F.size(tokens) > 0) & (matched >= needed)
