"""HTML -> visible text and links, a hundred pages at a time."""

from __future__ import annotations

from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

from pyspark.sql import Column
from pyspark.sql import functions as F

from siteledger.functions.web import LINK_HINTS

# Elements whose text nobody sees; links in them count.
HIDDEN = frozenset(("script", "style", "noscript", "template"))

PAGE_STRUCT = "struct<text:string,hrefs:array<string>,links:array<string>>"


class _Page(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.texts: list[str] = []
        self.hrefs: list[str] = []
        self._hidden = 0

    def handle_starttag(self, tag, attrs):
        if tag in HIDDEN:
            self._hidden += 1
        elif tag == "a":
            self.hrefs.extend(value or "" for name, value in attrs if name == "href")

    def handle_endtag(self, tag):
        if tag in HIDDEN and self._hidden:
            self._hidden -= 1

    def handle_data(self, data):
        if not self._hidden and data.strip():
            self.texts.append(data)


def _links(hrefs: list[str], website: str, hints: tuple[str, ...], max_links: int | None) -> list[str]:
    """Distinct same-host links whose path or text hints at a contact page."""
    try:
        host = urlsplit(website).netloc.lower()
    except ValueError:
        return []
    found: dict[str, None] = {}
    for raw in hrefs:
        href = raw.strip()
        if not href or href.lower().startswith(("#", "mailto:", "tel:", "javascript:")):
            continue
        try:
            target = urlsplit(urljoin(website, href))
        except ValueError:
            continue
        path = target.path.rsplit("/", 1)
        path[-1] = path[-1].split(";", 1)[0]
        clean_path = "/".join(path)
        if target.netloc.lower() != host or not any(hint in f"{clean_path} {href}".lower() for hint in hints):
            continue
        found[f"{target.scheme}://{target.netloc.lower()}{clean_path.rstrip('/') or '/'}"] = None
        if max_links is not None and len(found) >= max_links:
            break
    return list(found)


def parse_page(html: str | None, url: str | None, hints: tuple[str, ...], max_links: int | None = None) -> dict:
    page = _Page()
    page.feed(html or "")
    page.close()
    return {
        "text": " ".join(page.texts),
        "hrefs": page.hrefs,
        "links": _links(page.hrefs, url or "", hints, max_links),
    }


def page_parts(html: Column, url: Column, hints: tuple[str, ...] = LINK_HINTS, max_links: int | None = None) -> Column:
    """STRUCT(text, hrefs, links) of a page fetched from ``url``.

    Not by Arrow: its batches are of so many rows (10,000), whatever their bytes, and a worker holds one of them several
    times over. A plain function gets a hundred pages at a time, and parsing costs far more than handing them over.
    """

    @F.udf(PAGE_STRUCT, useArrow=False)
    def parts(html: str | None, page_url: str | None):
        return tuple(parse_page(html, page_url, hints, max_links).values())

    return parts(html, url)
