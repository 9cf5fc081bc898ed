"""Main text of web pages from flat text blocks.

The markup is read as a flat sequence of blocks: text between two block-level tags. A block is described by its number
of words and its link density, by those of the blocks before and after it, and by two marks of where it stands: within
the article, and within page furniture (navigation, header, footer, aside, form, or an element whose class, id or role
says advert, cookie notice, sidebar, comments and the like). A decision tree grown on a small labelled table tells
content from the rest.

What encloses the page's main part or a large article is a wrapper and not furniture, whatever its name; so is a form,
or an element of such a class, that has most of a page's words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names of HTML, and words that sites use in class, id and role for what isn't the article.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 "
    "h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FURNITURE = frozenset("nav header footer aside form menu dialog select button fieldset head object canvas audio video".split())
ARTICLE = frozenset("article main".split())
HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup "
    "modal overlay newsletter subscribe subscription paywall sidebar aside widget widgets related recommended recommendations trending share sharing social "
    "menu nav navbar navigation breadcrumb breadcrumbs masthead header footer copyright legal disclaimer comment comments commentlist respond replies reply "
    "discussion disqus login signin signup search searchbox toolbar pagination pager contentinfo complementary form skip hidden".split()
)
# Names that say for certain what an element is, and elements that hold no article: wrappers only if most of the page, and no article elsewhere.
CERTAIN_HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo cookie cookies consent gdpr popup modal overlay newsletter paywall aside "
    "comments commentlist respond replies disqus contentinfo hidden".split()
)
CERTAIN = frozenset("aside dialog select button object canvas audio video".split())
# Parts of a class name that leave its hint as it is: "ad-slot", "site-footer", but not "section-header", "no-sidebar" or "related-work".
NEUTRAL = frozenset(
    "site global main primary secondary mobile desktop sticky top bottom left right container wrapper wrap box block area list links icons tools buttons bar slot unit "
    "zone posts articles stories inner outer".split()
)
TITLED, OWN_PARTS = frozenset("header masthead".split()), frozenset("page post entry article".split())
#: An article is large with this share of the words of the page's longest, or so many; a named wrapper without one has so many too.
LARGE, WRAPPER_WORDS = 0.5, 50
# Elements whose text isn't shown as text; they may be in the middle of a sentence.
UNSEEN = frozenset("svg annotation annotation-xml".split())
_TOKENS = (
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|textarea|title|iframe)\b(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+%s>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-z][^\s/>]*)(?P<rest>(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<end2>/?)(?P<name2>[a-z][^\s/>]*)(?P<rest2>[^>]*)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)"
)
# Within svg and math, a raw element may close itself.
_TOKEN, _FOREIGN_TOKEN = (re.compile(_TOKENS % own, re.IGNORECASE | re.DOTALL) for own in ("", "(?<!/)"))
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.IGNORECASE)


@dataclass
class Block:
    text: str
    words: int
    density: float
    article: int
    furniture: int


@dataclass
class Element:
    """An open or closed element that matters to its blocks; ``furniture`` is 0, 1 or, if it is certain, 2."""

    name: str
    parent: int
    furniture: int
    named: set[str]
    words: int = 0
    wraps: bool = False


def hints(names: str) -> set[str]:
    """The hints in a class, id or role: a name counts whole, or if all its hyphenated parts are hints or neutral."""
    found: set[str] = set()
    for name in names.lower().split():
        parts = [p for p in re.split(r"[^a-z]+", name) if len(p) > 1]
        said = HINTS.intersection(parts)
        if said and all(p in HINTS or p in NEUTRAL or (p in OWN_PARTS and not said & TITLED) for p in parts):
            found |= said
    return found


def _marks(elements: list[Element]) -> list[tuple[int, int]]:
    """(within an article, within furniture) of each element; parents come before their children."""
    for e in reversed(elements):
        if e.parent >= 0:
            elements[e.parent].words += e.words
    page = sum(e.words for e in elements if e.parent < 0)
    inside: list[int] = []
    apart: list[bool] = []
    for e in elements:
        inside.append(int(e.name in ARTICLE or (e.parent >= 0 and inside[e.parent])))
        apart.append(e.furniture == 2 or (e.parent >= 0 and apart[e.parent]))
    any_inside = any(inside)
    free = any(e.name in ARTICLE and not out for e, out in zip(elements, apart, strict=True))
    longest = max((e.words for e, out in zip(elements, apart, strict=True) if e.name == "article" and not out), default=0)
    for e in reversed(elements):
        if e.wraps or e.name == "main" or (e.name == "article" and e.words >= min(LARGE * longest, WRAPPER_WORDS)):
            e.wraps = True
            if e.parent >= 0:
                elements[e.parent].wraps = True
    marks: list[tuple[int, int]] = []
    for e, within in zip(elements, inside, strict=True):
        most = 2 * e.words > page
        wrapper = e.wraps and (e.furniture < 2 or (most and not free))
        if most and e.furniture == 1 and (within or not any_inside):
            wrapper = wrapper or e.name in ("form", "fieldset", "head") or (e.named and e.words >= WRAPPER_WORDS)
        title = within and e.named <= TITLED and (e.name == "header" or e.name not in FURNITURE)
        own = e.furniture and not wrapper and not title
        marks.append((within, int(bool(own) or (e.parent >= 0 and marks[e.parent][1] == 1 and e.name != "main"))))
    return marks


def _tokens(html: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(start, end, name, closing, attributes) of each tag, without name for comments and raw elements.

    An element of ``UNSEEN`` is one token with all that it holds. If it closes itself, or no end tag comes before the next
    block-level tag, only its own tag is left out.
    """
    tokens: list[tuple[int, int, str, bool, str]] = []
    open_: list[tuple[str, int]] = []
    unseen: dict[int, int] = {}
    at, pattern = 0, _TOKEN
    while m := pattern.search(html, at):
        at = m.end()
        name = (m["name"] or m["name2"] or "").lower()
        closing = (m["end"] or m["end2"]) == "/"
        rest = m["rest"] or m["rest2"] or ""
        if name in UNSEEN or name in ("math", "foreignobject"):
            if closing:
                for i in range(len(open_) - 1, -1, -1):
                    if open_[i][0] == name:
                        unseen[open_[i][1]] = len(tokens)
                        del open_[i:]
                        break
            elif not rest.endswith("/"):
                open_.append((name, len(tokens)))
        elif name in BLOCKS and open_ and not any(n in ("foreignobject", "annotation-xml") for n, _ in open_):
            open_.clear()
        pattern = _FOREIGN_TOKEN if open_ else _TOKEN
        tokens.append((m.start(), at, name, closing, rest))
    i = 0
    while i < len(tokens):
        start, end, name, closing, rest = tokens[i]
        if name in UNSEEN and i in unseen:
            i = unseen[i]
            yield start, tokens[i][1], "", False, ""
        else:
            yield start, end, name, closing, rest
        i += 1


def blocks(html: str) -> Iterator[Block]:
    """Text blocks in page order, white space collapsed and character references decoded; empty blocks are left out."""
    elements = [Element("", -1, 0, set())]
    found: list[tuple[str, int, float, int]] = []
    open_: list[int] = []
    text: list[str] = []
    linked: list[str] = []
    in_link, at = False, 0

    def block() -> None:
        whole = " ".join(unescape("".join(text)).split())
        links = len(unescape(" ".join(linked)).split())
        text.clear()
        linked.clear()
        if whole:
            words = whole.count(" ") + 1
            owner = open_[-1] if open_ else 0
            elements[owner].words += words
            found.append((whole, words, min(1.0, links / words), owner))

    for start, end, name, closing, rest in _tokens(html):
        if start > at:
            piece = html[at:start]
            text.append(piece)
            if in_link:
                linked.append(piece)
        at = end
        if not name or name in UNSEEN:
            continue
        if name == "br":
            text.append(" ")
        if name == "a":
            in_link = not closing
        if name in VOID and name not in BLOCKS:
            continue
        if name == "body" and not closing:
            text.clear()
            open_.clear()  # a head may be left open
        named: set[str] = set()
        if not closing and rest:
            for m in _NAMED.finditer(rest):
                named |= hints(unescape(m[1] or m[2] or m[3] or ""))
            if _HIDDEN.search(rest):
                named.add("hidden")
        if name in BLOCKS or name in FURNITURE or named or (closing and open_ and elements[open_[-1]].name == name):
            block()
        if name in VOID:
            continue
        if closing:
            for i in range(len(open_) - 1, -1, -1):
                if elements[open_[i]].name == name:
                    del open_[i:]
                    break
            if name in BLOCKS:
                in_link = False
        elif name in BLOCKS or name in FURNITURE or named:
            if name in ("p", "li", "dd", "dt", "option", "td", "th", "tr") and open_ and elements[open_[-1]].name == name:
                open_.pop()  # their end tags may be left out
            named_part = bool(named) and name not in ("html", "body", "article", "main")
            certain = name in CERTAIN or (named_part and bool(named & CERTAIN_HINTS))
            elements.append(Element(name, open_[-1] if open_ else 0, 2 if certain else int(name in FURNITURE or named_part), named if named_part else set()))
            open_.append(len(elements) - 1)
    text.append(html[at:])
    if in_link:
        linked.append(html[at:])
    block()
    marks = _marks(elements)
    for whole, words, density, owner in found:
        yield Block(whole, words, density, *marks[owner])


#: Features of a block, in the order of the table's columns.
FEATURES = ("words", "density", "words_before", "density_before", "words_after", "density_after", "article", "furniture")
# The labelled table: features as above, then 1 for content. Blocks of pages with and without an article element; where no
# mark speaks, words and link density of a block and its neighbours have to tell.
LABELLED = (
    (2, 1.0, 0, 0.0, 2, 1.0, 0, 1, 0), (1, 1.0, 1, 1.0, 9, 0.0, 0, 1, 0), (9, 0.0, 1, 1.0, 12, 0.0, 0, 1, 0), (14, 0.0, 20, 0.0, 60, 0.0, 0, 1, 0),
    (40, 0.0, 80, 0.0, 30, 0.0, 0, 1, 0), (120, 0.0, 60, 0.0, 90, 0.0, 0, 1, 0), (25, 0.1, 90, 0.0, 0, 0.0, 0, 1, 0), (6, 0.3, 50, 0.0, 0, 0.0, 0, 1, 0),
    (30, 0.0, 45, 0.0, 70, 0.0, 1, 1, 0), (8, 0.0, 100, 0.0, 100, 0.0, 1, 1, 0), (3, 0.9, 70, 0.0, 3, 0.9, 1, 1, 0), (55, 0.2, 35, 0.0, 20, 0.0, 1, 1, 0),
    (11, 0.0, 8, 0.0, 75, 0.0, 1, 0, 1), (1, 0.0, 40, 0.0, 30, 0.0, 1, 0, 1), (75, 0.0, 11, 0.0, 33, 0.0, 1, 0, 1), (4, 0.0, 33, 0.0, 120, 0.0, 1, 0, 1),
    (150, 0.1, 4, 0.0, 2, 0.0, 1, 0, 1), (20, 0.6, 60, 0.0, 70, 0.0, 1, 0, 1), (3, 1.0, 25, 0.0, 40, 0.0, 1, 0, 1), (9, 0.0, 1, 1.0, 5, 0.0, 1, 0, 1),
    (6, 0.0, 0, 0.0, 0, 0.0, 1, 0, 1), (60, 0.9, 12, 0.0, 14, 0.0, 1, 0, 1), (2, 0.0, 2, 0.0, 2, 0.0, 1, 0, 1), (35, 0.3, 1, 1.0, 1, 1.0, 1, 0, 1),
    (2, 0.0, 4, 1.0, 3, 1.0, 1, 0, 1), (7, 0.5, 2, 1.0, 2, 1.0, 1, 0, 1), (1, 1.0, 1, 1.0, 1, 1.0, 1, 0, 1), (12, 0.0, 25, 0.6, 9, 0.4, 1, 0, 1),
    (5, 1.0, 6, 0.9, 30, 0.3, 1, 0, 1), (18, 0.2, 3, 0.8, 4, 0.7, 1, 0, 1), (90, 0.0, 2, 1.0, 5, 0.9, 1, 0, 1), (3, 0.0, 70, 0.2, 14, 0.5, 1, 0, 1),
    (10, 0.9, 60, 0.0, 3, 1.0, 1, 0, 1), (28, 0.0, 0, 0.0, 2, 1.0, 1, 0, 1), (6, 0.7, 8, 0.6, 0, 0.0, 1, 0, 1), (15, 0.0, 15, 1.0, 22, 0.2, 1, 0, 1),
    # Blocks of pages without an article element, as they stand: headings, first, middle, last and the shortest ones.
    (10, 0.0, 8, 0.0, 51, 0.0, 0, 0, 1), (51, 0.0, 10, 0.0, 8, 0.0, 0, 0, 1), (8, 0.0, 51, 0.0, 11, 0.0, 0, 0, 1), (36, 0.0, 11, 0.0, 32, 0.0, 0, 0, 1),
    (25, 0.0, 52, 0.0, 11, 0.0, 0, 0, 1), (9, 0.0, 8, 0.0, 12, 0.0, 0, 0, 1), (12, 0.0, 9, 0.0, 9, 0.0, 0, 0, 1), (39, 0.0, 9, 0.0, 8, 0.0, 0, 0, 1),
    (8, 0.0, 39, 0.0, 20, 0.0, 0, 0, 1), (8, 0.0, 20, 0.0, 8, 0.0, 0, 0, 1), (2, 0.0, 5, 0.0, 2, 0.0, 0, 0, 1), (2, 0.0, 2, 0.0, 11, 0.0, 0, 0, 1),
    (11, 0.0, 8, 0.0, 17, 0.0, 0, 0, 1), (17, 0.0, 11, 0.0, 143, 0.0, 0, 0, 1), (189, 0.0, 31, 0.0, 43, 0.0, 0, 0, 1), (22, 0.0, 51, 0.0, 11, 0.0, 0, 0, 1),
    (8, 0.0, 8, 0.0, 8, 0.0, 0, 0, 1), (8, 0.0, 8, 0.0, 45, 0.0, 0, 0, 1), (1, 0.0, 45, 0.0, 30, 0.0, 0, 0, 1), (47, 0.0, 37, 0.0, 2, 0.0, 0, 0, 1),
    (1, 0.0, 2, 0.0, 15, 0.0, 0, 0, 1), (8, 0.0, 3, 0.0, 14, 0.0, 0, 0, 1), (11, 0.0, 11, 0.0, 65, 0.0, 0, 0, 1), (65, 0.0, 11, 0.0, 57, 0.0, 0, 0, 1),
    (3, 0.0, 21, 0.0, 82, 0.0, 0, 0, 1), (61, 0.0, 31, 0.0, 38, 0.0, 0, 0, 1), (1, 0.0, 41, 0.0, 91, 0.0, 0, 0, 1), (64, 0.0, 102, 0.0, 12, 0.0, 0, 0, 1),
    (7, 0.0, 9, 0.0, 968, 0.0, 0, 0, 1), (968, 0.0, 7, 0.0, 9, 0.0, 0, 0, 1), (9, 0.0, 968, 0.0, 7, 0.0, 0, 0, 1), (6, 0.0, 4, 0.0, 6, 0.0, 0, 0, 1),
    (6, 0.0, 6, 0.0, 10, 0.0, 0, 0, 1), (10, 0.0, 6, 0.0, 15, 0.0, 0, 0, 1), (11, 0.0, 12, 0.0, 149, 0.0, 0, 0, 1), (149, 0.0, 11, 0.0, 46, 0.0, 0, 0, 1),
    (46, 0.0, 149, 0.0, 1, 0.0, 0, 0, 1), (1, 0.0, 46, 0.0, 76, 0.0, 0, 0, 1), (76, 0.0, 1, 0.0, 9, 0.0, 0, 0, 1), (8, 0.0, 6, 0.0, 12, 0.0, 0, 0, 1),
    (12, 0.0, 8, 0.0, 8, 0.0, 0, 0, 1), (3, 0.0, 8, 0.0, 38, 0.0, 0, 0, 1), (36, 0.0, 38, 0.0, 28, 0.0, 0, 0, 1), (6, 0.0, 28, 0.0, 25, 0.0, 0, 0, 1),
    (32, 0.0, 25, 0.0, 13, 0.0, 0, 0, 1), (4, 0.0, 10, 0.0, 4, 0.0, 0, 0, 1), (4, 0.0, 4, 0.0, 47, 0.0, 0, 0, 1), (43, 0.0, 75, 0.0, 95, 0.0, 0, 0, 1),
    (178, 0.0, 49, 0.0, 10, 0.0, 0, 0, 1), (5, 0.0, 7, 0.0, 5, 0.0, 0, 0, 1), (5, 0.0, 5, 0.0, 15, 0.0, 0, 0, 1),
    # Lists, captions, linked passages and whole pages of one or two blocks, without an article element.
    (2, 0.0, 0, 0.0, 0, 0.0, 0, 0, 1), (1, 0.0, 0, 0.0, 40, 0.0, 0, 0, 1), (3, 0.0, 1, 0.0, 40, 0.0, 0, 0, 1), (1, 0.0, 40, 0.0, 40, 0.0, 0, 0, 1),
    (5, 0.0, 6, 0.0, 4, 0.0, 0, 0, 1), (4, 0.0, 30, 0.0, 5, 0.0, 0, 0, 1), (3, 0.0, 4, 0.0, 0, 0.0, 0, 0, 1), (2, 0.0, 2, 0.0, 2, 0.0, 0, 0, 1),
    (6, 0.0, 1, 1.0, 45, 0.0, 0, 0, 1), (9, 0.0, 60, 0.0, 1, 1.0, 0, 0, 1), (18, 0.1, 50, 0.0, 35, 0.0, 0, 0, 1), (22, 0.2, 25, 0.0, 90, 0.0, 0, 0, 1),
    (33, 0.3, 2, 1.0, 41, 0.0, 0, 0, 1), (60, 0.2, 90, 0.0, 3, 0.8, 0, 0, 1), (80, 0.4, 30, 0.0, 40, 0.1, 0, 0, 1), (12, 0.3, 70, 0.0, 80, 0.0, 0, 0, 1),
    (45, 0.0, 1, 1.0, 1, 1.0, 0, 0, 1), (25, 0.1, 1, 1.0, 2, 1.0, 0, 0, 1), (14, 0.4, 55, 0.1, 30, 0.0, 0, 0, 1), (28, 0.0, 0, 0.0, 0, 0.0, 0, 0, 1),
    (3, 0.0, 60, 0.0, 2, 1.0, 0, 0, 1), (2, 0.0, 40, 0.0, 1, 1.0, 0, 0, 1), (5, 0.0, 12, 0.0, 3, 1.0, 0, 0, 1), (2, 0.0, 4, 0.0, 1, 1.0, 0, 0, 1),
    # What isn't content where no mark says so: linked blocks, and short ones among linked blocks.
    (1, 1.0, 0, 0.0, 1, 1.0, 0, 0, 0), (1, 1.0, 1, 1.0, 1, 1.0, 0, 0, 0), (2, 1.0, 3, 1.0, 2, 1.0, 0, 0, 0), (1, 1.0, 1, 1.0, 40, 0.0, 0, 0, 0),
    (5, 0.9, 2, 1.0, 40, 0.0, 0, 0, 0), (12, 0.8, 70, 0.0, 10, 0.9, 0, 0, 0), (40, 0.7, 4, 1.0, 6, 1.0, 0, 0, 0), (4, 1.0, 60, 0.0, 0, 0.0, 0, 0, 0),
    (25, 0.6, 30, 0.0, 8, 0.8, 0, 0, 0), (7, 0.6, 90, 0.0, 6, 0.7, 0, 0, 0), (15, 0.7, 12, 0.6, 20, 0.7, 0, 0, 0), (2, 1.0, 2, 0.0, 2, 1.0, 0, 0, 0),
    (1, 0.0, 2, 1.0, 2, 1.0, 0, 0, 0), (3, 0.0, 1, 1.0, 1, 1.0, 0, 0, 0), (2, 0.0, 3, 0.9, 4, 0.9, 0, 0, 0), (4, 0.0, 2, 1.0, 3, 1.0, 0, 0, 0),
    (6, 0.2, 3, 1.0, 2, 0.8, 0, 0, 0), (3, 0.3, 5, 0.9, 1, 1.0, 0, 0, 0), (60, 0.8, 20, 0.0, 35, 0.0, 0, 0, 0), (3, 0.7, 50, 0.0, 50, 0.0, 0, 0, 0),
)


@dataclass
class Tree:
    """A split of one feature, or a leaf (``feature`` is None) with the share of content."""

    share: float
    feature: int | None = None
    at: float = 0.0
    low: Tree | None = None
    high: Tree | None = None

    def content(self, x: tuple[float, ...]) -> bool:
        node = self
        while node.feature is not None:
            node = node.low if x[node.feature] <= node.at else node.high
        return node.share > 0.5


def grow(rows: tuple[tuple[float, ...], ...], depth: int = 6) -> Tree:
    """A decision tree by least Gini impurity; equal splits go to the later feature, the marks of place."""
    share = sum(r[-1] for r in rows) / len(rows)
    best = None
    if depth and 0 < share < 1:
        for f in range(len(FEATURES)):
            values = sorted({r[f] for r in rows})
            for a, b in zip(values, values[1:], strict=False):
                at = (a + b) / 2
                sides = [[r[-1] for r in rows if (r[f] <= at) == left] for left in (True, False)]
                impurity = sum(len(s) * (p := sum(s) / len(s)) * (1 - p) for s in sides)
                if best is None or impurity <= best[0]:
                    best = (impurity, f, at)
    if best is None:
        return Tree(share)
    _, f, at = best
    low, high = (tuple(r for r in rows if (r[f] <= at) == left) for left in (True, False))
    return Tree(share, f, at, grow(low, depth - 1), grow(high, depth - 1))


def main_text(html: str | None, tree: Tree) -> str:
    """The content blocks of a page in page order, joined by two newlines."""
    found = list(blocks(html or ""))
    if not found:
        return ""
    none = Block("", 0, 0.0, 0, 0)
    kept = []
    for before, own, after in zip([none, *found[:-1]], found, [*found[1:], none], strict=True):
        if tree.content((own.words, own.density, before.words, before.density, after.words, after.density, own.article, own.furniture)):
            kept.append(own.text)
    return "\n\n".join(kept)


def extracted(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages`` (page_id, url, html), in one pass without a shuffle.

    NULL or empty html, and pages without content, give an empty text; broken markup is read as far as it goes; equal
    rows give equal results; other columns are ignored.
    """
    tree = grow(LABELLED)

    def extract(batches):
        for batch in batches:
            texts = [main_text(h, tree) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    source = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    found = source.mapInArrow(extract, "page_id long, url string, text string")
    return found.withColumn("n_chars", F.length("text").cast("long"))
