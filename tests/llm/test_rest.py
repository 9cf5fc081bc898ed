"""Fingerprints, mixing, decontamination, token rollups, page text: brute force and odd rows."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import time
from collections import Counter

import pytest

from siteledger.llm import decontaminate, html_blocks, merkle, mixing, token_rollup
from siteledger.session import scratch_path
from tests.llm.fixtures import SCHEMA, documents, sentence, texts


def test_fingerprints(spark):
    rows = texts(5) + [(None, "no id"), (2000, "one line\nand another. And more\n\n" * 3), (2001, "one line\nand another. And more\n\n" * 3)]
    got = {r.doc_id: r for r in merkle.fingerprints(documents(spark, rows)).collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    assert len(got) == len(rows)
    for (d, t), (_, after) in zip(order, [*order[1:], order[0]], strict=True):
        t, after = t or "", after or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        r = got[d]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert (r.fingerprint == r.edited_fingerprint) == (t == edited)
        if t == after:
            assert r.near_next == 1
    prints = {}
    for d, t in rows:
        assert prints.setdefault(t or "", got[d].fingerprint) == got[d].fingerprint
    assert len(set(prints.values())) == len(prints)


def test_fingerprint_locates_the_edit(spark):
    lines = [f"paragraph {i} has some words that stay as they are." for i in range(40)]
    changed = [*lines[:20], "this one is new", *lines[21:]]
    df = spark.createDataFrame([("\n".join(lines), "\n".join(changed))], "a string, b string")
    r = merkle.with_fingerprint(merkle.with_fingerprint(df, "a", "x"), "b", "y").select("x", "y", merkle.likeness("x", "y").alias("like")).first()
    nodes = [set(re.findall(r"[0-9a-f]{16}(?=\()", p)) for p in (r.x, r.y)]
    assert len(nodes[0] - nodes[1]) == 1 and len(nodes[1] - nodes[0]) == 1 and r.like > 0.9


def test_likeness_counts_copies(spark):
    x, y = "the line x has seven words.\n", "a line y of its own words.\n"
    ones = "".join(f"{w}\n" for w in ("one", "two", "six", "ten"))
    pairs = [(x * 1000 + y, x + y * 1000), (x * 20_000, x * 10_000 + y * 10_000), (x * 3 + ones, ones + x), (ones, ones * 2), (x, y), ("\n", "\n\n"), (x, x)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    both = merkle.with_fingerprint(merkle.with_fingerprint(df, "a", "x"), "b", "y")
    got = [r.like for r in both.select("i", merkle.likeness("x", "y").alias("like")).orderBy("i").collect()]
    n, m = len(x) - 1, len(y) - 1
    want = [2 * (n + m) / (1001 * (n + m)), 2 * n / (3 * n + m), 2 * (12 + n) / (24 + 4 * n), 2 * 12 / 36, 0.0, 0.0, 1.0]
    assert all(abs(g - w) < 1e-9 for g, w in zip(got, want, strict=True)), (got, want)


def test_fingerprints_of_few_rows(spark):
    assert merkle.fingerprints(spark.createDataFrame([], SCHEMA)).count() == 0
    one = merkle.fingerprints(documents(spark, [(1, "alone here")])).first()
    assert one.near_next == 1 and one.edited_sha256 == hashlib.sha256(b"alonealone").hexdigest()
    same = merkle.fingerprints(documents(spark, [(1, "twice"), (1, "twice"), (1, "other")])).collect()
    assert len(same) == 3


def _targets(sizes, weights=(3, 1, 2)):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    full, total = set(), 1.5 * sum(sizes.values())
    while True:
        rest = total - sum(2 * sizes[s] for s in full)
        share = sum(weight[s] for s in names if s not in full)
        target = {s: 2.0 * sizes[s] if s in full else rest * weight[s] / share for s in names}
        over = {s for s in names if s not in full and target[s] > 2 * sizes[s] + 1e-9}
        if not over:
            return target
        full |= over


@pytest.mark.parametrize("shard_words", [1 << 17, 200])
def test_mix(spark, shard_words):
    rows = texts(5) + [(None, "no id at all"), (6, "again " * 40), (6, "again " * 40)]
    docs = documents(spark, rows)
    got = mixing.mix(docs, block=16, shard_words=shard_words).collect()
    sizes = Counter()
    for d, t in rows:
        sizes[None if (d or 0) % 5 == 0 else f"s{(d or 0) % 4}"] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    targets = _targets(dict(sizes))
    taken = Counter()
    assert len(got) == len(rows)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(targets[r.source]) and 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    for s, t in targets.items():
        assert abs(taken[s] - t) <= (1 if shard_words > 1000 else 16 + sizes[s] / shard_words * 8)
    again = mixing.mix(docs.repartition(5), block=16, shard_words=shard_words).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0


def test_sainte_lague_seats(spark):
    rng = random.Random(1)
    for seats in (1, 2, 7, 50, 1000):
        votes = [rng.choice([1, 5, 40, 333, 7000]) * rng.random() for _ in range(30)] + [0.0]
        df = spark.createDataFrame([(0, i, v) for i, v in enumerate(votes)], "g int, i int, v double")
        got = {r.i: r.seats for r in mixing.apportion(df, ["g"], ["i"], "v", mixing.F.lit(seats), "seats").collect()}
        want = Counter()
        for _ in range(seats):
            want[max(range(len(votes)), key=lambda i: (votes[i] / (2 * want[i] + 1), -i))] += 1
        assert got == {i: want[i] for i in range(len(votes))}


def test_decontamination(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(3000)]
    item = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = {1: item(40), 2: item(20), 3: item(9), 4: item(3), 5: item(60)}
    swapped = [w if i % 9 else "changed" for i, w in enumerate(items[1])]
    rows = [(10, item(50)), (11, [*item(5), *items[1], *item(5)]), (12, swapped), (13, [*item(30), *items[2][3:18]]), (14, items[3]), (15, items[4] * 5), (16, items[5][:10])]
    text = lambda w: " ".join(w).capitalize() + "."
    docs = documents(spark, [(d, text(w)) for d, w in rows] + [(17, None), (18, ""), (11, text(rows[1][1])), (None, text(items[2]))])
    bench = spark.createDataFrame([(i, text(w), 1) for i, w in items.items()] + [(6, None, 1), (7, "", 1)], "item_id long, text string, doc_id int")
    want = [("11", 1), ("11", 1), ("12", 1), ("13", 2), ("14", 3), ("15", 4), ("None", 2)]
    for block in (decontaminate.BLOCK_TOKENS, 40):
        found = decontaminate.overlaps(docs, bench, block).collect()
        assert sorted((str(r.doc_id), r.item_id) for r in found) == want
    clean = decontaminate.without_overlaps(docs, bench)
    assert clean.columns == docs.columns and sorted(r.doc_id for r in clean.collect()) == [10, 16, 17, 18]
    assert decontaminate.overlaps(docs, bench.limit(0)).count() == 0
    assert decontaminate.overlaps(docs.limit(0), bench).count() == 0


def plainly_overlaps(doc: list[str], item: list[str]) -> bool:
    """The rule of `decontaminate`, tried on every alignment and every stretch."""
    n = len(item)
    for shift in range(-n + 1, len(doc)):
        equal = [0 <= shift + q < len(doc) and doc[shift + q] == item[q] for q in range(n)]
        if 0 <= shift <= len(doc) - n and (all(equal) or (n >= 6 and 5 * sum(equal) >= 4 * n)):
            return True
        low, high = max(0, -shift), min(n, len(doc) - shift)
        for a in range(low, high):
            for b in range(a + 13, high + 1):
                if equal[a] and equal[b - 1] and 5 * sum(equal[a:b]) >= 4 * (b - a):
                    return True
    return False


def test_replaced_tokens_against_brute_force():
    rng = random.Random(3)
    found = {}
    for n in range(1, 21):
        base = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        items = decontaminate.Items.of([1], [" ".join(base)])
        may_differ = 0 if n < 6 else n - -(-4 * n // 5)
        for k in range(may_differ + 2):
            gone = [set(c) for c in itertools.combinations(range(n), k)] if k < 3 else [set(rng.sample(range(n), k)) for _ in range(200)]
            for out in gone:
                own = ["before", *["x" if i in out else w for i, w in enumerate(base)], "after"]
                got = bool(items.overlaps(decontaminate.tokens([" ".join(own).encode()])[0]))
                if k <= may_differ:
                    found.setdefault(n, []).append(got)
                assert got == plainly_overlaps(own, base), (n, out)
    assert all(all(x) for x in found.values()) and len(found) == 20


def test_repeated_tokens_against_brute_force():
    rng = random.Random(4)
    items = [[rng.choice("ab") if rng.random() < 0.8 else "c" for _ in range(rng.choice([2, 5, 7, 11, 13, 18]))] for _ in range(12)]
    items += [["a"] * 16, ["a", "b"] * 8, ["a"] * 8 + ["d", "e", "f", "g", "h", "i", "j", "k"]]
    block = decontaminate.Items.of(list(range(len(items))), [" ".join(i) for i in items])
    for _ in range(60):
        own = [rng.choice("ab") if rng.random() < 0.7 else "c" for _ in range(rng.choice([0, 1, 6, 20, 40]))] + ["a"] * rng.choice([0, 14, 30])
        got = {item: (overlap, same, start, at) for item, overlap, same, start, at in block.overlaps(decontaminate.tokens([" ".join(own).encode()])[0])}
        for i, item in enumerate(items):
            if i in got:
                overlap, same, start, at = got[i]
                assert sum(x == y for x, y in zip(own[start : start + overlap], item[at : at + overlap], strict=True)) == same
            assert (i in got) == plainly_overlaps(own, item), (own, item)


def test_a_million_equal_words():
    began = time.monotonic()
    item = decontaminate.Items.of([1, 2, 3], ["w " * 1000, "w " * 500 + " ".join(f"u{i}" for i in range(500)), "a b " * 300])
    for text in ("w " * 10**6, "w " * 500_000 + " ".join(f"v{i}" for i in range(500_000)), "a b " * 300_000):
        got = item.overlaps(decontaminate.tokens([text.encode()])[0])
        assert {g[0]: g[1:3] for g in got} == ({2: (600, 600)} if text.startswith("a") else {0: (1000, 1000), 1: (500, 500)})
    assert time.monotonic() - began < 60


def test_rollup(spark):
    rows = texts(5, 40) + [(None, "no id"), (6, "again"), (6, "again")]
    docs = documents(spark, rows)
    root = scratch_path(spark, "rollup-test")
    tokenizers = {"w": token_rollup.words, "bpe": token_rollup.byte_pairs()}
    counts = token_rollup.counted(docs, tokenizers)
    gone = counts.where("doc_id % 2 = 0")
    later = token_rollup.counted(docs.where("doc_id % 2 = 1").withColumn("text", mixing.F.lit("two words")), tokenizers)
    token_rollup.commit(token_rollup.inserts(counts), root, 1)
    for _ in range(2):
        token_rollup.commit(token_rollup.deletes(gone), root, 2)
    token_rollup.commit(token_rollup.revisions(counts.where("doc_id % 2 = 1"), later), root, 3)
    got = {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in token_rollup.totals(spark, root, [1, 2, 3, 3]).collect()}
    want: dict = {}
    for d, t in rows:
        if d is not None and d % 2 == 0:
            continue
        own = "two words" if d is not None else t
        key = (None if (d or 0) % 5 == 0 else f"s{(d or 0) % 4}", "en" if (d or 0) % 2 else None)
        for name, f in tokenizers.items():
            n = want.get((*key, name), (0, 0))
            want[(*key, name)] = (n[0] + 1, n[1] + f([own or ""])[0])
    assert got == want
    token_rollup.compact(spark, root, [1, 2, 3], 4)
    assert {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in token_rollup.totals(spark, root, [4]).collect()} == want
    assert token_rollup.totals(spark, root, []).count() == 0
    token_rollup.commit(token_rollup.inserts(token_rollup.counted(spark.createDataFrame([], SCHEMA), tokenizers)), root, 5)
    assert token_rollup.totals(spark, root, [5]).count() == 0


def test_page_text(spark):
    page = (
        '<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script><body class="x"><header><h1>Site</h1></header><nav><ul><li><a href="/a">A</a></ul></nav>'
        '<div class="cookie-notice"><p>We use cookies</p></div><!-- ad --><div class="ad">Buy now, a long advert with many words in it to read</div>'
        '<article><h1>Title &amp; more</h1><p>One &lt;two&gt; <a href="x">three</a>\n four.<p><b>Second<br>line&nbsp;here<p>a < b &#233;<aside>Side</aside><form><label>Name</label><input></form></article>'
        '<section id="comments"><p>Nice post, a long comment with many words indeed here and so on and so on.</p></section><div class="sidebar"><p>side</p></div><footer>&copy; me</footer>'
    )
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (4, "u", "<nav>only</nav>"), (1, "u", page), (5, "u", "<article><p>cut off <b"), (6, "u", "<article><p>" + "word " * 50_000)]
    docs = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, text string")
    got = sorted(((r.page_id, r.text, r.n_chars) for r in html_blocks.extracted(docs).collect()), key=str)
    main = "Title & more\n\nOne <two> three four.\n\nSecond line here\n\na < b é"
    want = [(1, main, len(main)), (1, main, len(main)), (2, "", 0), (3, "", 0), (4, "", 0), (5, "cut off", 7), (6, ("word " * 50_000).strip(), 249_999)]
    assert got == want
    assert html_blocks.extracted(docs.limit(0)).count() == 0


def test_page_without_article():
    tree = html_blocks.grow(html_blocks.LABELLED)
    body = "".join(f"<p>{sentence(random.Random(i), 60)}</p>" for i in range(4))
    page = f'<body><div><a href="/">Home</a> <a href="/x">More</a></div>{body}<div><a href="/y">Next page</a></div>'
    kept = html_blocks.main_text(page, tree)
    assert kept.count("\n\n") == 3 and "Home" not in kept and "Next page" not in kept


def grown_plainly(rows, x, depth=6):
    """The decision for ``x`` by a tree written out anew: at every step all splits of all features are tried."""
    labels = [r[-1] for r in rows]
    if depth == 0 or len(set(labels)) == 1:
        return 2 * sum(labels) > len(labels)
    scored = []
    for f in range(len(x)):
        values = sorted({r[f] for r in rows})
        for at in [(a + b) / 2 for a, b in zip(values, values[1:], strict=False)]:
            parts = [[r[-1] for r in rows if (r[f] > at) == side] for side in (False, True)]
            scored.append((sum(sum(p) * (len(p) - sum(p)) / len(p) for p in parts), -f, -at))
    if not scored:
        return 2 * sum(labels) > len(labels)
    _, f, at = min((round(g, 9), f, at) for g, f, at in scored)
    return grown_plainly([r for r in rows if (r[-f] > -at) == (x[-f] > -at)], x, depth - 1)


def test_tree_agrees_with_a_plain_one():
    tree, rnd = html_blocks.grow(html_blocks.LABELLED), random.Random(8)
    for row in html_blocks.LABELLED:
        assert tree.content(row[:-1]) == bool(row[-1])
    for _ in range(60):
        x = tuple(v for _ in range(3) for v in (rnd.randrange(80), rnd.choice((0.0, 0.2, 0.5, 0.7, 1.0)))) + (rnd.randrange(2), rnd.randrange(2))
        assert tree.content(x) == grown_plainly(html_blocks.LABELLED, x), x


def test_short_blocks_without_article():
    tree, long = html_blocks.grow(html_blocks.LABELLED), sentence(random.Random(4), 40)
    kept = lambda page: html_blocks.main_text(page, tree)
    assert kept("<p>Hello world</p>") == "Hello world"
    assert kept(f"<body><h1>Head</h1><p>One two three.</p><p>{long}</p><p>Four.</p><p>{long}</p>").split("\n\n") == ["Head", "One two three.", long, "Four.", long]
    assert kept(f"<h2>Steps</h2><p>{long}</p><ul><li>One</li><li>Two more</li></ul><p>The end.</p>").split("\n\n") == ["Steps", long, "One", "Two more", "The end."]
    menu = '<ul><li><a href="/a">Home</a></li><li><a href="/b">News of today</a></li></ul>'
    assert kept(f"<div>{menu}</div><div>Topics</div><div>{menu}</div><p>{long}</p><p>The end.</p><div>{menu}</div>").split("\n\n") == [long, "The end."]


def test_given_pages_without_their_article_element(spark):
    tree = html_blocks.grow(html_blocks.LABELLED)
    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()]
    whole = [html_blocks.main_text(h, tree) for h in pages]
    bare = [html_blocks.main_text(re.sub(r"<(/?)article\b", r"<\1div", h), tree) for h in pages]
    same = sum(len(a) for a, b in zip(whole, bare, strict=True) if a == b)
    assert same >= 0.98 * sum(map(len, whole)) > 0


def test_wrappers_of_an_article_are_not_furniture():
    tree = html_blocks.grow(html_blocks.LABELLED)
    kept = lambda page: html_blocks.main_text(page, tree)
    title, one, two = "A title of the text", sentence(random.Random(1), 60), sentence(random.Random(2), 60)
    whole = "\n\n".join((title, one, two))
    article = f'<article><div class="entry-header"><h1>{title}</h1></div><p>{one}</p><p>{two}</p></article>'
    names = ("content no-sidebar", "has-sidebar", "with-sidebar", "long-form", "legal-news", "social", "related", "header", "search", "layout sidebar")
    for start in (*(f'div class="{n}"' for n in names), 'div id="related-work"', "form", "fieldset", "header", 'div style="display:none"', "nav"):
        page = f'<body><nav><a href="/">Home</a></nav><{start}>{article}</{start.split()[0]}><footer>Copyright of all</footer>'
        assert kept(page) == whole, start
    for start in ('h2 class="section-header"', 'h2 id="related-work"', 'p class="legal-news"', 'div class="header"'):
        assert kept(f"<article><{start}>{title}</{start.split()[0]}><p>{one}</p><p>{two}</p></article>") == whole, start
    plain = f"<h1>{title}</h1><p>{one}</p><p>{two}</p>"
    for start in ("form", 'div class="legal"', 'div class="content has-sidebar"'):
        assert kept(f"<body><{start}>{plain}</{start.split()[0]}><footer>Copyright of all</footer>") == whole, start
    assert kept(f"<head><title>T</title>{article}") == whole
    noise = "Words that stand beside the text and are long enough to look like it. " * 8
    for start in ('div class="ad-slot"', 'div class="site-footer"', 'section id="comments"', 'div class="nav-menu"', "aside", "footer", 'div class="sidebar"'):
        end = f"</{start.split()[0]}>"
        assert kept(f"<body>{article}<{start}><p>{noise}</p>{end}") == whole, start
        assert kept(f"<body><article>{plain}<{start}>{noise[:80]}{end}</article>") == whole, start
    comments = "".join(f"<article>{noise}</article>" for _ in range(2))
    assert kept(f'<body><div class="has-comments">{article}<div class="comments">{comments}</div></div>') == whole
    assert kept(f'<body>{article}<div class="related"><article><a href="/x">Read more</a></article></div>') == whole


def test_svg_and_math_take_no_text_along():
    tree = html_blocks.grow(html_blocks.LABELLED)
    kept = lambda inner: html_blocks.main_text(f"<article><p>{inner}</article>", tree)
    for svg in ('<svg class="i"/>', '<svg class="i" />', "<SVG/>", "<svg><title>T</title><text>label</text></svg>", "<svg><style/><title/><path d=''/></svg>", "<svg><svg><desc>x</desc></svg>y</svg>"):
        assert kept(f"one {svg} two</p><p>three") == "one two\n\nthree", svg
        assert kept(f"one {svg} two</p><p>three <svg><g>four</g></svg> five") == "one two\n\nthree five", svg
    assert kept('one <svg class="i"> two</p><p>three') == "one two\n\nthree"
    assert kept('one <svg class="i"> two</p><p>three <svg></svg> four') == "one two\n\nthree four"
    assert kept("one <svg><foreignObject><div>label</div></foreignObject></svg> two") == "one two"
    assert kept("one <svg><foreignObject><div>two</div><p>three") == "one\n\ntwo\n\nthree"
    assert kept("one <math/> two <math><mi>x</mi><mo>=</mo><mn>1</mn></math> three") == "one two x=1 three"
    assert kept('one <math><semantics><mi>x</mi><annotation encoding="application/x-tex">\\alpha</annotation></semantics></math> two') == "one x two"
    assert kept('one <svg aria-hidden="true"><path/></svg> two') == "one two"
