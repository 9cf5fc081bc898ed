from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from siteledger.functions import address, contacts, dates, geo, payload, rules, similarity, text, web
from siteledger.functions.html import parse_page

X = F.col("x")


def test_text(values):
    assert values(["o'neil mc-donald", "SAN JOSE", "", None], text.title_case(X)) == ["O'Neil Mc-Donald", "San Jose", "", None]
    assert values(["  a\n b  "], text.squeeze(X)) == ["a b"]
    assert values(["A & B  Co", ""], text.company_key(X)) == ["a and b co", None]
    assert values([" OWNER ", "000000", " 123 ", ""], text.clean_license(X)) == [None, None, "123", None]
    assert values(["Mountain  View!", "-x-"], text.slug(X)) == ["mountain-view", "x"]
    assert values(["x" * 301, "x" * 300], F.length(text.cap_text(X))) == [301, 300]
    assert values(["a", ""], text.first_present(X, F.lit("z"))) == ["a", "z"]
    assert values([" 1 ", ""], text.address_parts(X, F.lit(None), F.lit("Oak "))) == ["1 Oak", "Oak"]


def test_dates(values):
    given = [
        "2026-05-10T00:00:00.000", "2026/5/1", "05/09/2026 01:02:03 PM", "5/9/2026", "soon maybe", "", None, "2026-13-40",
    ]
    assert values(given, dates.date_only(X)) == [
        "2026-05-10", "2026-05-01", "2026-05-09", "2026-05-09", "soon", None, None, "2026-13-40",
    ]
    assert [str(d) if d else None for d in values(given, dates.parse_date(X))] == [
        "2026-05-10", "2026-05-01", "2026-05-09", "2026-05-09", None, None, None, None,
    ]
    week = dates.iso_week(X)
    assert values(["2027-01-01T05:00:00", "junk", None], week["key"], week["monday"], week["label"]) == [
        ("2026-W53", "2026-12-28", "12/28–1/3"), ("unknown", "", "未知日期"), ("unknown", "", "未知日期"),
    ]
    assert values(["2026-06-11", "2026-06-10", None], dates.is_new(X, "2026-06-18", 7)) == [True, False, False]
    assert values(["1778371200000", "n/a"], dates.epoch_ms_day(X)) == ["2026-05-10", "n/a"]
    assert values(["2026-05-10T01:00:00", "x"], dates.us_date(X)) == ["05/10/2026", "x"]


def test_fetch_window(spark):
    rows = [("2026-01-01", None), (None, "2026-05-01"), (None, None), (None, "2020-01-01")]
    df = spark.createDataFrame(rows, "e string, w string")
    today = F.lit("2026-06-18").cast("date")
    since = dates.fetch_since(F.col("e"), F.col("w"), today, F.lit(30))
    assert [r[0] for r in df.select(since).collect()] == ["2026-01-01", "2026-05-01", "2026-05-19", "2020-01-01"]
    limited = dates.fetch_since(F.col("e"), F.col("w"), today, F.lit(300), 90)
    assert [r[0] for r in df.select(limited).collect()] == ["2026-01-01", "2026-05-01", "2026-03-20", "2026-03-20"]


def test_contacts(values):
    assert values(["415-555-1212 x9", "14155551212", "555", "", None], contacts.clean_phone(X)) == [
        "415-555-1212 x9", "(415) 555-1212", "555", None, None,
    ]
    assert values(["call (415) 555-1212 now", "4155551212", "none"], contacts.extract_phone(X)) == [
        "(415) 555-1212", "(415) 555-1212", None,
    ]
    assert values(["a Bob@X.co, b", "no"], contacts.extract_email(X)) == ["Bob@X.co", None]
    assert values(["00492944", "A123", "123456789", "0", ""], contacts.normalize_license(X)) == ["492944", None, None, None, None]
    assert values(["subcontractor", "architect", "x"], contacts.contact_rank(X)) == [0, 3, 5]


def test_best_contact(spark):
    rows = [
        ([{"role": "Owner", "first_name": "Jane", "last_name": "Doe"},
          {"role": "Contractor", "firm_name": "Acme Builders Inc", "license1": "492944", "phone": "4155551212"}],),
        ([{"role": "owner", "first_name": "Jo", "last_name": "Li"}],),
        ([{"role": "Architect", "firm_name": "Plan Co"}, {"role": "Engineer", "firm_name": "Eng Co", "license1": "1"}],),
        ([{"role": "contractor", "first_name": "Al", "last_name": "B"},
          {"role": "contractor", "firm_name": "Firm", "note": "mail me@firm.com"}],),
        ([],),
    ]
    df = spark.createDataFrame(rows, "c array<map<string,string>>")
    best = [r[0] for r in df.select(contacts.best_contact(F.col("c"))).collect()]
    assert tuple(best[0]) == ("Acme Builders Inc", "492944", None, "(415) 555-1212")
    assert best[1] is None and best[4] is None
    assert best[2]["name"] == "Plan Co"
    assert (best[3]["name"], best[3]["email"]) == ("Firm", "me@firm.com")


def test_address(values):
    norm = address.normalize_address(X)
    assert values(
        ["123 Main Street, Suite 200", "123 North Main Avenue", "123 Oak Avenue #1", None, "", "500 Market St Ste. B-2"], norm
    ) == ["123 main st unit 200", "123 n main ave", "123 oak ave unit 1", "", "", "500 market st unit b 2"]
    assert values(["123 Oak Ave", "San Francisco, California", "", "#!"], address.block_key(norm)) == [
        "123:oak", ":san", "", "",
    ]


def test_rules(values):
    c = rules.classify(X)
    assert values(
        ["Tenant improvement for a new restaurant kitchen", "Replace existing window in kind", "New R&D space", "cafés"],
        c["category"], c["reason"],
    ) == [
        ("RESTAURANT_RETAIL", r"Matched \brestaurant\b"),
        ("OTHER", "No high-confidence rule matched"),
        ("OFFICE_LAB", r"Matched \br&d\b"),
        ("OTHER", "No high-confidence rule matched"),
    ]


def test_regions(spark):
    rows = [
        ("San Francisco", None, "CA", True), ("St. Helena", None, None, True), ("Richmond", None, "VA", False),
        ("LINDA", "94035", "CA", True), ("Fresno", "93701", "CA", False), (None, None, None, False),
    ]
    df = spark.createDataFrame(rows, "c string, z string, s string, want boolean")
    got = df.select("want", geo.in_region(F.col("c"), F.col("z"), F.col("s"), geo.NINE_COUNTY).alias("got")).collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]
    assert len(geo.NINE_COUNTY.cities) == 105 and "st helena" in geo.NINE_COUNTY.cities
    near = df.limit(1).select(
        geo.in_region(F.lit("Santa Cruz"), F.lit(None), F.lit("ca"), geo.SAN_JOSE_RADIUS),
        geo.region_predicate("San-Jose-50mi", F.lit("Napa"), F.lit(None), F.lit(None)),
        geo.region_predicate("NV", F.lit("x"), F.lit(None), F.lit("NV")),
        geo.region_predicate("unknown-place", F.lit("x"), F.lit(None), F.lit(None)),
        geo.place_state(F.lit(None), F.lit("1 A St, Reno, NV 89501"), F.lit(None)),
        geo.place_zip(F.lit(""), F.lit("x"), F.lit("CA 94035")),
    ).first()
    assert list(near) == [True, False, True, True, "NV", "94035"]


def test_website_names(values):
    tokens = web.company_tokens(X)
    assert values(["Acme & Sons Builders, Inc.", "The Co"], tokens) == [["acme", "and", "sons", "builders"], []]
    assert values(["Acme Builders Inc", "GCI", "Turner"], web.site_candidates(X)) == [
        ["https://acmebuilders.com", "https://www.acmebuilders.com", "https://acme-builders.com", "https://www.acme-builders.com"],
        [],
        ["https://turner.com", "https://www.turner.com"],
    ]
    assert values(["Example.com/", " HTTP://A.com/b/?q=1#x", "", "https:///x", "a.com/p;v=1"], web.normalize_website(X)) == [
        "https://example.com", "http://a.com/b", None, None, "https://a.com/p",
    ]
    assert values(["https://a.com/x"], web.candidate_urls(X)) == [
        ["https://a.com/x", "https://a.com/contact", "https://a.com/contact-us", "https://a.com/about", "https://a.com/about-us"]
    ]


def test_site_match(spark):
    rows = [
        ("Acme Builders", "welcome to acme", "https://acmebuilders.com", True),
        ("Acme Builders", "welcome to acme", "https://other.com", False),
        ("Acme Builders", "acme are builders", "https://other.com", True),
        ("Turner", "nothing", "https://turner.com", False),
        ("Inc", "inc", "https://inc.com", False),
    ]
    df = spark.createDataFrame(rows, "n string, t string, u string, want boolean")
    got = df.select("want", web.page_matches(web.company_tokens(F.col("n")), F.col("t"), F.col("u")).alias("got")).collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]


def test_page_contacts(spark):
    html = (
        '<p>x</p><script>a@hidden.com</script><style>b@hidden.com</style><a href="mailto:Sales%40acme.com?subject=hi">m</a>'
        '<a href="tel:+1-415-555-1212">call</a><a href="/contact/?x=1">c</a><a href="https://else.com/about">e</a>'
        '<a href="about-us">a</a><p>write logo@2x.png or info@acme.com</p>'
    )
    page = parse_page(html, "https://acme.com", web.LINK_HINTS, 4)
    assert "hidden" not in page["text"]
    assert page["links"] == ["https://acme.com/contact", "https://acme.com/about-us"]
    df = spark.createDataFrame([(page["text"], page["hrefs"]), (page["text"], [])], "t string, h array<string>")
    got = [tuple(r) for r in df.select(web.page_email(F.col("t"), F.col("h")), web.page_phone(F.col("t"), F.col("h"))).collect()]
    assert got == [("Sales@acme.com", "(415) 555-1212"), ("info@acme.com", None)]


def slow_score(a: str, b: str) -> float:
    """Independent reading of the published definition, with a table for the distance."""
    ta, tb = set(a.split()), set(b.split())
    if not ta or not tb:
        return 0.0
    common, x, y = sorted(ta & tb), sorted(ta - tb), sorted(tb - ta)
    if common and (not x or not y):
        return 100.0
    s, xs, ys = " ".join(common), " ".join(x), " ".join(y)
    table = [[0] * (len(ys) + 1) for _ in range(len(xs) + 1)]
    for i, p in enumerate(xs):
        for j, q in enumerate(ys):
            table[i + 1][j + 1] = table[i][j] + 1 if p == q else max(table[i][j + 1], table[i + 1][j])
    la = len(s) + bool(s) + len(xs)
    lb = len(s) + bool(s) + len(ys)
    best = 100 - 100 * (len(xs) + len(ys) - 2 * table[-1][-1]) / (la + lb)
    if s:
        best = max(best, 100 - 100 * (1 + len(xs)) / (len(s) + la), 100 - 100 * (1 + len(ys)) / (len(s) + lb))
    return best


def test_token_set_score():
    score = similarity.token_set_score
    assert score("500 market st unit 200", "500 market st unit 450") == pytest.approx(90.909, abs=1e-2)
    assert score("Reroof single family residence", "Re-roof single family residence") == pytest.approx(98.36, abs=1e-2)
    assert score("", "a") == 0 and score(" ", " ") == 0 and score("a b", "b") == 100
    rng = random.Random(7)
    words = ["roof", "re-roof", "kitchen", "kitchens", "new", "a", "bb", "unit", "12", "123", "über", "remodel"]
    for _ in range(3000):
        a = " ".join(rng.choices(words, k=rng.randint(0, 6)))
        b = " ".join(rng.choices(words, k=rng.randint(0, 6)))
        assert score(a, b) == pytest.approx(slow_score(a, b), abs=1e-9)


def test_payload_paths(spark):
    docs = [
        ('{"result": {"records": [{"a": 1}, 5, {"a": 2}]}}', "result.records", 3),
        ('{"data": [{"a": 1}]}', None, 1),
        ('[{"a": 1}, {"a": 2}]', None, 2),
        ('{"x": [{"rows": [{"a": 1}]}]}', "x.0", 1),
        ('{"x": 1}', "x", None),
        ("not json", None, None),
    ]
    for doc, path, size in docs:
        df = spark.createDataFrame([(doc,)], "d string")
        got = df.select(F.size(payload.record_list(F.try_parse_json("d"), path))).first()[0]
        assert got == size or (size is None and got in (None, -1))
    df = spark.createDataFrame([('{"b":1,"a":null}', '{"a":null,"b":1}')], "p string, q string")
    assert df.select(payload.content_hash(F.col("p")) == payload.content_hash(F.col("q"))).first()[0]
