"""Registered queries: keyed upserts, write-backs and classification."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteledger import schemas as S
from siteledger.functions.payload import content_hash
from siteledger.functions.rules import classify
from siteledger.operators import classify as CL
from siteledger.operators import rule_table as RT
from siteledger.operators import upsert as U
from siteledger.plans.tables import ORDERS_SQL, orders_with_customers, table, wide_table

QUERIES = {}
ORACLES = {}

OLD, NOW = "2001-01-01 00:00:00", "2001-07-20 12:00:00"


def _now():
    return F.lit(NOW).cast("timestamp")


def _old():
    return F.lit(OLD).cast("timestamp")


def _raw(df: DataFrame, payload: str) -> DataFrame:
    staged = df.select("source", "source_record_id", F.expr(payload).alias("payload"))
    return S.conform(staged.withColumn("content_hash", content_hash(F.col("payload"))), S.RAW)


def _documents(spark, sf_dir):
    docs = wide_table(spark, sf_dir, "documents", ["doc_id", "text", "source", "lang"])
    labels = table(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id", "left").withColumn("source_record_id", F.col("doc_id").cast("string"))


def upsert_raw_changes(spark, sf_dir):
    """Two crawls of the documents: unlabelled ones are new, low-quality ones have changed."""
    docs = _documents(spark, sf_dir)
    current = _raw(docs.where("quality IS NOT NULL"), "to_json(named_struct('text', text, 'lang', lang))")
    current = current.withColumns({"first_seen": _old(), "last_seen": _old(), "fetched_at": _old(), "changed": F.lit(False)})
    # The same object with its keys in another order is no change.
    incoming = _raw(
        docs.where("toxic IS NULL OR toxic = 0"),
        "to_json(named_struct('lang', CASE WHEN quality = 0 THEN 'xx' ELSE lang END, 'text', text))",
    )
    merged = U.upsert_raw(current, incoming, _now())
    return merged.select(
        "source", "source_record_id", "changed", F.col("first_seen").cast("string").alias("first_seen"),
        F.col("last_seen").cast("string").alias("last_seen"),
    )


QUERIES["upsert_raw_changes"] = upsert_raw_changes
ORACLES["upsert_raw_changes"] = f"""SELECT source, CAST(d.doc_id AS VARCHAR) AS source_record_id,
    CASE WHEN quality IS NULL THEN true WHEN toxic = 0 THEN quality = 0 ELSE false END AS changed,
    CASE WHEN quality IS NULL THEN '{NOW}' ELSE '{OLD}' END AS first_seen,
    CASE WHEN quality IS NULL OR toxic = 0 THEN '{NOW}' ELSE '{OLD}' END AS last_seen
    FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"""


def needs_normalizing(spark, sf_dir):
    """Orders without line items, or flagged changed."""
    raw = table(spark, sf_dir, "orders").selectExpr(
        "'orders' AS source", "CAST(o_orderkey AS STRING) AS source_record_id", "o_orderstatus = 'P' AS changed"
    )
    known = table(spark, sf_dir, "lineitem").selectExpr(
        "'orders' AS source", "CAST(l_orderkey AS STRING) AS source_record_id"
    ).distinct()
    return U.needs_normalizing(raw, known)


QUERIES["needs_normalizing"] = needs_normalizing
ORACLES["needs_normalizing"] = """SELECT 'orders' AS source, CAST(o_orderkey AS VARCHAR) AS source_record_id, o_orderstatus = 'P' AS changed
    FROM orders WHERE o_orderstatus = 'P' OR NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)"""


def _mapped(df: DataFrame, description: str, company: str) -> DataFrame:
    staged = df.selectExpr(
        "'orders' AS source", "CAST(o_orderkey AS STRING) AS source_record_id", "CAST(o_custkey AS STRING) AS permit_number",
        f"{description} AS description", "CAST(CAST(o_orderdate AS DATE) AS STRING) AS project_date", "NULL AS bid_deadline",
        "'1 Main St' AS address", "'Town' AS city", "NULL AS county", "NULL AS source_url", f"{company} AS company_name",
    )
    return staged.withColumn("content_hash", F.sha2("description", 256))


def project_upsert(spark, sf_dir):
    """Known finished orders meet an incoming batch of open and pending ones."""
    orders = table(spark, sf_dir, "orders")
    old = _mapped(orders.where("o_orderstatus IN ('F', 'O')"), "o_orderpriority", "'Acme & Co'")
    current = S.conform(old.withColumn("company_key", F.lit("acme and co")), S.PROJECT).withColumns(
        {
            "category": F.when(F.col("description") == "1-URGENT", "OFFICE_LAB"),
            "confidence": F.when(F.col("description") == "1-URGENT", F.lit(0.84)),
            "status": F.lit("done"), "first_seen": _old(), "last_seen": _old(),
            "duplicate_of": F.when(F.col("description") == "2-HIGH", "7"),
        }
    )
    incoming = _mapped(
        orders.where("o_orderstatus IN ('O', 'P')"), "concat('again ', o_orderpriority)",
        "CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE 'New  Firm' END",
    )
    merged = U.upsert_projects(current, incoming, _now())
    return merged.select(
        "source_record_id", "description", "company_key", "category", "confidence", "status", "duplicate_of",
        F.col("project_day").cast("string").alias("project_day"), F.col("first_seen").cast("string").alias("first_seen"),
        F.col("last_seen").cast("string").alias("last_seen"),
    )


QUERIES["project_upsert"] = project_upsert
ORACLES["project_upsert"] = f"""SELECT CAST(o_orderkey AS VARCHAR) AS source_record_id,
    CASE WHEN o_orderstatus = 'F' THEN o_orderpriority ELSE concat('again ', o_orderpriority) END AS description,
    CASE WHEN o_orderstatus = 'F' THEN 'acme and co' WHEN o_orderpriority <> '5-LOW' THEN 'new firm' END AS company_key,
    CASE WHEN o_orderstatus <> 'P' AND o_orderpriority = '1-URGENT' THEN 'OFFICE_LAB' END AS category,
    CASE WHEN o_orderstatus <> 'P' AND o_orderpriority = '1-URGENT' THEN 0.84::DOUBLE END AS confidence,
    CASE WHEN o_orderstatus = 'F' THEN 'done' ELSE 'new' END AS status,
    CASE WHEN o_orderstatus <> 'P' AND o_orderpriority = '2-HIGH' THEN '7' END AS duplicate_of,
    CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS project_day,
    CASE WHEN o_orderstatus = 'P' THEN '{NOW}' ELSE '{OLD}' END AS first_seen,
    CASE WHEN o_orderstatus = 'F' THEN '{OLD}' ELSE '{NOW}' END AS last_seen FROM orders"""


def _company_rows(spark, sf_dir):
    """Events as sightings of companies, each with some of the contact fields."""
    return table(spark, sf_dir, "events").selectExpr(
        "concat('user ', CAST(user_id AS STRING)) AS company_key",
        "concat('User ', CAST(user_id AS STRING), ' via ', event_type) AS name",
        "CASE WHEN event_type = 'click' THEN CAST(event_id AS STRING) END AS license_number",
        "CASE WHEN event_type = 'view' THEN concat('https://u', CAST(event_id AS STRING), '.com') END AS website",
        "CASE WHEN value > 50 THEN concat('e', CAST(event_id AS STRING), '@x.com') END AS email",
        "CASE WHEN event_type = 'error' THEN concat('(415) 555-', right(CAST(event_id + 10000 AS STRING), 4)) END AS phone",
        "'events' AS source", "CAST(event_id AS STRING) AS source_record_id",
    )


def company_consolidation(spark, sf_dir):
    return U.consolidate_companies(_company_rows(spark, sf_dir))


QUERIES["company_consolidation"] = company_consolidation
_CONSOLIDATED = """concat('user ', user_id) AS company_key, arg_max(concat('User ', user_id, ' via ', event_type), event_id) AS name,
    arg_max(CAST(event_id AS VARCHAR), event_id) FILTER (event_type = 'click') AS license_number,
    arg_max(concat('https://u', event_id, '.com'), event_id) FILTER (event_type = 'view') AS website,
    arg_max(concat('e', event_id, '@x.com'), event_id) FILTER (value > 50) AS email,
    arg_max(concat('(415) 555-', right(CAST(event_id + 10000 AS VARCHAR), 4)), event_id) FILTER (event_type = 'error') AS phone"""
ORACLES["company_consolidation"] = f"SELECT {_CONSOLIDATED} FROM events GROUP BY user_id"


def company_upsert(spark, sf_dir):
    """Known companies meet the sightings: only values that are there overwrite."""
    current = table(spark, sf_dir, "customer").selectExpr(
        "concat('user ', CAST(c_custkey AS STRING)) AS company_key", "c_name AS name", "'L1' AS license_number",
        "NULL AS website", "'old@x.com' AS email", "NULL AS phone", "c_mktsegment AS address",
    )
    current = S.conform(current, S.COMPANY).withColumns({"first_seen": _old(), "updated_at": _old()})
    merged = U.upsert_companies(current, _company_rows(spark, sf_dir), _now())
    return merged.select(
        "company_key", "name", "license_number", "website", "email", "phone", "address",
        F.col("first_seen").cast("string").alias("first_seen"), F.col("updated_at").cast("string").alias("updated_at"),
    )


QUERIES["company_upsert"] = company_upsert
ORACLES["company_upsert"] = f"""WITH n AS (SELECT {_CONSOLIDATED} FROM events GROUP BY user_id),
 o AS (SELECT concat('user ', c_custkey) AS company_key, c_name AS name, 'L1' AS license_number, 'old@x.com' AS email, c_mktsegment AS address FROM customer)
 SELECT coalesce(n.company_key, o.company_key) AS company_key, coalesce(n.name, o.name) AS name,
    coalesce(n.license_number, o.license_number) AS license_number, n.website, coalesce(n.email, o.email) AS email, n.phone, o.address,
    CASE WHEN o.company_key IS NULL THEN '{NOW}' ELSE '{OLD}' END AS first_seen,
    CASE WHEN n.company_key IS NULL THEN '{OLD}' ELSE '{NOW}' END AS updated_at
 FROM o FULL JOIN n ON n.company_key = o.company_key"""


def watermark_upsert(spark, sf_dir):
    """Marks per document source; a source that brings no mark keeps its own."""
    docs = table(spark, sf_dir, "documents")
    current = docs.groupBy("source").agg(F.lit("2000-01-01").alias("watermark"), F.lit(OLD).cast("timestamp").alias("updated_at"))
    brought = F.when((F.col("lang") == "fr") & ~F.col("source").endswith("3"), F.lpad(F.col("doc_id").cast("string"), 12, "0"))
    incoming = docs.groupBy("source").agg(F.max(brought).alias("watermark"))
    return U.upsert_watermarks(current, incoming, _now()).select("source", "watermark", F.col("updated_at").cast("string").alias("updated_at"))


QUERIES["watermark_upsert"] = watermark_upsert
ORACLES["watermark_upsert"] = f"""WITH i AS (SELECT source, max(lpad(CAST(doc_id AS VARCHAR), 12, '0')) AS w FROM documents WHERE lang = 'fr' AND NOT ends_with(source, '3') GROUP BY 1)
    SELECT d.source, coalesce(w, '2000-01-01') AS watermark, CASE WHEN w IS NULL THEN '{OLD}' ELSE '{NOW}' END AS updated_at
    FROM (SELECT DISTINCT source FROM documents) d LEFT JOIN i ON i.source = d.source"""


def _customers(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").selectExpr(
        "CAST(c_custkey AS STRING) AS company_key", "c_name AS name",
        "CASE WHEN c_acctbal > 5000 THEN 'old@x.com' END AS email", "CASE WHEN c_acctbal < 8000 THEN 'old' END AS phone",
        "NULL AS website",
    )
    return S.conform(rows, S.COMPANY).withColumn("updated_at", _old())


def _found(spark, sf_dir):
    return table(spark, sf_dir, "supplier").selectExpr(
        "CAST(s_suppkey AS STRING) AS company_key", "CASE WHEN s_acctbal > 2000 THEN s_name END AS email",
        "CASE WHEN s_acctbal < 4000 THEN 'new' END AS phone", "CASE WHEN s_acctbal > 9000 THEN 'https://s.com' END AS website",
        "s_name AS address", "CASE WHEN s_acctbal > 3000 THEN 'CLEAR' END AS license_status", "'B' AS license_classification",
    )


def contact_write_back(spark, sf_dir):
    columns = ["email", "phone", "website"]
    merged = U.merge_companies(_customers(spark, sf_dir), _found(spark, sf_dir), _now(), columns)
    return merged.select("company_key", *columns, F.col("updated_at").cast("string").alias("updated_at"))


QUERIES["contact_write_back"] = contact_write_back
_BACK = """FROM (SELECT *, CASE WHEN c_acctbal > 5000 THEN 'old@x.com' END AS e, CASE WHEN c_acctbal < 8000 THEN 'old' END AS p FROM customer)
    LEFT JOIN (SELECT *, CASE WHEN s_acctbal > 2000 THEN s_name END AS ne, CASE WHEN s_acctbal < 4000 THEN 'new' END AS np,
      CASE WHEN s_acctbal > 9000 THEN 'https://s.com' END AS nw FROM supplier) ON s_suppkey = c_custkey"""
ORACLES["contact_write_back"] = f"""SELECT CAST(c_custkey AS VARCHAR) AS company_key, coalesce(ne, e) AS email, coalesce(np, p) AS phone,
    nw AS website, CASE WHEN coalesce(ne, np, nw) IS NULL THEN '{OLD}' ELSE '{NOW}' END AS updated_at {_BACK}"""


def contact_fill_empty(spark, sf_dir):
    """The same, but only empty fields are filled; plus the licence fields."""
    columns = ["email", "phone", "website", "address", "license_status", "license_classification"]
    return U.merge_companies(_customers(spark, sf_dir), _found(spark, sf_dir), _now(), columns, fill_only=True).select("company_key", *columns)


QUERIES["contact_fill_empty"] = contact_fill_empty
ORACLES["contact_fill_empty"] = f"""SELECT CAST(c_custkey AS VARCHAR) AS company_key, coalesce(e, ne) AS email, coalesce(p, np) AS phone, nw AS website,
    s_name AS address, CASE WHEN s_acctbal > 3000 THEN 'CLEAR' END AS license_status,
    CASE WHEN s_suppkey IS NOT NULL THEN 'B' END AS license_classification {_BACK}"""

RULES = (
    ("PUBLIC_WORKS", 0.9, ("red", "hot widget")),
    ("HOSPITALITY_REMODEL", 0.88, ("gear", "ring")),
    ("OFFICE_LAB", 0.84, ("small", "cold")),
)
_RULE_SQL = """CASE WHEN regexp_matches({0}, '\\b(red|hot widget)\\b') THEN {1} WHEN regexp_matches({0}, '\\b(gear|ring)\\b') THEN {2}
    WHEN regexp_matches({0}, '\\b(small|cold)\\b') THEN {3} ELSE {4} END"""


def classify_rules(spark, sf_dir):
    result = classify(F.col("p_name"), RULES)
    return table(spark, sf_dir, "part").select("p_partkey", result.alias("r")).select("p_partkey", "r.*")


def _by_word(*words: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(lower(p_name), '\\b{w}\\b') THEN 'Matched \\b{w}\\b'" for w in words) + " END"


QUERIES["classify_rules"] = classify_rules
ORACLES["classify_rules"] = f"""SELECT p_partkey,
    {_RULE_SQL.format('lower(p_name)', "'PUBLIC_WORKS'", "'HOSPITALITY_REMODEL'", "'OFFICE_LAB'", "'OTHER'")} AS category,
    CAST({_RULE_SQL.format('lower(p_name)', '0.9', '0.88', '0.84', '0.55')} AS DOUBLE) AS confidence,
    {_RULE_SQL.format('lower(p_name)', _by_word('red', 'hot widget'), _by_word('gear', 'ring'), _by_word('small', 'cold'),
                      "'No high-confidence rule matched'")} AS reason FROM part"""


def classification_counts(spark, sf_dir):
    """Default rules over whole document texts."""
    docs = wide_table(spark, sf_dir, "documents", ["text"])
    return CL.category_counts(docs.select(classify(F.col("text"))["category"].alias("category")))


QUERIES["classification_counts"] = classification_counts


def _default_sql(text: str) -> str:
    from siteledger.functions.rules import DEFAULT_RULES

    whens = " ".join(
        f"WHEN regexp_matches(lower({text}), '(^|[^a-z0-9_àâäáçéèêëîïíñóôöùûüúß])({'|'.join(words)})($|[^a-z0-9_àâäáçéèêëîïíñóôöùûüúß])') THEN '{category}'"
        for category, _, words in DEFAULT_RULES
    )
    return f"CASE {whens} ELSE 'OTHER' END"


ORACLES["classification_counts"] = f"SELECT {_default_sql('text')} AS category, count(*) AS n FROM documents GROUP BY 1"


def classify_write_back(spark, sf_dir):
    """Only rows still without a category are classified."""
    rows = orders_with_customers(spark, sf_dir).selectExpr(
        "CAST(o_orderkey AS STRING) AS source_record_id", "CASE WHEN o_orderstatus = 'F' THEN 'KEPT' END AS category",
        "CASE WHEN o_orderstatus = 'F' THEN CAST(0.1 AS DOUBLE) END AS confidence", "lower(concat(c_mktsegment, ' office')) AS description",
    )
    return CL.classify_projects(rows, (("PUBLIC_WORKS", 0.9, ("building",)), ("OFFICE_LAB", 0.84, ("office",)))).drop("description")


QUERIES["classify_write_back"] = classify_write_back
ORACLES["classify_write_back"] = f"""SELECT CAST(o_orderkey AS VARCHAR) AS source_record_id,
    CASE WHEN o_orderstatus = 'F' THEN 'KEPT' WHEN c_mktsegment = 'BUILDING' THEN 'PUBLIC_WORKS' ELSE 'OFFICE_LAB' END AS category,
    CAST(CASE WHEN o_orderstatus = 'F' THEN 0.1 WHEN c_mktsegment = 'BUILDING' THEN 0.9 ELSE 0.84 END AS DOUBLE) AS confidence FROM {ORDERS_SQL}"""


def _judge(texts: pd.Series) -> pd.DataFrame:
    if texts.str.contains("hot").any():
        raise ValueError("no answer for this batch")
    found = texts.str.contains("bolt")
    return pd.DataFrame(
        {
            "category": found.map({True: "GC_SUBCONTRACT", False: None}),
            "confidence": found.map({True: 0.7, False: None}).astype("float64"),
            "reason": found.map({True: "judge", False: None}),
        }
    )


def refine_other(spark, sf_dir):
    """A second opinion on the distinct texts left at OTHER; the judge fails on whole batches for single texts."""
    parts = table(spark, sf_dir, "part").select(
        F.lit("part").alias("source"), F.col("p_partkey").cast("string").alias("source_record_id"), F.col("p_name").alias("description"),
        classify(F.col("p_name"), RULES).alias("r"),
    )
    rows = parts.select("source", "source_record_id", "description", "r.*")
    return CL.refine_other(rows, _judge).select("source_record_id", "category", "confidence", "reason")


QUERIES["refine_other"] = refine_other
ORACLES["refine_other"] = f"""WITH c AS ({ORACLES['classify_rules'].replace('SELECT p_partkey,', 'SELECT p_partkey, p_name,', 1)})
    SELECT CAST(p_partkey AS VARCHAR) AS source_record_id,
    CASE WHEN category = 'OTHER' AND contains(p_name, 'bolt') AND NOT contains(p_name, 'hot') THEN 'GC_SUBCONTRACT' ELSE category END AS category,
    CASE WHEN category = 'OTHER' AND contains(p_name, 'bolt') AND NOT contains(p_name, 'hot') THEN 0.7 ELSE confidence END AS confidence,
    CASE WHEN category = 'OTHER' AND contains(p_name, 'bolt') AND NOT contains(p_name, 'hot') THEN 'judge' ELSE reason END AS reason FROM c"""


# Rules of the corpus itself: the first two words of a text are a phrase, its language the category.
_OPENING = "^([A-Za-z]+ [A-Za-z]+)"


def classify_rule_table(spark, sf_dir):
    """Whole document texts by a table of as many phrases as there are opening words."""
    docs = table(spark, sf_dir, "documents")
    opening = F.regexp_extract(F.substring("text", 1, 80), _OPENING, 1)
    rules = docs.select(
        (F.col("doc_id") % 97).alias("rule_no"), F.col("doc_id").alias("phrase_no"), F.coalesce("lang", F.lit("OTHER")).alias("category"),
        (F.lit(0.5) + (F.col("doc_id") % 4) / 8).alias("confidence"), opening.alias("phrase"),
    ).where("phrase <> ''")
    return RT.classify_by_table(docs, ["doc_id"], "text", rules)


QUERIES["classify_rule_table"] = classify_rule_table
ORACLES["classify_rule_table"] = r"""WITH o AS (SELECT doc_id % 97 AS rule_no, doc_id AS phrase_no, coalesce(lang, 'OTHER') AS category, 0.5 + (doc_id % 4) / 8.0 AS confidence,
    lower(regexp_extract(left(text, 80), '^([A-Za-z]+ [A-Za-z]+)', 1)) AS phrase FROM documents),
 p AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_]+') AS w FROM documents),
 g AS (SELECT DISTINCT doc_id, w[i] || w[i + 1] || w[i + 2] AS phrase FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM p)),
 h AS (SELECT g.doc_id, arg_min({'c': category, 'f': confidence, 'p': o.phrase}, (rule_no, phrase_no)) AS r FROM g JOIN o ON g.phrase = o.phrase AND o.phrase <> '' GROUP BY 1)
 SELECT d.doc_id, coalesce(r.c, 'OTHER') AS category, CAST(coalesce(r.f, 0.55) AS DOUBLE) AS confidence,
   coalesce('Matched \b' || r.p || '\b', 'No high-confidence rule matched') AS reason FROM documents d LEFT JOIN h ON d.doc_id = h.doc_id"""
