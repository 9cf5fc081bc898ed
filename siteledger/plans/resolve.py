"""Registered queries: regions, addresses, similarity and duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteledger.functions import address as A
from siteledger.functions import geo
from siteledger.functions.similarity import token_set_similarity
from siteledger.operators import dedupe as D
from siteledger.operators import dedupe_state as S
from siteledger.plans.tables import ORDERS_SQL, orders_with_customers, table, wide_table
from siteledger.session import scratch_path

QUERIES = {}
ORACLES = {}

REGION = geo.Region(("nation3", "nation10"), ((100, 249), (900, 950)), "CA")
_PLACE = {
    "city": "n_name",
    "zip": "concat('zone ', lpad(CAST(c_custkey AS STRING), 5, '0'), ' x')",
    "state": "CASE WHEN c_mktsegment = 'BUILDING' THEN 'ca' WHEN c_mktsegment = 'MACHINERY' THEN NULL WHEN c_mktsegment = 'HOUSEHOLD' THEN '' ELSE 'NV' END",
}


def region_filter(spark, sf_dir):
    customer, nation = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    places = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).selectExpr("c_custkey", *[f"{e} AS {n}" for n, e in _PLACE.items()])
    return places.where(geo.in_region(F.col("city"), F.col("zip"), F.col("state"), REGION)).select("c_custkey")


QUERIES["region_filter"] = region_filter
ORACLES["region_filter"] = """SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey
    WHERE c_mktsegment IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD') AND c_custkey <= 99999
      AND (c_custkey BETWEEN 100 AND 249 OR c_custkey BETWEEN 900 AND 950 OR n_name IN ('NATION_3', 'NATION_10'))
    UNION ALL SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey
    WHERE c_mktsegment IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD') AND c_custkey > 99999 AND n_name IN ('NATION_3', 'NATION_10')"""

_ADDRESS = (
    "concat(CASE WHEN c_acctbal < 1000 THEN 'North ' ELSE '' END, CASE WHEN c_acctbal > 9000 THEN '' ELSE CAST(c_custkey AS STRING) END, ' ', n_name, "
    "CASE WHEN c_mktsegment = 'BUILDING' THEN ' Street, Suite 2-B' WHEN c_mktsegment = 'MACHINERY' THEN ' Avenue #7' "
    "WHEN c_mktsegment = 'HOUSEHOLD' THEN ' Boulevard apt. 12' ELSE ' Terrace (rear)' END)"
)


def address_blocks(spark, sf_dir):
    customer, nation = wide_table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    rows = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).selectExpr("c_custkey", f"{_ADDRESS} AS address")
    normal = rows.withColumn("normal", A.normalize_address(F.col("address")))
    return normal.select("c_custkey", "normal", A.block_key(F.col("normal")).alias("block"))


QUERIES["address_blocks"] = address_blocks
ORACLES["address_blocks"] = f"""WITH a AS (SELECT c_custkey, regexp_replace(lower({_ADDRESS}),
      '(?:#|\\b(?:suite|ste|unit|apt|apartment)\\b)\\.?\\s*([\\w-]+)', ' unit \\1 ', 'g') AS t FROM customer JOIN nation ON c_nationkey = n_nationkey),
 n AS (SELECT c_custkey, array_to_string(list_transform(regexp_extract_all(t, '[a-z0-9]+'), lambda w:
      CASE w WHEN 'street' THEN 'st' WHEN 'avenue' THEN 'ave' WHEN 'boulevard' THEN 'blvd' WHEN 'terrace' THEN 'ter' WHEN 'north' THEN 'n' ELSE w END), ' ') AS normal FROM a)
 SELECT c_custkey, normal, coalesce(list_filter(string_split(normal, ' '), lambda w: regexp_full_match(w, '[0-9]+'))[1], '') || ':' ||
   left(coalesce(list_filter(string_split(normal, ' '), lambda w: regexp_full_match(w, '[a-z]+'))[1], ''), 4) AS block FROM n"""

# Token-set score in SQL: the distance comes from a table filled cell by cell.
_SETS = """list_sort(list_distinct(string_split_regex(trim({0}), '\\s+')))"""


def score_ctes(pairs: str) -> str:
    """CTEs giving ``scored(a, b, score)`` for the distinct text pairs of the relation ``pairs(a, b)``."""
    return f"""
 tok AS (SELECT DISTINCT a, b, {_SETS.format('a')} AS ta, {_SETS.format('b')} AS tb FROM {pairs}),
 dif AS (SELECT a, b, array_to_string(list_filter(ta, lambda t: NOT list_contains(tb, t)), ' ') AS x,
   array_to_string(list_filter(tb, lambda t: NOT list_contains(ta, t)), ' ') AS y,
   array_to_string(list_filter(ta, lambda t: list_contains(tb, t)), ' ') AS s,
   length(array_to_string(ta, ' ')) AS la, length(array_to_string(tb, ' ')) AS lb FROM tok),
 todo AS (SELECT DISTINCT x, y FROM dif WHERE x <> '' AND y <> ''),
 cell(x, y, i, j, above, here) AS (
   SELECT x, y, 1, 1, list_transform(range(length(y) + 1), lambda k: 0), [0] FROM todo
   UNION ALL
   SELECT x, y, CASE WHEN j = length(y) THEN i + 1 ELSE i END, CASE WHEN j = length(y) THEN 1 ELSE j + 1 END,
     CASE WHEN j = length(y) THEN list_append(here, v) ELSE above END, CASE WHEN j = length(y) THEN [0] ELSE list_append(here, v) END
   FROM (SELECT *, CASE WHEN substr(x, i, 1) = substr(y, j, 1) THEN above[j] + 1 ELSE greatest(above[j + 1], here[j]) END AS v
     FROM cell WHERE i <= length(x))),
 lcs AS (SELECT x, y, above[length(y) + 1] AS n FROM cell WHERE i = length(x) + 1),
 scored AS (SELECT a, b, CASE WHEN trim(a) = '' OR trim(b) = '' THEN 0.0 WHEN s <> '' AND (x = '' OR y = '') THEN 100.0
   ELSE greatest(100 - 100 * (length(x) + length(y) - 2 * coalesce(n, 0))::DOUBLE / (la + lb),
     CASE WHEN s <> '' THEN 100 - 100 * (la - length(s))::DOUBLE / (length(s) + la) ELSE 0 END,
     CASE WHEN s <> '' THEN 100 - 100 * (lb - length(s))::DOUBLE / (length(s) + lb) ELSE 0 END) END AS score
   FROM dif LEFT JOIN lcs USING (x, y))"""


_PART_A, _PART_B = "p_name", "concat(lower(p_type), ' ', split_part(p_name, ' ', 2), 's ', split_part(p_name, ' ', 1))"


def similarity_scores(spark, sf_dir):
    parts = wide_table(spark, sf_dir, "part").selectExpr("p_partkey", f"{_PART_A} AS a", f"{_PART_B} AS b")
    return parts.select("p_partkey", F.round(token_set_similarity(F.col("a"), F.col("b")), 6).alias("score"))


QUERIES["similarity_scores"] = similarity_scores
ORACLES["similarity_scores"] = f"""WITH RECURSIVE p AS (SELECT p_partkey, {_PART_A} AS a, {_PART_B} AS b FROM part), {score_ctes('p')}
    SELECT p_partkey, round(score, 6) AS score FROM p JOIN scored USING (a, b)"""

_RECORD = {
    "id": "o_orderkey",
    "description": "CASE WHEN o_orderstatus = 'P' THEN CAST(CAST(o_orderdate AS DATE) AS STRING) ELSE concat(o_orderpriority, ' ', o_orderstatus) END",
    "address": "concat(CAST(c_custkey AS STRING), ' ', n_name, ' Street', CASE WHEN o_orderpriority = '5-LOW' THEN ' #1' "
    "WHEN o_orderpriority = '2-HIGH' THEN ', Suite 22' ELSE '' END)",
    "source": "lower(o_orderstatus)",
    "has_company": "o_totalprice > 200000",
    "first_seen": "CAST(CAST(o_orderdate AS DATE) AS STRING)",
}


def dedupe_records(spark, sf_dir) -> DataFrame:
    return orders_with_customers(spark, sf_dir, wide=True).selectExpr(*[f"{e} AS {n}" for n, e in _RECORD.items()])


QUERIES["dedupe_permits"] = lambda spark, sf: D.duplicate_plan(dedupe_records(spark, sf))
_PLAN = f"""r AS (SELECT {', '.join(f'{e} AS {n}' for n, e in _RECORD.items())}, c_custkey AS k,
    concat(c_custkey, ' nation ', split_part(n_name, '_', 2), ' st', CASE WHEN o_orderpriority = '5-LOW' THEN ' unit 1'
      WHEN o_orderpriority = '2-HIGH' THEN ' unit 22' ELSE '' END) AS norm FROM {ORDERS_SQL}),
 pair AS (SELECT p.id AS i, q.id AS j, p.norm AS na, q.norm AS nb, p.description AS da, q.description AS db
   FROM r p JOIN r q ON p.k = q.k AND p.id < q.id),
 texts AS (SELECT na AS a, nb AS b FROM pair UNION SELECT da, db FROM pair), {score_ctes('texts')},
 edge AS (SELECT i, j FROM pair JOIN scored t ON t.a = da AND t.b = db JOIN scored n ON n.a = na AND n.b = nb
   WHERE t.score >= 72 AND n.score >= 92),
 link AS (SELECT i, j FROM edge UNION SELECT j, i FROM edge),
 reach(i, j) AS (SELECT i, j FROM link UNION SELECT reach.i, link.j FROM reach JOIN link ON reach.j = link.i),
 member AS (SELECT i AS id, least(i, min(j)) AS component FROM reach GROUP BY i),
 best AS (SELECT component, arg_min(r.id, (CASE WHEN has_company THEN 0 ELSE 1 END, first_seen, r.id)) AS canonical_id
   FROM member JOIN r USING (id) GROUP BY component),
 plan AS (SELECT id, canonical_id FROM member JOIN best USING (component) WHERE id <> canonical_id)"""
ORACLES["dedupe_permits"] = f"WITH RECURSIVE {_PLAN} SELECT id, canonical_id FROM plan"


def dedupe_stats(spark, sf_dir):
    records = dedupe_records(spark, sf_dir)
    return D.duplicate_stats(records, D.duplicate_plan(records))


QUERIES["dedupe_stats"] = dedupe_stats
ORACLES["dedupe_stats"] = f"""WITH RECURSIVE {_PLAN} SELECT (SELECT count(*) FROM r) AS projects, count(*) AS duplicates,
    count(DISTINCT canonical_id) AS duplicate_groups FROM plan"""


def duplicates_marked(spark, sf_dir):
    """Flags recomputed from scratch over rows that carry an old flag."""
    records = dedupe_records(spark, sf_dir)
    stale = records.select("id", "source").withColumn("duplicate_of", F.lit(-1).cast("bigint"))
    return D.mark_duplicates(stale, D.duplicate_plan(records))


QUERIES["duplicates_marked"] = duplicates_marked
ORACLES["duplicates_marked"] = f"""WITH RECURSIVE {_PLAN} SELECT r.id, r.source, canonical_id AS duplicate_of FROM r LEFT JOIN plan USING (id)"""


def dedupe_parts(spark, sf_dir):
    """Parts as permits of a few crowded blocks: large blocks go through tiles and star contraction."""
    parts = wide_table(spark, sf_dir, "part").selectExpr(
        "p_partkey AS id", "concat(p_name, ' ', lower(p_type), ' ', lower(p_brand), ' lot ', CAST(p_retailprice AS STRING)) AS description",
        "concat('7 ', p_type, ' Street') AS address", "p_retailprice > 1000 AS has_company", "lpad(CAST(p_size AS STRING), 4, '0') AS first_seen",
    )
    return D.duplicate_plan(parts, title_threshold=90.0, tile_rows=256)


QUERIES["dedupe_parts"] = dedupe_parts


def dedupe_delta(spark, sf_dir):
    """Two deliveries: old versions of some records first, at another address or with another title, then all that is new or changed.

    The plan after both is the plan of the records as they are now.
    """
    records = dedupe_records(spark, sf_dir)
    moved, renamed = F.col("id") % 40 == 1, F.col("id") % 40 == 2
    first = records.where("source <> 'o'").union(
        records.where("source = 'o'").where(moved | renamed).withColumns(
            {"address": F.when(moved, F.concat(F.lit("9"), "address")).otherwise(F.col("address")), "description": F.when(renamed, F.lit("an old title")).otherwise(F.col("description"))}
        )
    )
    root = scratch_path(spark, "dedupe-state")
    S.deliver(first, root, buckets=64)
    S.deliver(records.where("source = 'o'"), root, buckets=64)
    return S.current_plan(spark, root)


QUERIES["dedupe_delta"] = dedupe_delta
ORACLES["dedupe_delta"] = ORACLES["dedupe_permits"]
