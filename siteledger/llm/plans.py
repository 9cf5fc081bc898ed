"""Registered queries of the training-data operators, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteledger.llm import clustering, decontaminate, hard_negatives, html_blocks, jaccard, language, lattice, merkle, mixing, quality, sharding, suffix_dedup, token_rollup
from siteledger.session import cut, scratch_path

QUERIES = {}
ORACLES: dict[str, str] = {}


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes that each document repeats from an earlier one."""
    return suffix_dedup.remove_repeats(_documents(spark, sf_dir)).drop("kept")


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component of every document."""
    return jaccard.near_duplicates(_documents(spark, sf_dir))


QUERIES["op1_suffix_dedup"] = op1_suffix_dedup
QUERIES["op7_ngram_jaccard"] = op7_ngram_jaccard


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    return mixing.mix(_documents(spark, sf_dir)).drop("source")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from two thirds of them."""
    held = language.held_out(3, 1)
    docs = _documents(spark, sf_dir)
    model = language.fit(docs, ~held)
    return language.identify(docs.select("doc_id", held.alias("held_out"), "text"), model).drop("text")


QUERIES["op5_mixing"] = op5_mixing
QUERIES["op6_language_id"] = op6_language_id


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merkle fingerprints of every document and of its edited text."""
    return merkle.fingerprints(_documents(spark, sf_dir))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a benchmark item, and where."""
    return decontaminate.overlaps(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES["op2_fingerprints"] = op2_fingerprints
QUERIES["op8_decontamination"] = op8_decontamination


def op4_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document under the lattice model and under the plain word model."""
    return lattice.scores(_documents(spark, sf_dir), language.held_out(7, 2))


QUERIES["op4_lm_scores"] = op4_lm_scores


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from the labels of two thirds of them."""
    held = language.held_out(3, 1)
    docs = _documents(spark, sf_dir)
    net = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~held)
    return quality.scored(docs.select("doc_id", held.alias("held_out"), "text"), net).drop("text")


QUERIES["op3_quality"] = op3_quality


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_blocks.extracted(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES["op10_main_text"] = op10_main_text


def op9_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token totals after inserts of all documents, deletes, revised texts, and batches that come twice.

    Batch 1 inserts every document, batch 2 deletes those whose doc_id ends with 3, batch 3 brings those that end with 5
    with a longer text and batch 4 inserts the deleted ones that end with 13, 33, ... again.
    """
    docs = _documents(spark, sf_dir)
    tokenizers = {"words-1": token_rollup.words, "byte-bpe-50k": token_rollup.byte_pairs()}
    root = scratch_path(spark, "token-rollup")
    counts = cut(token_rollup.counted(docs, tokenizers))
    ends = lambda n, k: F.pmod("doc_id", F.lit(n)) == k
    longer = docs.where(ends(10, 5)).withColumn("text", F.concat_ws(" ", "text", F.lit("appended words")))
    gone, back = token_rollup.deletes(counts.where(ends(10, 3))), token_rollup.inserts(counts.where(ends(20, 13)))
    revised = token_rollup.revisions(counts.where(ends(10, 5)), token_rollup.counted(longer, tokenizers))
    for batch, changes in ((1, token_rollup.inserts(counts)), (2, gone), (3, revised), (2, gone), (4, back), (4, back)):
        token_rollup.commit(changes, root, batch)
    return token_rollup.totals(spark, root, [1, 2, 3, 2, 4, 4])


QUERIES["op9_token_rollup"] = op9_token_rollup


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector; labels of every seventh are off by one."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mined(_vectors(spark, sf_dir).withColumn("label", moved), F.col("vec_id") % 100 == 0)


QUERIES["op11_hard_negatives"] = op11_hard_negatives
ORACLES["op11_hard_negatives"] = """
WITH usable AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), scored AS (
    SELECT a.vec_id AS anchor_id, a.label AS own, b.vec_id, b.label, list_dot_product(a.q, b.q)::BIGINT AS score
    FROM usable a JOIN usable b ON a.vec_id <> b.vec_id
    WHERE a.vec_id % 100 = 0
), positives AS (
    SELECT anchor_id, own, vec_id AS positive_id, score AS positive_score FROM scored WHERE label = own
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), ordered AS (
    SELECT p.anchor_id, p.positive_id, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score,
           row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS rank
    FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND s.label <> p.own
    WHERE 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM ordered WHERE rank <= 10
"""


def op12_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster of every vector after three rounds, with inertia."""
    return clustering.clusters(_vectors(spark, sf_dir))


def _rounds_sql(rounds: int) -> str:
    """One assignment and one move of the centroids per round, then the last assignment."""
    nearest = """assigned{k} AS (
    SELECT vec_id, q, cluster, distance FROM (
        SELECT v.vec_id, v.q, c.cluster, list_dot_product(v.q, v.q) - 2 * list_dot_product(v.q, c.q) + list_dot_product(c.q, c.q) AS distance
        FROM kept v CROSS JOIN centroids{k} c)
    QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY distance, cluster) = 1)"""
    moved = """centroids{n} AS (
    SELECT cluster, list(x ORDER BY place) AS q FROM (
        SELECT cluster, place, floor(sum(x) / count(*)) AS x FROM (
            SELECT cluster, unnest(q) AS x, generate_subscripts(q, 1) AS place FROM assigned{k})
        GROUP BY cluster, place)
    GROUP BY cluster
    UNION ALL SELECT cluster, q FROM centroids{k} WHERE cluster NOT IN (SELECT cluster FROM assigned{k}))"""
    steps = [part for k in range(rounds) for part in (nearest.format(k=k), moved.format(k=k, n=k + 1))]
    return ", ".join([*steps, nearest.format(k=rounds)])


QUERIES["op12_clusters"] = op12_clusters
ORACLES["op12_clusters"] = f"""
WITH kept AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS q FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
), centroids0 AS (
    SELECT (row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1)::INT AS cluster, q FROM kept
    QUALIFY row_number() OVER (ORDER BY sha256('1:' || vec_id)) <= 16
), {_rounds_sql(3)}
SELECT a.vec_id, a.cluster, a.distance::BIGINT AS distance,
       (sum(a.distance) OVER (PARTITION BY a.cluster))::BIGINT AS cluster_inertia, (sum(a.distance) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(list_transform(c.q, lambda x: x::BIGINT), ',')) AS centroid_sha256
FROM assigned3 a JOIN centroids3 c USING (cluster)
"""


def op13_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document; equal texts stand together as far as shards of equal counts allow."""
    return sharding.sharded(_documents(spark, sf_dir))


QUERIES["op13_shards"] = op13_shards
