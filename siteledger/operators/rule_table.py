"""Classification by a table of phrases of any size: one hashed n-gram join instead of a chain of patterns.

A phrase hits where it stands as whole words, as a pattern with word boundaries on both sides does. Texts are cut into
pieces, words and what stands between them; a phrase is a run of pieces that starts and ends with a word, so the runs of
a text that equal a phrase are found by an equi-join. The plan has the same size for seven phrases and for a million.

A filter of the phrases (``page_filter``) is tested beside the scan: only runs that are phrases, and a few by chance, are
shuffled, and texts never are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteledger.functions.rules import FALLBACK_CONFIDENCE, FALLBACK_REASON
from siteledger.operators.page_filter import possibly_wanted
from siteledger.schemas import OTHER

_WORD = r"[\p{L}\p{M}\p{N}_]+"
_PIECE = rf"{_WORD}|[^\p{{L}}\p{{M}}\p{{N}}_]+"


def pieces(text: Column) -> Column:
    """Words of a text and what stands between them, in order and in lower case; joined they are the text."""
    return F.regexp_extract_all(F.lower(text), F.lit(_PIECE), F.lit(0))


def phrases(rules: DataFrame) -> DataFrame:
    """Rules with ``phrase`` in lower case and ``n_pieces``; a phrase that doesn't start and end with a word hits nothing."""
    lowered = rules.withColumn("phrase", F.lower("phrase"))
    whole = F.col("phrase").rlike(rf"^{_WORD}") & F.col("phrase").rlike(rf"{_WORD}$")
    return lowered.where(whole).withColumn("n_pieces", F.size(pieces(F.col("phrase"))))


def rule_hits(rows: DataFrame, key: list[str], text: str, rules: DataFrame) -> DataFrame:
    """The first rule that hits each row: ``key``, category, confidence, phrase. Rows without a hit are left out.

    ``rules`` has rule_no (priority, smaller first), phrase_no (order within a rule), category, confidence and phrase.
    Equal numbers are decided by category, then phrase. NULL and empty texts have no hit.
    """
    known = phrases(rules)
    lengths = sorted(r[0] for r in known.select("n_pieces").distinct().collect())  # a handful: lengths of phrases
    empty = F.array().cast("array<string>")

    def runs(length: int) -> Column:
        last = F.size("_p") - length
        # Every piece starts a run; those that start between words equal no phrase and fall to the filter.
        made = F.transform(F.sequence(F.lit(1), last + 1), lambda i: F.array_join(F.slice("_p", i, length), ""))
        return F.when(last >= 0, made).otherwise(empty)

    cut = rows.select(*key, pieces(F.col(text)).alias("_p"))
    every = F.flatten(F.array(*[runs(n) for n in lengths])) if lengths else empty
    found = cut.select(*key, F.explode(F.array_distinct(every)).alias("page_url"))
    asked = known.select(F.col("phrase").alias("page_url")).distinct()
    likely = possibly_wanted(found, asked).withColumnRenamed("page_url", "phrase")
    # One entry a phrase, the best rule that has it, so a phrase in many rules makes no more rows.
    order = F.struct("rule_no", "phrase_no", "category", "confidence", "phrase")
    best = known.groupBy("phrase").agg(F.min(order).alias("_rule"))
    # The runs of a phrase that every text has pass by the table of phrases unsorted, and are sorted by row, dealt evenly.
    met = likely.join(best.hint("shuffle_hash"), "phrase").select(*key, "_rule").repartition(*key)
    hits = met.groupBy(*key).agg(F.min("_rule").alias("_rule"))
    return hits.select(*key, "_rule.category", "_rule.confidence", "_rule.phrase")


def classify_by_table(rows: DataFrame, key: list[str], text: str, rules: DataFrame) -> DataFrame:
    """(key, category, confidence, reason) for every row by the first rule of the table that hits its text."""
    hits = rule_hits(rows, key, text, rules)
    missed = F.col("phrase").isNull()
    return rows.select(*key).join(hits, key, "left").select(
        *key,
        F.coalesce("category", F.lit(OTHER)).alias("category"),
        F.coalesce("confidence", F.lit(FALLBACK_CONFIDENCE)).alias("confidence"),
        F.when(missed, FALLBACK_REASON).otherwise(F.concat(F.lit(r"Matched \b"), "phrase", F.lit(r"\b"))).alias("reason"),
    )
