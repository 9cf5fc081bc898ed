"""Ordered keyword rules -> category."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from siteledger.schemas import OTHER

Rule = tuple[str, float, Sequence[str]]

# Default rules in priority order (category, confidence, whole words).
DEFAULT_RULES: tuple[Rule, ...] = (
    ("PUBLIC_WORKS", 0.9, ("street", "sidewalk", "sewer", "utility", "public works")),
    ("HOSPITALITY_REMODEL", 0.88, ("hotel", "motel", "hospitality")),
    ("RESTAURANT_RETAIL", 0.86, ("restaurant", "retail", "cafe", "bar", "kitchen")),
    ("OFFICE_LAB", 0.84, ("office", "lab", "laboratory", "r&d")),
    ("COMMERCIAL_TI", 0.82, ("tenant improvement", "ti", "commercial", "storefront")),
    ("RESIDENTIAL_REMODEL", 0.8, ("remodel", "renovation", "addition", "adu", "residential", "apartment")),
    ("GC_SUBCONTRACT", 0.78, ("subcontract", "structural", "mechanical", "electrical", "plumbing")),
)
FALLBACK_CONFIDENCE = 0.55
FALLBACK_REASON = "No high-confidence rule matched"


def classify(text: Column, rules: Sequence[Rule] = DEFAULT_RULES) -> Column:
    """STRUCT(category, confidence, reason) of the first rule with a whole-word hit.

    One alternation per rule decides the category; the single words are only looked at
    inside the rule that hit, to name the reason.
    """
    lowered = F.lower(text)

    def outcome(category: str, confidence: float, reason: Column) -> Column:
        return F.struct(
            F.lit(category).alias("category"),
            F.lit(float(confidence)).alias("confidence"),
            reason.alias("reason"),
        )

    chain = None
    for category, confidence, words in rules:
        hit = lowered.rlike(r"(?U)\b(?:" + "|".join(words) + r")\b")
        reason = F.coalesce(
            *[F.when(lowered.rlike(rf"(?U)\b{word}\b"), F.lit(rf"Matched \b{word}\b")) for word in words]
        )
        result = outcome(category, confidence, reason)
        chain = F.when(hit, result) if chain is None else chain.when(hit, result)
    fallback = outcome(OTHER, FALLBACK_CONFIDENCE, F.lit(FALLBACK_REASON))
    return fallback if chain is None else chain.otherwise(fallback)


def use_text(description: Column, existing_use: Column | None = None, proposed_use: Column | None = None) -> Column:
    """Text to classify: the description plus the optional existing and proposed use."""
    extra = [F.nullif(c, F.lit("")) for c in (description, existing_use, proposed_use) if c is not None]
    return F.concat_ws(" ", *extra)
