"""Category assignment over project tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteledger.functions.rules import DEFAULT_RULES, Rule, classify
from siteledger.schemas import OTHER


def classify_projects(projects: DataFrame, rules: Sequence[Rule] = DEFAULT_RULES) -> DataFrame:
    """Fill category and confidence of rows still without one, in one projection."""
    staged = projects.withColumn("_c", F.when(F.col("category").isNull(), classify(F.col("description"), rules)))
    return staged.withColumns(
        {
            "confidence": F.when(F.col("_c").isNull(), F.col("confidence")).otherwise(F.col("_c.confidence")),
            "category": F.coalesce("category", "_c.category"),
        }
    ).drop("_c")


def category_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("category").agg(F.count("*").alias("n"))


def refine_other(
    rows: DataFrame, judge: Callable[[pd.Series], pd.DataFrame], text: str = "description"
) -> DataFrame:
    """Second opinion for rows the rules left at OTHER.

    ``judge`` takes a batch of texts and returns a frame with category, confidence and reason
    (NULL category keeps the rule result). It sees every distinct text, once unless a text of its
    batch makes it fail: then the batch is tried in halves, so only failing texts keep the rule
    result, whatever the batch size.
    """
    columns = ["category", "confidence", "reason"]

    def verdicts_of(texts: pd.Series) -> list[pd.DataFrame]:
        try:
            return [judge(texts)[columns].reset_index(drop=True)]
        except Exception:
            if len(texts) <= 1:
                return [pd.DataFrame({c: [None] * len(texts) for c in columns})]
            half = len(texts) // 2
            return verdicts_of(texts.iloc[:half]) + verdicts_of(texts.iloc[half:])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = verdicts_of(batch[text])
            verdict = pd.DataFrame({c: [x for part in found for x in part[c]] for c in columns}, dtype=object)
            verdict["confidence"] = verdict["confidence"].astype("float64")
            verdict.columns = ["_category", "_confidence", "_reason"]
            yield pd.concat([batch[["_key"]].reset_index(drop=True), verdict], axis=1)

    keyed = rows.withColumn("_key", F.when(F.col("category") == OTHER, F.sha2(F.col(text), 256)))
    distinct = keyed.where("_key is not null").groupBy("_key").agg(F.first(text).alias(text))
    verdicts = distinct.mapInPandas(run, "_key string, _category string, _confidence double, _reason string")
    joined = keyed.join(verdicts, "_key", "left")
    took = F.col("_category").isNotNull()
    out = {
        "category": F.coalesce("_category", "category"),
        "confidence": F.when(took, F.col("_confidence")).otherwise(F.col("confidence")),
    }
    if "reason" in rows.columns:
        out["reason"] = F.when(took, F.col("_reason")).otherwise(F.col("reason"))
    return joined.withColumns(out).select(*rows.columns)
