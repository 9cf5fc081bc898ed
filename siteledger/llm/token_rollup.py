"""Token totals by source, language and tokenizer version, kept up to date by deltas.

A document's counts enter as signed changes: an insert adds, a delete takes away, a revision takes the old count away
and adds the new one (which also moves a document between sources, languages or tokenizer versions). Changes are summed
before they are stored, so a batch is a few rows for each total that it touches, and totals are the sum of all batches.
A batch is written under its number and replaces what an earlier attempt wrote, so delivering it again changes nothing.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VOCABULARY = os.environ.get("BPE_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
# The published splitting pattern of this vocabulary, and the words of the plain count.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
KEYS = ["source", "lang", "tokenizer"]
_DELTA = "source string, lang string, tokenizer string, docs long, tokens long"
_LOADED: dict[str, Callable[[list[str]], list[int]]] = {}


def words(texts: list[str]) -> list[int]:
    return [len(WORD.findall(t)) for t in texts]


def byte_pairs(path: str = VOCABULARY) -> Callable[[list[str]], list[int]]:
    """Counts by a byte-level BPE vocabulary (tiktoken ranks at ``path``, which every executor can read)."""

    def count(texts: list[str]) -> list[int]:
        if path not in _LOADED:
            import tiktoken

            with open(path, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            encoding = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
            _LOADED[path] = lambda group: [len(encoding.encode_ordinary(t)) for t in group]
        return _LOADED[path](texts)

    return count


def counted(docs: DataFrame, tokenizers: dict[str, Callable[[list[str]], list[int]]]) -> DataFrame:
    """(doc_id, source, lang, tokenizer, tokens) for every row of ``docs`` and tokenizer version; NULL texts have 0."""
    names = list(tokenizers)

    def count(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            n = len(texts)
            tokens = [x for name in names for x in tokenizers[name](texts)]
            columns = [pa.chunked_array([batch.column(c)] * len(names)).combine_chunks() for c in ("doc_id", "source", "lang")]
            version = pa.array([name for name in names for _ in range(n)], pa.string())
            yield pa.RecordBatch.from_arrays([*columns, version, pa.array(tokens, pa.int64())], ["doc_id", *KEYS, "tokens"])

    kinds = [F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang")]
    return docs.select(*kinds, "text").mapInArrow(count, "doc_id long, source string, lang string, tokenizer string, tokens long")


def inserts(counts: DataFrame) -> DataFrame:
    return counts.select(*KEYS, F.lit(1).cast("long").alias("docs"), "tokens")


def deletes(counts: DataFrame) -> DataFrame:
    return counts.select(*KEYS, F.lit(-1).cast("long").alias("docs"), (-F.col("tokens")).alias("tokens"))


def revisions(before: DataFrame, after: DataFrame) -> DataFrame:
    """Counts of the same documents before and after a new text, source, language or tokenizer version."""
    return deletes(before).unionByName(inserts(after))


def commit(changes: DataFrame, root: str, batch: int) -> None:
    """Stores the summed changes of one batch under ``root``; a repeated batch replaces itself.

    Sums are partial before the shuffle, so a source with a third of all rows is a few rows a task.
    """
    summed = changes.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
    summed.where("docs != 0 OR tokens != 0").write.mode("overwrite").parquet(f"{root}/{batch:09d}")


def totals(spark: SparkSession, root: str, batches: list[int]) -> DataFrame:
    """(source, lang, tokenizer, n_docs, n_tokens) after the committed ``batches``, each counted once.

    Totals of 0 documents and tokens are left out; NULL sources and languages are values of their own.
    """
    paths = [f"{root}/{b:09d}" for b in sorted(set(batches))]
    stored = spark.read.schema(_DELTA).parquet(*paths) if paths else spark.createDataFrame([], _DELTA)
    summed = stored.groupBy(*KEYS).agg(F.sum("docs").alias("n_docs"), F.sum("tokens").alias("n_tokens"))
    return summed.where("n_docs != 0 OR n_tokens != 0")


def compact(spark: SparkSession, root: str, batches: list[int], into: int) -> None:
    """Stores the totals of ``batches`` as one batch; read that one instead of them from then on."""
    commit(totals(spark, root, batches).select(*KEYS, F.col("n_docs").alias("docs"), F.col("n_tokens").alias("tokens")), root, into)
