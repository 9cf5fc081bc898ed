"""Document fingerprints: a Merkle tree over sections, paragraphs and pieces, in DataFrame functions only.

A paragraph is a line of the text. Its leaves are pieces of at most ``WORDS`` words that end with a sentence, white
space included, so that the leaves add up to the text. A paragraph's node hashes its leaves, a section (paragraphs up
to one whose hash says so, which edits elsewhere don't move) hashes its paragraphs, and the root hashes the sections.
The fingerprint is the tree as text::

    <root>|<section>:<paragraph>(<leaf><length>,...)...;<section>:...

Equal roots mean equal texts; where roots differ, differing sections, then paragraphs, then leaves locate the edit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORDS = 8
#: A section ends with a paragraph whose hash is 0 modulo this.
SECTION = 4
_PIECE = r"\s*(?:[^\s]*[^\s.!?][^\S\n]+){0,%d}[^\s]+\s*|\s+" % (WORDS - 1)
_LEAF = "[0-9a-f]{8}\\.[0-9]+"
# A leaf and its copies in a sorted list, each with a comma.
_RUN = "(%s,)\\1*+" % _LEAF


def _hex(x: Column, digits: int) -> Column:
    return F.lower(F.right(F.lpad(F.hex(x), 16, "0"), F.lit(digits)))


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """``df`` with the fingerprint of the column ``text`` (NULL counts as empty)."""
    leaves = F.transform(
        F.split(F.coalesce(F.col(text), F.lit("")), "\n"),
        lambda p: F.transform(F.regexp_extract_all(p, F.lit(_PIECE), F.lit(0)), lambda x: F.struct(F.xxhash64(x).alias("h"), F.length(x).alias("n"))),
    )
    node = F.transform(
        "_leaves",
        lambda p: F.struct(
            F.xxhash64(F.transform(p, lambda x: x["h"])).alias("h"),
            F.array_join(F.transform(p, lambda x: F.concat(_hex(x["h"], 8), F.lit("."), x["n"].cast("string"))), ",").alias("s"),
        ),
    )
    paragraphs = F.transform(
        "_nodes", lambda p: F.concat(_hex(p["h"], 16), F.lit("("), p["s"], F.lit(")"), F.when(F.pmod(p["h"], F.lit(SECTION)) == 0, ";").otherwise(""))
    )
    sections = F.filter(F.split(F.array_join(paragraphs, ""), ";"), lambda s: s != "")
    named = F.transform("_sections", lambda s: F.concat(_hex(F.xxhash64(s), 16), F.lit(":"), s))
    root = F.sha2(F.array_join(F.transform("_named", lambda s: F.left(s, F.lit(16))), ""), 256)
    return (
        df.withColumn("_leaves", leaves)
        .withColumn("_nodes", node)
        .withColumn("_sections", sections)
        .withColumn("_named", named)
        .withColumn(out, F.concat(root, F.lit("|"), F.array_join("_named", ";")))
        .drop("_leaves", "_nodes", "_sections", "_named")
    )


def _weight(leaves: Column) -> Column:
    return F.aggregate(leaves, F.lit(0).cast("long"), lambda total, x: total + F.substring_index(F.substring(x, 10, 20), ",", 1).cast("long"))


def _copies(leaves: Column) -> Column:
    """The leaves with a comma, and behind it the number of the copy if a leaf occurs more than once."""
    runs = F.regexp_extract_all(F.concat(F.array_join(F.sort_array(leaves), ","), F.lit(",")), F.lit(_RUN), F.lit(0))

    def numbered(run: Column) -> Column:
        leaf = F.concat(F.substring_index(run, ",", 1), F.lit(","))
        copies = (F.length(run) / F.length(leaf)).cast("int")
        return F.when(F.length(run) == F.length(leaf), F.array(run)).otherwise(F.transform(F.sequence(F.lit(1), copies), lambda k: F.when(k == 1, leaf).otherwise(F.concat(leaf, k.cast("string")))))

    return F.flatten(F.transform(runs, numbered))


def likeness(a: str, b: str) -> Column:
    """Share of the characters of two fingerprinted texts that are in common leaves, 0 to 1; of a repeated leaf, as many copies as both have."""
    left, right = (F.regexp_extract_all(F.col(x), F.lit(_LEAF), F.lit(0)) for x in (a, b))
    both = _weight(left) + _weight(right)
    common = _weight(F.array_intersect(_copies(left), _copies(right)))
    return F.when(F.col(a) == F.col(b), 1.0).when(both == 0, 0.0).otherwise(2.0 * common / both)


def _ranges(docs: DataFrame) -> Column:
    """Number of the doc_id range of a row, by quantiles: as many ranges as shuffle partitions, NULL in the lowest."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    steps = [i / n for i in range(1, n)] or [0.5]
    bounds = sorted(set(docs.agg(F.percentile_approx("doc_id", steps, 100 * n)).first()[0] or []))
    wide = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[i : i + wide] for i in range(0, len(bounds), wide)] or [[0]]
    heads = F.lit([g[0] for g in groups])
    doc = F.col("doc_id")
    group = F.size(F.filter(heads, lambda x: x < doc))
    inner = F.size(F.filter(F.element_at(F.lit(groups), F.greatest(group, F.lit(1))), lambda x: x < doc))
    return F.when(doc.isNull() | (group == 0), 0).otherwise((group - 1) * wide + inner).cast("long")


def with_next(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, fingerprint) with text and fingerprint of the next row in descending doc_id, round to the first.

    Ranges of doc_id are sorted apart; the first row of each is repeated at the end of the range before it. Rows of one
    doc_id follow each other by text, rows without doc_id come last.
    """
    spark = docs.sparkSession
    tied = docs.withColumn("tie", F.xxhash64("text"))
    tied = tied.withColumn("range", _ranges(docs))
    first = tied.groupBy("range").agg(F.max(F.struct("doc_id", F.negative("tie").alias("tie"))).alias("top")).orderBy(F.desc("range")).collect()
    # One row for each range: no more than there are shuffle partitions.
    moves = [(r["top"]["doc_id"], -r["top"]["tie"], first[i - 1]["range"]) for i, r in enumerate(first)]
    tops = F.broadcast(spark.createDataFrame(moves, "top long, top_tie long, into long"))
    same = F.col("doc_id").eqNullSafe(F.col("top")) & (F.col("tie") == F.col("top_tie"))
    guests = tied.join(tops, same).withColumn("range", F.col("into")).drop("top", "top_tie", "into").withColumn("guest", F.lit(True))
    line = Window.partitionBy("range").orderBy("guest", F.desc_nulls_last("doc_id"), "tie")
    return (
        tied.withColumn("guest", F.lit(False))
        .unionByName(guests)
        .withColumn("next_text", F.lead("text").over(line))
        .withColumn("next_fingerprint", F.lead("fingerprint").over(line))
        .where("NOT guest")
        .drop("guest", "tie", "range")
    )


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprint of every text of ``docs`` (doc_id, text) and of its edited text, and their likenesses.

    The edited text ends with the start of the next document's instead of its own second half. One row per row of
    ``docs``: doc_id, n_chars (code points), edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. NULL
    texts are empty, and empty texts have equal fingerprints; a single row is its own next; other columns are ignored.
    """
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    paired = with_next(with_fingerprint(whole, "text", "fingerprint"))
    cut_at = F.floor(F.length("text") / 2).cast("int")
    edited = paired.withColumn("edited", F.concat(F.left("text", F.length("text") - cut_at), F.left("next_text", cut_at)))
    return with_fingerprint(edited, "edited", "edited_fingerprint").select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        likeness("fingerprint", "edited_fingerprint").alias("near_edited"),
        likeness("fingerprint", "next_fingerprint").alias("near_next"),
    )
