"""Address normal form and blocking key."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unit markers and street abbreviations.
UNIT_MARKER = r"(?iU)(?:#|\b(?:suite|ste|unit|apt|apartment)\b)\.?\s*([\w-]+)"
STREET_WORDS = {
    "street": "st",
    "avenue": "ave",
    "boulevard": "blvd",
    "drive": "dr",
    "road": "rd",
    "lane": "ln",
    "court": "ct",
    "place": "pl",
    "terrace": "ter",
    "highway": "hwy",
    "parkway": "pkwy",
    "square": "sq",
    "north": "n",
    "south": "s",
    "east": "e",
    "west": "w",
}


def normalize_address(col: Column) -> Column:
    """Lower case, ``unit <id>`` for every unit marker, ASCII words only, street words abbreviated."""
    short = F.create_map(*[F.lit(x) for x in chain.from_iterable(STREET_WORDS.items())])
    unit = F.regexp_replace(F.lower(col), UNIT_MARKER, " unit $1 ")
    words = F.regexp_extract_all(unit, F.lit("([a-z0-9]+)"), F.lit(1))
    return F.coalesce(
        F.array_join(F.transform(words, lambda w: F.coalesce(F.try_element_at(short, w), w)), " "), F.lit("")
    )


def block_key(normalized: Column) -> Column:
    """``first number : first four letters of the first word``; '' when both are missing."""
    tokens = F.split(normalized, " ")
    number = F.coalesce(F.get(F.filter(tokens, lambda t: t.rlike("^[0-9]+$")), F.lit(0)), F.lit(""))
    word = F.coalesce(F.get(F.filter(tokens, lambda t: t.rlike("^[a-z]+$")), F.lit(0)), F.lit(""))
    return F.when(
        (F.length(number) > 0) | (F.length(word) > 0), F.concat(number, F.lit(":"), F.left(word, F.lit(4)))
    ).otherwise(F.lit(""))
