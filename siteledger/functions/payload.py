"""Free-form payloads: canonical JSON, record paths, field access, templates, hashes."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Keys under which a response may hold its record list, in the order tried.
LIST_KEYS = ("records", "result", "results", "data", "items", "rows", "Rows")

STRINGS = T.ArrayType(T.MapType(T.StringType(), T.StringType()))


def canonical_json(payload: Column) -> Column:
    """The same JSON for any key order: variants serialise their keys sorted."""
    return F.to_json(F.try_parse_json(payload))


def _step_paths(record_path: str) -> list[str]:
    """JSON paths a dotted record path may mean; a number may be a key or a list index."""
    paths = ["$"]
    for part in record_path.split("."):
        quoted = f"['{part}']"
        if part.isdigit():
            paths = [p + step for p in paths for step in (quoted, f"[{part}]")]
        else:
            paths = [p + quoted for p in paths]
    return paths


def record_list(response: Column, record_path: str | None = None) -> Column:
    """ARRAY<VARIANT> of the records in a parsed response.

    The target is the value at ``record_path``, or the whole response. A list is taken as it
    is; of an object the first list under one of ``LIST_KEYS``; anything else gives NULL.
    """
    paths = _step_paths(record_path) if record_path else ["$"]
    tries = [F.try_variant_get(response, p, "array<variant>") for p in paths]
    tries += [F.try_variant_get(response, f"{p}['{key}']", "array<variant>") for p in paths for key in LIST_KEYS]
    return F.coalesce(*tries)


def is_object(value: Column) -> Column:
    return F.startswith(F.schema_of_variant(value), F.lit("OBJECT"))


def flat_fields(payload: Column, names: Iterable[str], extra: dict[str, T.DataType] | None = None) -> Column:
    """One pass over the payload text for exactly the fields needed, as a STRUCT of strings."""
    schema = T.StructType([T.StructField(n, T.StringType()) for n in dict.fromkeys(names)])
    for name, kind in (extra or {}).items():
        schema = schema.add(name, kind)
    return F.from_json(payload, schema)


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with ``value`` as column ``name``, computed once per row however often it is used.

    The one-element explode keeps the optimizer from repeating the value inside every filter
    and expression that looks at one of its fields.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def template_fields(template: str | None) -> list[str]:
    return re.findall(r"\{([^{}]+)\}", template or "")


def fill_template(template: str | None, fields: Column) -> Column:
    """``{field}`` substitution from a struct; NULL when a field is missing."""
    if not template:
        return F.lit(None).cast("string")
    pieces = [
        fields[part[1:-1]].cast("string") if part.startswith("{") else F.lit(part)
        for part in re.split(r"(\{[^{}]+\})", template)
        if part
    ]
    return F.concat(*pieces)


def digest(*cols: Column) -> Column:
    """sha256 over columns, NULL and '' kept apart."""
    return F.sha2(F.to_json(F.struct(*[c.alias(f"c{i}") for i, c in enumerate(cols)]), {"ignoreNullFields": "false"}), 256)


def content_hash(payload: Column) -> Column:
    return F.sha2(canonical_json(payload), 256)
