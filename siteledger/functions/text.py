"""String helpers as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names and licences that stand for "nobody".
PLACEHOLDER_NAMES = ("owner", "none", "n/a")
PLACEHOLDER_CONTACT_NAMES = ("owner owner", "owner", "none", "n/a")
PLACEHOLDER_LICENSES = ("OWN", "OWNER", "NONE", "000000", "0000000")


# The characters that count as whitespace. The first range of the pattern settles most characters at once.
SPACE = r"[\x00-\x20\x85-\u3000&&[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]]"
_SPACES = "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def null_if_empty(col: Column) -> Column:
    return F.nullif(col, F.lit(""))


def first_present(*cols: Column) -> Column:
    """First value that is neither NULL nor the empty string (blanks and zero count)."""
    if not cols:
        return F.lit(None).cast("string")
    return F.coalesce(*[null_if_empty(c.cast("string")) for c in cols])


def strip(col: Column) -> Column:
    """Trim any whitespace, not only spaces."""
    return F.btrim(col, F.lit(_SPACES))


def squeeze(col: Column) -> Column:
    """Collapse whitespace runs to one space and trim."""
    return F.trim(F.regexp_replace(col, f"{SPACE}+", " "))


def join_parts(*cols: Column, sep: str = " ") -> Column:
    """Join the parts that are present; NULL when none is."""
    parts = [null_if_empty(strip(c.cast("string"))) for c in cols]
    return null_if_empty(F.concat_ws(sep, *parts))


def address_parts(*cols: Column) -> Column:
    """Join address columns in order; a blank part leaves only its separator, as a lone space."""
    parts = [strip(null_if_empty(c.cast("string"))) for c in cols]
    return null_if_empty(F.concat_ws(" ", *parts))


def title_case(col: Column) -> Column:
    """Capital after every non-letter (``o'neil`` -> ``O'Neil``), unlike ``initcap``."""
    runs = F.regexp_extract_all(col, F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(
        F.transform(runs, lambda r: F.concat(F.upper(F.substr(r, F.lit(1), F.lit(1))), F.lower(F.substr(r, F.lit(2))))),
        "",
    )


def drop_placeholder(col: Column, names: tuple[str, ...] = PLACEHOLDER_NAMES) -> Column:
    return F.when((F.length(col) > 0) & ~F.lower(col).isin(*names), col)


def clean_license(col: Column) -> Column:
    trimmed = strip(null_if_empty(col))
    return F.when(~F.upper(trimmed).isin(*PLACEHOLDER_LICENSES), trimmed)


def company_key(name: Column) -> Column:
    """Identity of a company: lower case, ``&`` spelled out, single spaces."""
    return null_if_empty(squeeze(F.replace(F.lower(name), F.lit("&"), F.lit("and"))))


def slug(col: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(col), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def cap_text(col: Column, limit: int = 300) -> Column:
    return F.when(F.length(col) > limit, F.concat(F.left(col, F.lit(limit)), F.lit("…"))).otherwise(col)


def present(col: Column) -> Column:
    """True when the text is neither NULL nor empty."""
    return F.coalesce(F.length(col) > 0, F.lit(False))


def has_contact(email: Column, phone: Column) -> Column:
    return present(email) | present(phone)
