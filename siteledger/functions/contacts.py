"""Phone, e-mail, licence and permit-contact expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siteledger.functions.text import (
    PLACEHOLDER_CONTACT_NAMES,
    clean_license,
    drop_placeholder,
    first_present,
    join_parts,
    null_if_empty,
    squeeze,
    strip,
)

# Contact patterns and role order.
EMAIL = r"(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}"
PHONE = r"(?U)(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]\d{3}[-.\s]\d{4}"
BARE_PHONE = r"(?U)\b1?\d{10}\b"
CONTACT_ROLES = ("contractor", "subcontractor", "authorized agent", "architect", "engineer")
OWNER_ROLES = ("owner", "applicant", "tenant")


# A ten-digit number, or eleven digits with a leading 1.
_NUMBER = r"^1?(\d{3})(\d{3})(\d{4})$"
_NO_NUMBER = r"^(?!1?\d{10}$).*$"
_LAYOUT = "($1) $2-$3"


def clean_phone(col: Column) -> Column:
    """``(ddd) ddd-dddd`` for ten digits (or eleven with a leading 1), else the trimmed text."""
    digits = F.regexp_replace(F.regexp_replace(col, r"(?U)\D", ""), _NO_NUMBER, "")
    return F.coalesce(null_if_empty(F.regexp_replace(digits, _NUMBER, _LAYOUT)), null_if_empty(strip(col)))


def normalize_license(col: Column) -> Column:
    """Digits without leading zeros; NULL for letters, more than eight digits or none."""
    digits = F.regexp_replace(col, r"(?U)\D", "")
    usable = ~col.rlike("[A-Za-z]") & (F.length(digits) <= 8)
    return F.when(usable, null_if_empty(F.ltrim(digits, F.lit("0"))))


def extract_email(col: Column) -> Column:
    return F.regexp_substr(col, F.lit(EMAIL))


def extract_phone(col: Column) -> Column:
    """First separated phone number, else the first bare ten-digit run, formatted."""
    hit = F.coalesce(F.regexp_substr(col, F.lit(PHONE)), F.regexp_substr(col, F.lit(BARE_PHONE)))
    return F.regexp_replace(F.regexp_replace(hit, r"(?U)\D", ""), _NUMBER, _LAYOUT)


def contact_name(firm: Column, person: Column) -> Column:
    return drop_placeholder(squeeze(F.coalesce(firm, person)), PLACEHOLDER_CONTACT_NAMES)


def contact_rank(role: Column) -> Column:
    """Position of the first role hint found in the (lower-case) role."""
    rank = F.when(role.contains(CONTACT_ROLES[0]), 0)
    for index, hint in enumerate(CONTACT_ROLES[1:], start=1):
        rank = rank.when(role.contains(hint), index)
    return rank.otherwise(len(CONTACT_ROLES))


class Contact:
    """Named values of one contact, from a map column or from the columns of a contact table."""

    def __init__(self, values: Column | None = None, columns: dict[str, Column] | None = None):
        self._values, self._columns = values, columns

    def __getitem__(self, key: str) -> Column:
        if self._columns is None:
            return F.try_element_at(self._values, F.lit(key))
        return self._columns.get(key, F.lit(None).cast("string"))

    def everything(self) -> Column:
        """Every non-empty value, in key order, as one text."""
        if self._columns is None:
            keys = F.array_sort(F.map_keys(self._values))
            return F.array_join(F.transform(keys, lambda k: null_if_empty(F.try_element_at(self._values, k))), " ")
        return F.concat_ws(" ", *[null_if_empty(self._columns[k]) for k in sorted(self._columns)])

    def firm(self) -> Column:
        return first_present(self["firm_name"], self["company_name"])

    def person(self) -> Column:
        return join_parts(self["first_name"], self["last_name"])

    def name(self) -> Column:
        """Firm, else person; NULL for placeholders."""
        return contact_name(self.firm(), self.person())

    def license(self) -> Column:
        return clean_license(first_present(self["license1"], self["license2"]))

    def email(self) -> Column:
        return F.coalesce(extract_email(self["email"]), extract_email(self.everything()))

    def phone(self) -> Column:
        return F.coalesce(extract_phone(self["phone"]), extract_phone(self.everything()))

    def company(self) -> Column:
        return F.struct(
            self.name().alias("name"),
            self.license().alias("license_number"),
            self.email().alias("email"),
            self.phone().alias("phone"),
        )

    def rank(self, position: Column) -> Column:
        return rank_of(self["role"], self.firm(), self.license(), self.name(), position)


def rank_of(role: Column, firm: Column, license_number: Column, name: Column, position: Column) -> Column:
    """Sortable STRUCT(rank, no_firm, no_license, position); the smallest of a permit is its best contact.

    NULL when the contact names nobody, or is an owner-like person with neither firm nor licence.
    """
    role = F.lower(F.coalesce(role, F.lit("")))
    person_only = firm.isNull() & license_number.isNull() & role.rlike("|".join(OWNER_ROLES))
    return F.when(
        name.isNotNull() & ~person_only,
        F.struct(
            contact_rank(role).alias("rank"),
            firm.isNull().alias("no_firm"),
            license_number.isNull().alias("no_license"),
            position.alias("position"),
        ),
    )


def best_contact(contacts: Column) -> Column:
    """Company of the best contact in an array of contact maps; no shuffle.

    Only the winner's e-mail and phone are looked for.
    """
    ranked = F.transform(contacts, lambda c, i: Contact(c).rank(i))
    winner = F.array_min(F.array_compact(ranked))["position"]
    company = F.transform(F.array_compact(F.array(F.get(contacts, winner))), lambda c: Contact(c).company())
    return F.get(company, F.lit(0))


def best_point_of_contact(contacts: Column, agency: Column) -> Column:
    """Company for a solicitation: first reachable contact, primary ones first, else the bare agency.

    ``agency`` should be a plain column: it is looked at once per contact.
    """
    reach = F.transform(
        contacts,
        lambda c, i: F.struct(
            F.when(F.lower(F.try_element_at(c, F.lit("type"))) == "primary", 0).otherwise(1).alias("secondary"),
            i.alias("position"),
            F.coalesce(agency, null_if_empty(squeeze(F.try_element_at(c, F.lit("fullName"))))).alias("name"),
            Contact(c).email().alias("email"),
            Contact(c).phone().alias("phone"),
        ),
    )
    usable = F.filter(reach, lambda r: r["name"].isNotNull() & (r["email"].isNotNull() | r["phone"].isNotNull()))
    none = F.lit(None).cast("string")
    bare = F.when(
        agency.isNotNull(),
        F.struct(
            F.lit(1).alias("secondary"),
            F.lit(0).alias("position"),
            agency.alias("name"),
            none.alias("email"),
            none.alias("phone"),
        ),
    )
    best = F.array_compact(F.array(F.coalesce(F.array_min(usable), bare)))
    return F.get(
        F.transform(
            best,
            lambda r: F.struct(
                r["name"].alias("name"), none.alias("license_number"), r["email"].alias("email"), r["phone"].alias("phone")
            ),
        ),
        F.lit(0),
    )
