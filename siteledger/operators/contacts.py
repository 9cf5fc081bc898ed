"""Permit contacts joined to permits without gathering a permit's contacts in one place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteledger.functions.contacts import Contact, contact_name, extract_email, extract_phone, rank_of
from siteledger.functions.payload import once


def contact_map(contacts: DataFrame) -> Column:
    names = contacts.columns
    return F.map_from_arrays(
        F.array(*[F.lit(n) for n in names]), F.array(*[F.col(f"`{n}`").cast("string") for n in names])
    )


def permit_contacts(contacts: DataFrame, key: str, position: str | None = None) -> DataFrame:
    """Per permit: number of contacts, order-free digest of all of them, and the best one.

    Everything is a mergeable aggregate, so a permit with any number of contacts is reduced on
    the map side, and e-mail and phone are looked for in the winner only. The column ``position``
    breaks ties; without it the contact's own values do.
    """
    names = [c for c in contacts.columns if c != position]
    texts = contacts.select(
        F.col(key).cast("string").alias("_permit"),
        F.struct(*[F.col(f"`{n}`").cast("string").alias(n) for n in names]).alias("_row"),
        (F.col(position) if position else F.lit(0)).alias("_position"),
    ).where(F.length("_permit") > 0)

    contact = Contact(columns={n: F.col("_row")[n] for n in names})
    # In steps: as one expression this compiles to methods of over 8,000 bytes, which the JVM only interprets.
    named = once(texts, "_firm", contact.firm())
    named = once(named, "_license", contact.license())
    named = once(named, "_person", contact.person())
    named = once(named, "_name", contact_name(F.col("_firm"), F.col("_person")))
    named = once(named, "_rank", rank_of(contact["role"], F.col("_firm"), F.col("_license"), F.col("_name"), F.col("_position")))
    winner = named.select(
        "_permit",
        F.xxhash64(*[F.col("_row")[n] for n in names]).alias("_hash"),
        F.when(F.col("_rank").isNotNull(), F.struct(F.col("_rank").alias("rank"), F.col("_row"))).alias("_rank"),
    )
    digest = F.concat_ws(
        ":",
        F.count("*").cast("string"),
        F.bit_xor("_hash").cast("string"),
        F.sum(F.pmod("_hash", F.lit(1 << 31))).cast("string"),
    )
    summed = winner.groupBy("_permit").agg(
        F.count("*").alias("contact_count"), digest.alias("contact_digest"), F.min("_rank")["_row"].alias("_row")
    )
    for column, value in (("_name", contact.name()), ("_license", contact.license()), ("_all", contact.everything())):
        summed = once(summed, column, value)
    reach = F.struct(
        F.col("_name").alias("name"),
        F.col("_license").alias("license_number"),
        F.coalesce(extract_email(contact["email"]), extract_email(F.col("_all"))).alias("email"),
        F.coalesce(extract_phone(contact["phone"]), extract_phone(F.col("_all"))).alias("phone"),
    )
    company = F.when(F.col("_row").isNotNull(), reach)
    return summed.select("_permit", "contact_count", "contact_digest", company.alias("contact"))


def attach_contacts(
    permits: DataFrame, permit_key: str, contacts: DataFrame, contact_key: str, position: str | None = None
) -> DataFrame:
    """Permits left-joined with their contact summary; permits without contacts keep NULLs."""
    summary = permit_contacts(contacts, contact_key, position).withColumnRenamed("_permit", permit_key)
    return permits.join(summary, permit_key, "left")


def contact_pages(contacts: DataFrame, key: str, page_size: int = 1000) -> DataFrame:
    """All contacts of every permit as lists of about ``page_size``: (permit, page, pages, contacts).

    A permit's contacts are split over as many pages as they need, so no list grows without
    bound and no contact is left out; usual permits have exactly one page.
    """
    contact = contact_map(contacts)
    staged = contacts.select(F.col(key).cast("string").alias("permit"), contact.alias("contact")).where(
        F.length("permit") > 0
    )
    staged = staged.withColumn("_hash", F.xxhash64(F.to_json("contact"), F.monotonically_increasing_id()))
    sizes = staged.groupBy("permit").agg(F.count("*").alias("_n"))
    sized = staged.join(sizes, "permit", "left")
    pages = F.greatest(F.lit(1), F.ceil(F.col("_n") / page_size))
    return (
        sized.withColumns({"pages": pages, "page": F.pmod(F.col("_hash"), pages)})
        .groupBy("permit", "page", "pages")
        .agg(F.collect_list("contact").alias("contacts"))
    )
