"""360-degree profiles: ordered child lists, summaries, exports."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from casegrain.functions import masking
from casegrain.operators.paging import SortKey, top_per_group
from casegrain.operators.skew import Lists, attach_lists, ordered_lists

BANK_ORDER: list[SortKey] = [("is_primary", "desc"), ("opened_at", "desc"), ("id", "asc")]
ANCHOR_ORDER: list[SortKey] = [("is_primary", "desc"), ("id", "asc")]
SOCIAL_ORDER: list[SortKey] = [("follower_count", "desc"), ("id", "asc")]
PROPERTY_ORDER: list[SortKey] = [("current_value", "desc"), ("id", "asc")]
CASE_ORDER: list[SortKey] = [("created_at", "desc"), ("case_id", "asc"), ("role", "asc")]


def remark_summary(remarks: DataFrame) -> DataFrame:
    """Per entity a map severity -> remarks. Counted per severity first; the map has one entry per severity."""
    counted = remarks.groupBy("entity_id", "severity").agg(F.count(F.lit(1)).alias("n"))
    entries = F.sort_array(F.collect_list(F.struct("severity", "n")))
    return counted.groupBy("entity_id").agg(F.map_from_entries(entries).alias("remark_summary"))


def distinct_sorted(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """Distinct values of a closed domain per key, sorted."""
    return df.groupBy(key).agg(F.sort_array(F.collect_set(value)).alias(name))


def stored_mask(df: DataFrame, name: str) -> Column | None:
    """The mask that the records hold already, or None where the table has no such column."""
    return F.nullif(F.col(name), F.lit("")) if name in df.columns else None


def document_number(anchors: DataFrame) -> Column:
    """Masked by document type; a stored mask wins."""
    return masking.mask_document(F.col("id_type"), F.col("id_number"), stored_mask(anchors, "id_masked"))


def account_number(banks: DataFrame) -> Column:
    computed, stored = masking.mask_bank_account(F.col("account_number")), stored_mask(banks, "account_masked")
    return computed if stored is None else F.coalesce(stored, computed)


def contact_points(entities: DataFrame) -> DataFrame:
    """(entity_id, contact_type, value): phone, then email, where there is one."""
    both = F.array(*[F.struct(F.lit(kind).alias("contact_type"), F.col(f"primary_{kind}").alias("value")) for kind in ("phone", "email")])
    return entities.select("entity_id", F.inline(both)).where("value is not null")


def contact_list() -> Column:
    """The entity's contact points as a list: phone, then email, where there is one."""
    return F.array_compact(F.array(*[
        F.when(F.col(f"primary_{kind}").isNotNull(), F.struct(F.lit(kind).alias("contact_type"), F.col(f"primary_{kind}").alias("value")))
        for kind in ("phone", "email")]))


def bank_list(banks: DataFrame, unmask: bool, max_items: int) -> Lists:
    number = F.col("account_number") if unmask else account_number(banks)
    fields = {"bank_name": F.col("bank_name"), "account": number, "account_type": F.col("account_type"),
              "is_primary": F.col("is_primary")}
    return ordered_lists(banks.where("is_active"), "entity_id", BANK_ORDER, fields, "bank_accounts", max_items)


def anchor_list(anchors: DataFrame, number: Column, max_items: int) -> Lists:
    fields = {"id_type": F.col("id_type"), "id_number": number, "is_verified": F.col("is_verified"),
              "issuing_country": F.col("issuing_country")}
    return ordered_lists(anchors, "entity_id", ANCHOR_ORDER, fields, "identity_anchors", max_items)


def social_list(socials: DataFrame, max_items: int) -> Lists:
    fields = {c: F.col(c) for c in ("platform", "handle", "follower_count")}
    return ordered_lists(socials.where("is_active"), "entity_id", SOCIAL_ORDER, fields, "social_accounts", max_items)


def property_list(properties: DataFrame, max_items: int) -> Lists:
    fields = {c: F.col(c) for c in ("property_type", "current_value")}
    return ordered_lists(properties.where("is_active"), "entity_id", PROPERTY_ORDER, fields, "properties", max_items)


def case_list(cases: DataFrame, roles: DataFrame, max_items: int) -> Lists:
    linked = cases.where(~F.col("is_deleted")).join(roles, "case_id")
    fields = {c: F.col(c) for c in ("case_number", "status", "category", "role")}
    return ordered_lists(linked, "entity_id", CASE_ORDER, fields, "cases", max_items)


#: Rows of children whose entries, as text of 32 bytes each, fill half of the dictionary that a Parquet file keeps for a column.
DICTIONARY_ROWS = 1 << 14


def beside(rows: DataFrame, profiles: DataFrame, key: str, children: int) -> DataFrame:
    """Every row of ``rows`` beside the whole profile of its key.

    A profile comes back once for each of its rows. Tasks are made so small that what they hold of different lists, for ``children``
    rows in all, fits the dictionary of a Parquet column (1 MB): a file then has each list once, instead of as often as it is returned.
    The profiles of a task, so few, are looked up, and rows stay in the order in which they come, those of many keys mixed. In the order
    of their keys a list would also be the bounds of its page, with which a writer compares it in full, row by row.
    """
    usual = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(usual, -(-children // DICTIONARY_ROWS))
    return rows.repartition(tasks, key).join(profiles.repartition(tasks, key).hint("shuffle_hash"), key)


def entity_profile(entities: DataFrame, anchors: DataFrame, socials: DataFrame, banks: DataFrame, cases: DataFrame,
                   roles: DataFrame, unmask: bool = False, max_items: int = 10_000) -> DataFrame:
    """Every entity with its contact points, documents, social accounts, banks and live cases; masked unless ``unmask``."""
    contacts = contact_list()
    addresses = F.array(F.struct(F.col("city"), F.col("country")))
    base = entities.withColumns({"contacts": contacts, "addresses": addresses})
    return attach_lists(base, "entity_id", [
        anchor_list(anchors, F.col("id_number") if unmask else document_number(anchors), max_items), social_list(socials, max_items),
        bank_list(banks, unmask, max_items), case_list(cases, roles, max_items)])


def entity_360(entities: DataFrame, anchors: DataFrame, properties: DataFrame, banks: DataFrame, socials: DataFrame,
               categories: DataFrame, remarks: DataFrame, max_items: int = 10_000) -> DataFrame:
    """The 360 view: masked anchors, live properties, banks and social accounts in order, tags, remarks by severity.

    ``categories`` holds (entity_id, category_names); every child is reduced per entity before its join.
    """
    flat = (entities.join(categories.select("entity_id", F.col("category_names").alias("category_tags")), "entity_id", "left")
            .join(remark_summary(remarks), "entity_id", "left"))
    return attach_lists(flat, "entity_id", [
        anchor_list(anchors, masking.mask_all_but_four(F.col("id_number")), max_items), property_list(properties, max_items),
        bank_list(banks, False, max_items), social_list(socials, max_items)])


def top_children(df: DataFrame, order: Sequence[SortKey], n: int, fields: Sequence[str], name: str) -> DataFrame:
    """The first ``n`` children of every entity as an ordered list."""
    top = top_per_group(df, ["entity_id"], order, n)
    entries = F.sort_array(F.collect_list(F.struct(F.col("position"), F.struct(*fields).alias("_item"))))
    return top.groupBy("entity_id").agg(entries["_item"].alias(name))


def entity_360_top(entities: DataFrame, anchors: DataFrame, banks: DataFrame, socials: DataFrame, properties: DataFrame,
                   categories: DataFrame, remarks: DataFrame) -> DataFrame:
    """360 view with contacts and at most 10 anchors, 5 banks, 10 social accounts and 5 properties per entity."""
    entities = entities.withColumn("contacts", contact_list())
    masked = anchors.withColumn("id_masked", masking.mask_all_but_four(F.col("id_number")))
    children = [
        top_children(masked, ANCHOR_ORDER, 10, ["id_type", "id_masked", "is_verified"], "identity_anchors"),
        top_children(banks.where("is_active"), BANK_ORDER, 5, ["bank_name", "account_type", "is_primary"], "bank_accounts"),
        top_children(socials.where("is_active"), SOCIAL_ORDER, 10, ["platform", "handle", "follower_count"], "social_accounts"),
        top_children(properties.where("is_active"), PROPERTY_ORDER, 5, ["property_type", "current_value"], "properties"),
        categories.select("entity_id", "category_names"),
        remark_summary(remarks),
    ]
    return reduce(lambda out, child: out.join(child, "entity_id", "left"), children, entities)


def yes_no(flag: Column) -> Column:
    return F.when(flag, "Yes").otherwise("No")


def _section(rows: DataFrame, name: str, fields: Sequence[Column], sort: Sequence[Column]) -> DataFrame:
    return rows.select("entity_id", F.lit(name).alias("section"),
                       F.array(*[F.coalesce(f.cast("string"), F.lit("")) for f in fields]).alias("values"),
                       F.struct(*[s.cast("string") for s in sort]).cast("string").alias("sort_key"))


def profile_sections(entities: DataFrame, anchors: DataFrame, socials: DataFrame, banks: DataFrame, cases: DataFrame,
                     roles: DataFrame) -> DataFrame:
    """Profiles as flat rows (entity_id, section, values, sort_key), one per line of the export; flags as Yes or No.

    Lines are never gathered per entity: a writer sorts by (entity_id, section, sort_key), however long a section is.
    """
    c = F.col
    bio = entities.select("entity_id", F.posexplode(F.array(*[
        F.struct(F.lit(label).alias("field"), c(f).cast("string").alias("value"))
        for label, f in (("ID", "entity_id"), ("Full Name", "full_name"), ("Primary Phone", "primary_phone"),
                         ("Primary Email", "primary_email"), ("Created At", "created_on"))])))
    linked = cases.where(~c("is_deleted")).join(roles, "case_id")
    parts = [
        _section(bio, "bio", [c("col.field"), c("col.value")], [c("pos")]),
        _section(entities, "addresses", [c("city"), c("country")], [F.lit(0)]),
        _section(anchors, "documents", [c("id_type"), document_number(anchors), c("issuing_country"), yes_no(c("is_verified"))],
                 [~c("is_primary"), F.lpad(c("id").cast("string"), 20, "0")]),
        _section(contact_points(entities), "contacts", [c("contact_type"), c("value")], [c("contact_type") != "phone"]),
        _section(socials, "social", [c("platform"), c("handle"), c("follower_count"), yes_no(c("is_active"))],
                 [F.lpad(c("id").cast("string"), 20, "0")]),
        _section(banks, "bank", [account_number(banks), c("bank_name"), c("account_type"), yes_no(c("is_primary"))],
                 [~c("is_primary"), F.lpad(c("id").cast("string"), 20, "0")]),
        _section(linked, "cases", [c("case_number"), c("status"), c("category"), c("role")],
                 [F.lpad(c("case_id").cast("string"), 20, "0"), c("role")]),
    ]
    return reduce(DataFrame.unionByName, parts)


def write_sections(sections: DataFrame, path: str) -> None:
    """One CSV folder per section, lines ranged and sorted by entity and position."""
    (sections.withColumn("values", F.to_json("values"))
     .repartitionByRange("section", "entity_id", "sort_key").sortWithinPartitions("section", "entity_id", "sort_key")
     .write.mode("overwrite").partitionBy("section").option("header", True).csv(path))
