"""Case graph joins and key-set maintenance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def entity_cases(cases: DataFrame, roles: DataFrame) -> DataFrame:
    """Live cases of every entity with its role."""
    return cases.where(~F.col("is_deleted")).join(roles, "case_id")


def case_entities(cases: DataFrame, roles: DataFrame, entities: DataFrame) -> DataFrame:
    """Every live case with the entities linked to it."""
    return entity_cases(cases, roles).join(entities, "entity_id")


def insert_absent(existing: DataFrame, incoming: DataFrame, key: Sequence[str]) -> DataFrame:
    """``existing`` plus the incoming rows whose key is new; repeats inside ``incoming`` count once."""
    new = incoming.dropDuplicates(list(key)).join(existing.select(*key), list(key), "left_anti")
    return existing.unionByName(new)


def remove_matching(existing: DataFrame, doomed: DataFrame, key: Sequence[str]) -> DataFrame:
    """``existing`` without the rows whose key occurs in ``doomed``."""
    return existing.join(doomed.select(*key), list(key), "left_anti")


def match_by_either(records: DataFrame, master: DataFrame, record_id: str, master_id: str,
                    handles: Sequence[str]) -> DataFrame:
    """Smallest master id that shares any of the handles with a record, one row per record.

    The master side is reduced to one id per handle value before the joins, so no join multiplies rows.
    """
    found: list[Column] = []
    out = records
    for handle in handles:
        name = f"_by_{handle}"
        lookup = (master.where(F.col(handle).isNotNull()).groupBy(handle)
                  .agg(F.min(master_id).alias(name)))
        out = out.join(lookup, handle, "left")
        found.append(F.col(name))
    best = F.least(*found) if len(found) > 1 else found[0]
    return out.select(F.col(record_id), best.alias("matched_id")).where(F.col("matched_id").isNotNull())


def column_catalog(tables: dict[str, DataFrame], spark) -> DataFrame:
    """(table_name, column_name, data_type) of the given tables."""
    rows = [(t, f.name, f.dataType.simpleString()) for t, df in tables.items() for f in df.schema.fields]
    return spark.createDataFrame(rows, "table_name string, column_name string, data_type string")


def column_catalog_match(catalog: DataFrame, term: str, anchors: Sequence[str]) -> DataFrame:
    """Text columns whose own or table name contains ``term``, in tables that also have one of ``anchors``."""
    text = catalog.where(F.col("data_type") == "string")
    named = text.where(F.contains(F.lower("table_name"), F.lit(term.lower()))
                       | F.contains(F.lower("column_name"), F.lit(term.lower())))
    anchored = catalog.where(F.lower("column_name").rlike("|".join(anchors))).select("table_name")
    return named.join(anchored, "table_name", "left_semi")
