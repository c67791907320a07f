"""Categories, tags and their upkeep."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F



def entity_categories(tags: DataFrame, categories: DataFrame) -> DataFrame:
    """Active categories of an entity ordered by name.

    (entity, category) is unique, so a list is never longer than the number of categories.
    """
    live = categories.where("is_active").select("category_id", "name")
    entries = F.sort_array(F.collect_list(F.struct("name", "category_id")))
    return (tags.select("entity_id", "category_id").distinct().join(live, "category_id")
            .groupBy("entity_id").agg(entries.alias("categories"))
            .withColumn("category_names", F.col("categories.name"))
            .withColumn("category_ids", F.col("categories.category_id")))


def category_members(tags: DataFrame, users: DataFrame, category_id: int, user_columns: Sequence[str]) -> DataFrame:
    """Members of a category, newest first; user columns are filled only for members of type ``user``."""
    members = tags.where(F.col("category_id") == category_id).alias("m")
    known = users.select(F.col("id").alias("_user"), *user_columns).alias("u")
    return (members.join(known, (F.col("m.entity_type") == "user") & (F.col("m.entity_id") == F.col("u._user")), "left")
            .drop("_user"))


def tag_any(entities: DataFrame, tags: DataFrame, wanted: Sequence[int]) -> DataFrame:
    """Entities carrying at least one of the categories."""
    return entities.join(tags.where(F.col("category_id").isin(list(wanted))).select("entity_id"), "entity_id", "left_semi")


def tag_all(entities: DataFrame, tags: DataFrame, wanted: Sequence[int]) -> DataFrame:
    """Entities carrying every one of the categories."""
    full = (tags.where(F.col("category_id").isin(list(wanted)))
            .groupBy("entity_id").agg(F.count_distinct("category_id").alias("_n"))
            .where(F.col("_n") == len(set(wanted))).select("entity_id"))
    return entities.join(full, "entity_id", "left_semi")


def assignment_stats(categories: DataFrame, tags: DataFrame) -> DataFrame:
    """Assignments per category, categories without any included, with the latest assignment.

    Tags are counted before the join, so the join sees one row per category.
    """
    counted = tags.groupBy("category_id").agg(F.count(F.lit(1)).alias("n"), F.max("assigned_at").alias("last_assigned_at"))
    return (categories.join(counted, "category_id", "left")
            .withColumn("assignment_count", F.coalesce("n", F.lit(0).cast("bigint"))).drop("n"))


def patch_update(base: DataFrame, patches: DataFrame, key: str, fields: Sequence[str], at: Column) -> DataFrame:
    """Overwrite only the fields a patch supplies (null and '' supply nothing) and stamp patched rows."""
    new = patches.select(F.col(key).alias("_key"), *[F.col(f).alias(f"_new_{f}") for f in fields])
    joined = base.join(new, base[key] == new["_key"], "left")
    updates = {f: F.coalesce(F.nullif(F.col(f"_new_{f}"), F.lit("")), F.col(f)) for f in fields}
    updates["updated_at"] = F.when(F.col("_key").isNotNull(), at).otherwise(F.col("updated_at"))
    return joined.withColumns(updates).drop("_key", *[f"_new_{f}" for f in fields])


def soft_delete(base: DataFrame, doomed: DataFrame, key: str) -> DataFrame:
    """Switch ``is_active`` off for the given keys."""
    marks = doomed.select(key).distinct().withColumn("_gone", F.lit(True))
    return (base.join(marks, key, "left")
            .withColumn("is_active", F.col("is_active") & F.col("_gone").isNull()).drop("_gone"))


def tags_any(have: Column, wanted: Sequence[str]) -> Column:
    """Case-insensitive: does the array share an element with ``wanted``?"""
    return F.arrays_overlap(F.transform(have, F.lower), F.array(*[F.lit(w.lower()) for w in wanted]))


def tags_all(have: Column, wanted: Sequence[str]) -> Column:
    """Case-insensitive: does the array hold all of ``wanted``?"""
    return F.size(F.array_except(F.array(*[F.lit(w.lower()) for w in wanted]), F.transform(have, F.lower))) == 0
