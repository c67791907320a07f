"""Summaries and warehouse reports."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def financial_summary(banks: DataFrame) -> DataFrame:
    """Accounts, credit, debit and net per entity over active accounts."""
    return (banks.where("is_active").groupBy("entity_id")
            .agg(F.count(F.lit(1)).alias("account_count"),
                 F.sum("total_credit").alias("total_credit"),
                 F.sum("total_debit").alias("total_debit"))
            .withColumn("net_balance", F.col("total_credit") - F.col("total_debit")))


def high_debit(summary: DataFrame) -> DataFrame:
    """Entities that spent more than they received and received something."""
    return summary.where((F.col("total_debit") > F.col("total_credit")) & (F.col("total_credit") > 0))


def risk_buckets(entities: DataFrame, run_date: Column) -> DataFrame:
    """Entities and mean risk by status, country and decade of risk."""
    return (entities.groupBy("status", "country", (F.floor(F.col("risk_score") / 10) * 10).alias("risk_bucket"))
            .agg(F.count(F.lit(1)).alias("entity_count"), F.avg("risk_score").alias("avg_risk"))
            .withColumn("analysis_date", run_date))


def record_stats(records: DataFrame) -> DataFrame:
    return records.agg(F.count(F.lit(1)).alias("total"), F.count_distinct("category").alias("categories"),
                       F.coalesce(F.sum("value"), F.lit(0)).alias("total_value"),
                       F.coalesce(F.avg("value"), F.lit(0)).alias("avg_value"))


def user_stats(users: DataFrame, now: Column) -> DataFrame:
    return users.agg(F.count(F.lit(1)).alias("total_users"),
                     F.count_if(F.col("role") == "admin").alias("admins"),
                     F.count_if(F.col("role") == "user").alias("regular_users"),
                     F.count_if(F.col("created_on") > now - F.expr("INTERVAL 7 DAYS")).alias("new_this_week"),
                     F.count_if(F.col("last_login_at").isNotNull()).alias("ever_logged_in"))


def api_key_stats(keys: DataFrame, now: Column) -> DataFrame:
    return keys.agg(F.count(F.lit(1)).alias("total_keys"),
                    F.count_if(~F.col("revoked")).alias("active_keys"),
                    F.count_if(F.col("last_used_at") > now - F.expr("INTERVAL 24 HOURS")).alias("used_today"),
                    F.count_if(F.col("expires_at") < now).alias("expired"))


def multi_account_entities(banks: DataFrame, least: int = 5) -> DataFrame:
    return (banks.groupBy("entity_id").agg(F.count(F.lit(1)).alias("bank_count"))
            .where(F.col("bank_count") >= least))


def high_risk_top(entities: DataFrame, country: str, least: int = 80, n: int = 10) -> DataFrame:
    return (entities.where((F.col("risk_score") >= least) & (F.col("country") == country))
            .orderBy(F.desc("risk_score"), F.asc("entity_id")).limit(n))


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Union of look-alike tables; columns a table lacks become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def source_overview(tables: Mapping[str, tuple[str, DataFrame]]) -> DataFrame:
    """Per source: tables, rows, text columns. ``tables`` maps table name to (source, DataFrame)."""
    counted = [
        df.agg(F.count(F.lit(1)).alias("rows"))
          .withColumns({"source": F.lit(source), "table_name": F.lit(name),
                        "text_columns": F.lit(sum(f.dataType.simpleString() == "string" for f in df.schema.fields))})
        for name, (source, df) in tables.items()
    ]
    return (union_all(counted).groupBy("source")
            .agg(F.count(F.lit(1)).alias("table_count"), F.sum("rows").alias("total_rows"),
                 F.sum("text_columns").alias("text_columns")))


def warehouse_cube(entities: DataFrame, anchors: DataFrame, banks: DataFrame, socials: DataFrame,
                   properties: DataFrame) -> DataFrame:
    """One row per entity with counts and asset value.

    Every child is reduced to one row per entity before its join: no fan-out, sums are not multiplied, and
    each shuffle carries partial aggregates only. The id types of an entity are a small closed domain.
    """
    ids = anchors.groupBy("entity_id").agg(F.sort_array(F.collect_set("id_type")).alias("id_types"))
    accounts = banks.where("is_active").groupBy("entity_id").agg(F.count_distinct("id").alias("bank_count"))
    handles = socials.where("is_active").groupBy("entity_id").agg(F.count_distinct("id").alias("social_count"))
    assets = properties.groupBy("entity_id").agg(F.count_distinct("id").alias("property_count"),
                                                 F.sum("current_value").alias("net_asset_value"))
    out = entities
    for child in (ids, accounts, handles, assets):
        out = out.join(child, "entity_id", "left")
    zero = F.lit(0).cast("bigint")
    return out.select(
        "entity_id",
        F.trim(F.concat(F.col("first_name"), F.lit(" "), F.coalesce("last_name", F.lit("")))).alias("full_name"),
        "risk_score", "status",
        F.coalesce("id_types", F.array().cast("array<string>")).alias("id_types"),
        F.coalesce("bank_count", zero).alias("bank_count"),
        F.coalesce("social_count", zero).alias("social_count"),
        F.coalesce("property_count", zero).alias("property_count"),
        F.coalesce("net_asset_value", F.lit(0)).alias("net_asset_value"),
        F.coalesce("country", F.lit("UNKNOWN")).alias("country"),
        F.year("created_on").alias("year"),
    )
