"""Upkeep of stored tables: derived columns, expiry, sessions from open and close events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from casegrain.functions.identity import id_hash


def with_derived_hash(df: DataFrame, at: Column, fold: Callable[[Column], Column] = F.upper) -> DataFrame:
    """Hash of the id number and change time, derived whenever rows are written."""
    return df.withColumns({"id_number_hash": id_hash(F.col("id_number"), fold), "updated_at": at})


def purge(df: DataFrame, expired: Column) -> tuple[DataFrame, DataFrame]:
    """(rows that stay, one row ``deleted``). A row whose condition is unknown stays."""
    gone = F.coalesce(expired, F.lit(False))
    return df.where(~gone), df.agg(F.count_if(gone).alias("deleted"))


def work_sessions(events: DataFrame, session: str, user: str) -> DataFrame:
    """Sessions from ``open`` and ``close`` events with their duration; open ones have no end.

    Opening and closing meet in one aggregation per session, with partial results before the shuffle.
    """
    kind = F.col("kind")
    return (events.groupBy(session, user)
            .agg(F.min(F.when(kind == "open", F.col("at"))).alias("started_at"),
                 F.max(F.when(kind == "close", F.col("at"))).alias("ended_at"))
            .withColumn("duration_seconds",
                        F.timestamp_diff("SECOND", F.col("started_at"), F.col("ended_at"))))
