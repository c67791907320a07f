"""Snapshots and increments of tables, unions of look-alike tables, external folders."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from casegrain.operators.filters import typed_literal
from casegrain.operators.warehouse import union_all


def jdbc_table(spark: SparkSession, url: str, table: str, split_by: str, lower: int, upper: int, partitions: int = 16,
               **options: str) -> DataFrame:
    """A database table read in parallel ranges of a numeric key; filters and columns are pushed to the database."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=split_by, lowerBound=str(lower),
                                               upperBound=str(upper), numPartitions=str(partitions), **options)
    return reader.load()


def snapshot_import(df: DataFrame, target: str, where: Column | None = None, columns: Sequence[str] | None = None) -> None:
    """Replace the target with the rows and columns wanted."""
    rows = df if where is None else df.where(where)
    (rows if columns is None else rows.select(*columns)).write.mode("overwrite").option("compression", "snappy").parquet(target)


def incremental_import(df: DataFrame, target: str, check: str, watermark: object):
    """Append the rows after the watermark and return the next watermark (unchanged when nothing is new).

    The next watermark is taken first and bounds the copy, so rows that arrive meanwhile are left for the next run.
    """
    kind = df.schema[check].dataType
    fresh = df.where(F.col(check) > typed_literal(watermark, kind))
    newest = fresh.agg(F.max(check)).head()[0]
    if newest is None:
        return watermark
    fresh.where(F.col(check) <= typed_literal(newest, kind)).write.mode("append").parquet(target)
    return newest


def multi_table_fanin(tables: Mapping[tuple[str, str], DataFrame | None]) -> DataFrame:
    """Union of look-alike tables under (schema, name), tagged with their origin; missing ones (None) are skipped."""
    return union_all([df.withColumns({"source_schema": F.lit(schema), "source_table": F.lit(name)})
                      for (schema, name), df in tables.items() if df is not None])


def external_scan(spark: SparkSession, base: str) -> DataFrame:
    """An external parquet folder; its ``key=value`` directories become columns that prune the scan."""
    return spark.read.parquet(base)
