"""Warehouse tables, delimited files, reports."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from casegrain.operators.paging import top_per_group
from casegrain.operators.search import cross_source_match
from casegrain.operators.warehouse import union_all

# Fixed values of the reports.
REPORT_ROWS = 1000
REPORT_MAX = 10_000


def warehouse_write(df: DataFrame, table: str, path: str, buckets: int = 256) -> None:
    """ORC table by (country, year), bucketed and sorted by entity, with bloom filters on contact columns.

    Rows are placed by partition and bucket first, so each file has one writer, and a crowded country is still spread
    over as many tasks as it has buckets. The bucket number is the one Spark itself gives a row.
    """
    bucket = F.pmod(F.hash("entity_id"), F.lit(buckets))
    tasks = max(buckets, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    (df.repartition(tasks, "country", "year", bucket).write.mode("overwrite").format("orc")
     .partitionBy("country", "year").bucketBy(buckets, "entity_id").sortBy("entity_id")
     .option("compression", "snappy").option("orc.bloom.filter.columns", "primary_email,primary_phone")
     .option("path", path).saveAsTable(table))


def warehouse_overwrite(df: DataFrame, table: str) -> None:
    """Replace only the partitions that occur in ``df``."""
    spark = df.sparkSession
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        df.select(*spark.table(table).columns).write.insertInto(table, overwrite=True)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", before)


def delimited_write(df: DataFrame, path: str, sep: str) -> None:
    df.write.mode("overwrite").option("sep", sep).csv(path)


def report_table(df: DataFrame, key: str, value: str, source: str, equals: str | None = None,
                 limit: int = REPORT_ROWS) -> DataFrame:
    """First rows of a table in key order with the sources that hold the same value and whether several do.

    Cross references are looked up for the report's values only. The limit may be 1 to ``REPORT_MAX``.
    """
    if not 0 < limit <= REPORT_MAX:
        raise ValueError(f"a report has 1 to {REPORT_MAX} rows, not {limit}")
    rows = df if equals is None else df.where(F.col(value) == equals)
    page = rows.orderBy(key).limit(limit)
    shared = cross_source_match(df.join(page.select(value), value, "left_semi"), value, source)
    return page.join(shared.select(value, F.col("sources.source").alias("cross_refs"), "has_duplicates"), value, "left").orderBy(key)


def report_all_tables(tables: Mapping[str, tuple[DataFrame, str]], limit: int = REPORT_ROWS, per_table: int = 10) -> DataFrame:
    """Ten rows of every table (name -> (DataFrame, key)), tables in the order given, rows by their key, until the limit."""
    parts = []
    for position, (name, (df, key)) in enumerate(tables.items()):
        first = df.orderBy(key).limit(per_table)
        place = F.row_number().over(Window.orderBy(key))  # of ``per_table`` rows
        parts.append(first.withColumns({"_source_table": F.lit(name), "_table": F.lit(position), "_place": place}))
    return union_all(parts).orderBy("_table", "_place").limit(limit).drop("_table", "_place")


def sample_report(df: DataFrame, source: str, table: str, key: str, tags: str, tables: int = 10, rows: int = 100) -> DataFrame:
    """At most ``tables`` tables per source and ``rows`` rows per table; tags as one text."""
    chosen = top_per_group(df.select(source, table).distinct(), [source], [(table, "asc")], tables).select(source, table)
    sampled = top_per_group(df.join(chosen, [source, table], "left_semi"), [source, table], [(key, "asc")], rows)
    return sampled.drop("position").withColumn(tags, F.array_join(tags, ";"))


def write_report(df: DataFrame, path: str, kind: str = "csv") -> None:
    """CSV with a header, or JSON rows next to a one-row envelope with their count."""
    if kind == "csv":
        df.write.mode("overwrite").option("header", True).csv(path)
        return
    df.write.mode("overwrite").json(f"{path}/rows")
    df.sparkSession.read.json(f"{path}/rows").agg(F.count(F.lit(1)).alias("count")).write.mode("overwrite").json(f"{path}/envelope")


def drop_table(spark: SparkSession, table: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {table}")
