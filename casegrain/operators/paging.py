"""Ordered pages: keyset cursors, offsets, totals, top rows per group."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Observation, Window, functions as F
from pyspark.sql.types import StructType

from casegrain.operators.filters import all_of, typed_literal

SortKey = tuple[str, str]  # (column, "asc" | "desc"); the last key must make the order total


def order_by(keys: Sequence[SortKey]) -> list[Column]:
    return [F.col(c).desc_nulls_last() if d == "desc" else F.col(c).asc_nulls_last() for c, d in keys]


def after_cursor(schema: StructType, keys: Sequence[SortKey], values: Sequence[object]) -> Column:
    """Rows that come after ``values`` in the given order, for any mix of directions; nulls come last in each."""
    literals = [typed_literal(v, schema[c].dataType) for (c, _), v in zip(keys, values)]
    steps = []
    for i, (name, direction) in enumerate(keys):
        if values[i] is None:
            continue  # nothing comes after null but what the later keys tell apart
        same = [F.col(c).eqNullSafe(v) for (c, _), v in zip(keys[:i], literals)]
        beyond = F.col(name) < literals[i] if direction == "desc" else F.col(name) > literals[i]
        steps.append(all_of([*same, beyond | F.col(name).isNull()]))
    return reduce(or_, steps, F.lit(False))


def keyset_page(df: DataFrame, keys: Sequence[SortKey], limit: int,
                after: Sequence[object] | None = None) -> DataFrame:
    """The ``limit`` rows after the cursor plus ``has_more``.

    One row more than asked for is fetched; Spark keeps only ``limit + 1`` rows per task
    (TakeOrderedAndProject), so the numbering below never sees more than that.
    """
    rows = df if after is None else df.where(after_cursor(df.schema, keys, after))
    fetched = rows.orderBy(*order_by(keys)).limit(limit + 1)
    page = Window.partitionBy(F.lit(0))
    return (fetched
            .withColumn("_n", F.row_number().over(page.orderBy(*order_by(keys))))
            .withColumn("has_more", F.count(F.lit(1)).over(page) > limit)
            .where(F.col("_n") <= limit)
            .drop("_n"))


def cursor_column(keys: Sequence[SortKey]) -> Column:
    """Opaque cursor of a row: base64 of the JSON of its sort values."""
    return F.base64(F.to_json(F.struct(*[F.col(c) for c, _ in keys])).cast("binary"))


def decode_cursor(cursor: Column, schema: StructType) -> Column:
    """Sort values of a cursor as a struct; null when the text is not a cursor."""
    return F.from_json(F.try_to_binary(cursor, F.lit("base64")).cast("string"), schema)


def next_cursor(page: DataFrame, keys: Sequence[SortKey]) -> tuple | None:
    """Sort values of the last row of a page (one row reaches the caller)."""
    backwards = [F.col(c).asc_nulls_first() if d == "desc" else F.col(c).desc_nulls_first() for c, d in keys]
    last = page.orderBy(*backwards).select(*[c for c, _ in keys]).head()
    return None if last is None else tuple(last)


def offset_page(df: DataFrame, keys: Sequence[SortKey], limit: int, offset: int = 0) -> DataFrame:
    return df.orderBy(*order_by(keys)).offset(offset).limit(limit)


def total(df: DataFrame) -> DataFrame:
    """One row ``total``; kept apart from the page so that it survives an offset past the end."""
    return df.agg(F.count(F.lit(1)).alias("total"))


def page_with_total(df: DataFrame, keys: Sequence[SortKey], limit: int, offset: int = 0) -> DataFrame:
    """A page whose rows carry the number of all matching rows as ``total_count``."""
    return offset_page(df, keys, limit, offset).withColumn("total_count", total(df).scalar())


def page_counted(df: DataFrame, keys: Sequence[SortKey], limit: int, offset: int = 0) -> DataFrame:
    """A page whose rows carry ``total_count``, from one pass: matching rows are counted while the page's are taken.

    The page, ``limit`` rows, goes through the driver. (`page_with_total` stays lazy and runs what finds the rows twice.)
    """
    seen = Observation()
    rows = df.observe(seen, F.count(F.lit(1)).alias("n")).orderBy(*order_by(keys)).offset(offset).limit(limit).collect()
    page = df.sparkSession.createDataFrame(rows, df.schema)
    return page.withColumn("total_count", F.lit(seen.get["n"]).cast("bigint"))


def children_in_order(df: DataFrame, key: str, keys: Sequence[SortKey]) -> DataFrame:
    """All rows by parent and, below each, in the given order. Ranges of the order go to tasks, so a crowded parent is spread."""
    return df.orderBy(F.col(key), *order_by(keys))


def top_per_group(df: DataFrame, group: Sequence[str], keys: Sequence[SortKey], n: int,
                  position: str = "position") -> DataFrame:
    """First ``n`` rows of each group in order.

    Spark limits each group inside every map task before the shuffle (WindowGroupLimit), so a group
    that holds a large part of the rows sends at most ``n`` rows per task.
    """
    ranked = df.withColumn(position, F.row_number().over(Window.partitionBy(*group).orderBy(*order_by(keys))))
    return ranked.where(F.col(position) <= n)
