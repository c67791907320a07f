"""Groups too large for one task: finding them, and lists that may be split over several rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from casegrain.operators.paging import SortKey, order_by
from casegrain.session import stored

BROADCAST_ROWS = 100_000


def hot_keys(df: DataFrame, keys: Sequence[str], max_rows: int) -> DataFrame | None:
    """Keys with more than ``max_rows`` rows and their ``_total``, or None when there are none.

    One counting pass with partial sums before its shuffle. The result holds at most rows / ``max_rows`` keys; it is
    stored, and marked for broadcast only when it was counted to be small.
    """
    counted = stored(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_total")).where(F.col("_total") > max_rows), "hot-keys")
    n = counted.count()
    if n == 0:
        return None
    return F.broadcast(counted) if n <= BROADCAST_ROWS else counted


def first_part() -> Column:
    return F.lit(0).cast("bigint")


@dataclass
class Lists:
    """Ordered lists, one row per (key, part); ``split`` tells whether any key has more than the part 0."""

    df: DataFrame
    name: str
    split: bool


def _sort_value(df: DataFrame, name: str, direction: str) -> list[Column]:
    """Null flag and value whose ascending order is the order asked for, nulls last."""
    value, kind = F.col(name), df.schema[name].dataType
    if direction == "desc":
        if isinstance(kind, T.BooleanType):
            value = ~value
        elif isinstance(kind, T.DateType):
            value = -F.unix_date(value)
        elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            value = F.lit("2000-01-01").cast(kind) - value
        elif isinstance(kind, T.NumericType):
            value = -value
        else:
            raise TypeError(f"descending list order is not supported for {kind.simpleString()}")
    return [F.col(name).isNull(), value]


def ordered_lists(df: DataFrame, key: str, order: Sequence[SortKey], fields: Mapping[str, Column], name: str,
                  max_items: int = 10_000) -> Lists:
    """Child rows of each key as an ordered list of structs.

    A key with more than ``max_items`` children is ranged over several tasks by the list order and cut every
    ``max_items`` rows; the parts in ascending order are the whole list.
    """
    def collect(rows: DataFrame, *group: str) -> DataFrame:
        rank = [c for k, d in order for c in _sort_value(df, k, d)]
        item = F.struct(F.struct(*[r.alias(f"_{i}") for i, r in enumerate(rank)]).alias("_rank"),
                        F.struct(*[c.alias(n) for n, c in fields.items()]).alias("_item"))
        sorted_items = F.sort_array(F.collect_list(item))
        return rows.groupBy(*group).agg(sorted_items["_item"].alias(name))

    df = df.where(F.col(key).isNotNull())
    hot = hot_keys(df, [key], max_items)
    if hot is None:
        return Lists(collect(df, key).withColumn("part", first_part()), name, False)
    usual = collect(df.join(hot, key, "left_anti"), key).withColumn("part", first_part())
    # Row ids follow the order inside a range and leap between ranges: rows rounded down alike are neighbours in the list.
    row_id = F.monotonically_increasing_id()
    crowded = (df.join(hot.select(key), key, "left_semi")
               .repartitionByRange(F.col(key), *order_by(order)).sortWithinPartitions(F.col(key), *order_by(order))
               .withColumn("part", row_id - row_id % max_items + 1)
               .repartition(key, "part"))
    # Stored, because ranges are drawn anew whenever the plan runs and every reader must see the same parts.
    return Lists(usual.unionByName(stored(collect(crowded, key, "part"), "crowded")), name, True)


def attach_lists(base: DataFrame, key: str, lists: Sequence[Lists]) -> DataFrame:
    """Base rows with their lists. Keys whose lists come in parts get further rows, numbered by ``part``."""
    if not any(child.split for child in lists):
        out = base.withColumn("part", first_part())
        for child in lists:
            out = out.join(child.df.drop("part"), key, "left")
        return out
    rows = base.select(key, first_part().alias("part"))
    for child in lists:
        rows = rows.unionByName(child.df.select(key, "part"))
    out = base.join(rows.distinct(), key)
    for child in lists:
        out = out.join(child.df, [key, "part"], "left")
    return out
