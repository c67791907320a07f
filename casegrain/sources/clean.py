"""Cleaning after ingest: names, empty rows and columns, types, repeats, nesting, keys."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import chain, count
from operator import and_

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql import types as T

from casegrain.session import stored

EMPTY_SHARE = 0.99  # fixed value: columns emptier than this are dropped


def clean_columns(names: Sequence[str]) -> list[str]:
    """Lower-case names of letters, digits and single underscores; unusable ones are numbered, repeats suffixed."""
    plain = []
    for position, raw in enumerate(names):
        name = "_".join(re.findall(r"[a-z0-9]+", raw.lower()))
        plain.append(f"column_{position}" if not name or name.isdigit() else f"col_{name}" if name[0].isdigit() else name)
    return numbered(plain)


def numbered(names: Sequence[str]) -> list[str]:
    """The names, repeats with the lowest free number from 1; no name is given out twice, also not one that has a number."""
    given: set[str] = set()
    out = []
    for name in names:
        free = next(n for n in chain([name], (f"{name}_{i}" for i in count(1))) if n not in given)
        given.add(free)
        out.append(free)
    return out


def rename_clean(df: DataFrame) -> DataFrame:
    return df.toDF(*clean_columns(df.columns))


def is_blank(name: str) -> Column:
    return F.col(name).isNull() | (F.trim(F.col(name).cast("string")) == "")


def drop_empty_rows(df: DataFrame) -> DataFrame:
    """Without the rows in which every value is null or white space."""
    return df.where(~reduce(and_, [is_blank(c) for c in df.columns]))


def column_emptiness(df: DataFrame) -> DataFrame:
    """(column_name, empty_ratio) of every column, from one pass over all rows."""
    ratios = df.agg(*[F.avg(is_blank(c).cast("double")).alias(c) for c in df.columns])
    return ratios.unpivot([], list(df.columns), "column_name", "empty_ratio")


def empty_columns(df: DataFrame, threshold: float = EMPTY_SHARE) -> set[str]:
    """Columns whose share of empty values is above the threshold (at most one row per column is read back)."""
    return {r["column_name"] for r in column_emptiness(df).where(F.col("empty_ratio") > threshold).collect()}


def drop_empty_columns(df: DataFrame, threshold: float = EMPTY_SHARE) -> DataFrame:
    """Without the columns whose share of empty values is above the threshold."""
    return df.drop(*empty_columns(df, threshold))


def coerce(name: str, target: str) -> Column:
    """Text as BIGINT, NUMERIC or BOOLEAN; what does not parse becomes null, as does ''."""
    value = F.nullif(F.trim(F.col(name)), F.lit(""))
    if target == "BIGINT":
        return value.try_cast("bigint")
    if target == "NUMERIC":
        return F.regexp_replace(F.replace(value, F.lit(","), F.lit("")), r"^\$?€?", "").try_cast("double")
    if target == "BOOLEAN":
        word = F.lower(value)
        return F.when(word.isin("true", "yes", "t", "y", "1"), True).when(word.isin("false", "no", "f", "n", "0"), False)
    return value


def coerce_types(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    return df.select(*[coerce(c, types.get(c, "TEXT")).alias(c) for c in df.columns])


def dedup_rows(df: DataFrame) -> DataFrame:
    """Every different row once."""
    return df.dropDuplicates()


def flatten_json(df: DataFrame) -> DataFrame:
    """Nested objects as ``a_b`` columns, arrays and maps as one JSON text. Names that meet are numbered."""
    def leaves(schema: T.StructType, path: tuple[str, ...]) -> list[tuple[str, Column]]:
        out = []
        for field in schema.fields:
            here = (*path, field.name)
            column = F.col(".".join(f"`{p}`" for p in here))
            if isinstance(field.dataType, T.StructType):
                out += leaves(field.dataType, here)
            elif isinstance(field.dataType, (T.ArrayType, T.MapType)):
                out.append(("_".join(here), F.to_json(column)))
            else:
                out.append(("_".join(here), column))
        return out

    found = leaves(df.schema, ())
    return df.select(*[c.alias(n) for n, (_, c) in zip(numbered([n for n, _ in found]), found)])


def surrogate_key(df: DataFrame, order: Sequence[str], name: str = "s_indx") -> DataFrame:
    """Rows numbered 1, 2, 3 ... in the given order without sorting them in one task.

    Rows are ranged over tasks and stored once; a row's number is its place in its range plus the sizes of the
    ranges before, of which there are as many as tasks.
    """
    low = (1 << 33) - 1  # monotonically_increasing_id keeps the place within the partition in its low 33 bits
    ranged = stored(df.repartitionByRange(*order).sortWithinPartitions(*order)
                    .withColumn("_range", F.spark_partition_id())
                    .withColumn("_place", F.monotonically_increasing_id().bitwiseAND(F.lit(low))), "ranged")
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    numbered = ranged.join(F.broadcast(starts), "_range")  # one row per task of the write above
    return (numbered.withColumn(name, F.col("_start") + F.col("_place") + 1)
            .drop("_range", "_place", "_start"))
