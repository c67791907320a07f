"""Row predicates: equality, text search, ranges, validity, lookups by key."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from datetime import datetime
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T


def all_of(conditions: Iterable[Column]) -> Column:
    return reduce(and_, conditions, F.lit(True))


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(or_, conditions, F.lit(False))


def typed_literal(value: object, kind: T.DataType) -> Column:
    """A literal of a column's type. A time without zone goes in as text, or the session's zone would shift it."""
    if isinstance(kind, T.TimestampNTZType) and isinstance(value, datetime):
        value = value.isoformat(sep=" ")
    return F.lit(value).cast(kind)


def contains_text(column: Column | str, term: str, wildcards: bool = False) -> Column:
    """Case-insensitive containment. ``%`` and ``_`` are literal unless ``wildcards`` is set."""
    column = F.col(column) if isinstance(column, str) else column
    if wildcards:
        return column.ilike(f"%{term}%")
    return F.contains(F.lower(column), F.lower(F.lit(term)))


def eq_filters(df: DataFrame, filters: Mapping[str, object], allowed: Sequence[str]) -> DataFrame:
    """AND of equalities. Empty values and columns outside ``allowed`` or the schema are ignored."""
    usable = set(allowed) & set(df.columns)
    wanted = [(c, v) for c, v in filters.items() if c in usable and v not in (None, "")]
    return df.where(all_of(F.col(c) == F.lit(v) for c, v in wanted)) if wanted else df


def multi_column_search(df: DataFrame, columns: Sequence[str], term: str,
                        filters: Mapping[str, object] | None = None, wildcards: bool = False) -> DataFrame:
    """Rows in which any of ``columns`` contains ``term`` and all equality filters hold."""
    found = df.where(any_of(contains_text(c, term, wildcards) for c in columns))
    return eq_filters(found, filters or {}, df.columns)


def any_type_search(df: DataFrame, term: str) -> DataFrame:
    """Like ``multi_column_search`` over every column, each read as text."""
    return df.where(any_of(contains_text(F.col(c).cast("string"), term) for c in df.columns))


def multi_filter(df: DataFrame, statuses: Sequence[str] | None = None, dob_from: str | None = None,
                 dob_to: str | None = None, risk_min: int | None = None, risk_max: int | None = None) -> DataFrame:
    """All supplied criteria must hold; a missing one does not filter."""
    conditions: list[Column] = []
    if statuses is not None:
        conditions.append(F.col("status").isin(list(statuses)))
    if dob_from is not None:
        conditions.append(F.col("date_of_birth") >= F.lit(dob_from).cast("date"))
    if dob_to is not None:
        conditions.append(F.col("date_of_birth") <= F.lit(dob_to).cast("date"))
    if risk_min is not None:
        conditions.append(F.col("risk_score") >= risk_min)
    if risk_max is not None:
        conditions.append(F.col("risk_score") <= risk_max)
    return df.where(all_of(conditions)) if conditions else df


def active_only(df: DataFrame, active: str | None = None, deleted: str | None = None,
                deleted_at: str | None = None) -> DataFrame:
    """Keep live rows by whichever liveness columns the table has."""
    conditions = []
    if active:
        conditions.append(F.col(active))
    if deleted:
        conditions.append(~F.col(deleted).cast("boolean"))
    if deleted_at:
        conditions.append(F.col(deleted_at).isNull())
    return df.where(all_of(conditions))


def current_as_of(df: DataFrame, at: str, valid_from: str, valid_to: str) -> DataFrame:
    """Rows valid at ``at``: start included, end excluded, a null end is open."""
    moment = typed_literal(at, df.schema[valid_from].dataType)
    return df.where((F.col(valid_from) <= moment) & (F.col(valid_to).isNull() | (F.col(valid_to) > moment)))


def get_by_key(df: DataFrame, key: str, wanted: object) -> DataFrame:
    """Rows by key: one value, or a DataFrame holding the keys under the same name."""
    if isinstance(wanted, DataFrame):
        return df.join(wanted.select(key), key, "left_semi")
    return df.where(F.col(key) == F.lit(wanted))
