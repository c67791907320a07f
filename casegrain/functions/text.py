"""Tokenisers. Each gives an array of tokens per row and stays inside Spark's built-in functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

# Fixed values of the index tokeniser.
INDEX_SEPARATORS = r"[\s.,;:@\-_!?\"'()\[\]{}]+"
STOP_WORDS = ["the", "and", "or", "is", "in", "at", "of", "to", "a", "an", "for", "it", "on", "with", "as", "are",
              "was", "has", "have", "be"]
MIN_TOKEN = 2
MAX_TOKEN = 50

# Separators of the field tokeniser, punctuation the word tokeniser trims, columns never indexed.
FIELD_SEPARATORS = r"[ .,;:@\-_]+"
TRIMMED_PUNCTUATION = r"[.,;:!?\"'()\[\]{}@#$%^&*+\-=<>]+"
SYSTEM_COLUMNS = ["created_at", "updated_at", "deleted_at"]

WHITESPACE = r"[\s\p{Z}]+"
DIGITS_ONLY = r"^[0-9]+$"


def split_words(text: Column) -> Column:
    """Lower-cased words between white space."""
    return F.filter(F.split(F.lower(text), WHITESPACE), lambda w: w != "")


def _indexable(word: Column) -> Column:
    return F.length(word).between(MIN_TOKEN, MAX_TOKEN) & ~word.rlike(DIGITS_ONLY)


def tokens_words(text: Column) -> Column:
    """Distinct words without the punctuation around them; no numbers, 2 to 50 characters."""
    space = WHITESPACE[1:-2]
    # One pass over the text takes the punctuation off all words at once.
    bare = F.regexp_replace(F.lower(text), f"(?<![^{space}]){TRIMMED_PUNCTUATION}|{TRIMMED_PUNCTUATION}(?![^{space}])", "")
    return F.filter(F.array_distinct(F.split(bare, WHITESPACE)), _indexable)


def tokens_index(text: Column) -> Column:
    """Distinct tokens between white space and punctuation; no stop words, no numbers, 2 to 50 characters."""
    words = F.filter(F.split(F.lower(F.trim(text)), INDEX_SEPARATORS), _indexable)
    return F.array_except(words, F.array(*[F.lit(w) for w in STOP_WORDS]))  # also leaves each token once


def tokens_alnum(text: Column) -> Column:
    """Runs of a-z and 0-9 of the lower-cased text, repeats kept."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def tokens_fields(*fields: Column) -> Column:
    """Distinct tokens of several fields, 2 to 50 characters."""
    joined = F.lower(F.concat_ws(" ", *[F.coalesce(f, F.lit("")) for f in fields]))
    return F.array_distinct(F.filter(F.split(joined, FIELD_SEPARATORS), lambda w: F.length(w).between(MIN_TOKEN, MAX_TOKEN)))


def _field_tokens(field: T.StructField) -> Column | None:
    value, kind = F.col(field.name), field.dataType
    if isinstance(kind, T.StringType):
        return F.coalesce(split_words(value), F.array().cast("array<string>"))
    if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        return F.array(value.try_cast("decimal(38,2)").cast("string"))
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.array(*[F.date_format(value, p) for p in ("yyyy", "yyyy-MM", "yyyy-MM-dd")])
    if isinstance(kind, (T.IntegralType, T.BooleanType)):
        return F.array(value.cast("string"))
    return None


def all_tokens(schema: T.StructType, key: str, skip: Sequence[str] = SYSTEM_COLUMNS) -> Column:
    """Tokens of a whole row by column type, repeats included: words of text, plain integers and booleans, numbers
    with two decimals, dates as year, month and day. The key and system columns are left out."""
    parts = [t for f in schema.fields if f.name != key and f.name not in skip and (t := _field_tokens(f)) is not None]
    return F.concat(*parts) if parts else F.array().cast("array<string>")


def plain_text(field: T.StructField) -> Column:
    """Text in which every token of the field occurs."""
    if isinstance(field.dataType, (T.FloatType, T.DoubleType, T.DecimalType)):
        return F.col(field.name).try_cast("decimal(38,2)").cast("string")
    return F.col(field.name).cast("string")


def tokens_typed(schema: T.StructType, key: str, skip: Sequence[str] = SYSTEM_COLUMNS) -> Column:
    """Distinct tokens of a whole row without single characters."""
    return F.array_distinct(F.filter(all_tokens(schema, key, skip), lambda w: w.isNotNull() & (F.length(w) >= MIN_TOKEN)))


def read_tagged_lines(lines: DataFrame) -> DataFrame:
    """(record_id, text) from ``id<TAB>text`` lines; blank lines, ``#`` lines and other ids are skipped."""
    line = F.trim(F.col("value"))
    parts = F.split(line, "\t", 2)
    kept = lines.where((line != "") & ~line.startswith("#") & F.trim(parts[0]).rlike(r"^\d+$") & (F.size(parts) == 2))
    return kept.select(F.trim(parts[0]).cast("bigint").alias("record_id"), parts[1].alias("text"))
