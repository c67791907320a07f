"""Hashes and packed 64-bit ids. Unsigned 64-bit values are ``decimal(20,0)``, so they order as unsigned."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterable

from pyspark.sql import Column, functions as F

U64 = "decimal(20,0)"
ROW_BITS = 48

# Fixed values of the 64-bit FNV-1a hash.
FNV_OFFSET = 14695981039346656037
FNV_PRIME = 1099511628211


def id_hash(value: Column, fold: Callable[[Column], Column] = F.upper) -> Column:
    """sha256 hex of the trimmed, case-folded id."""
    return F.sha2(fold(F.trim(value)).cast("binary"), 256)


def entity_key(table_name: Column, row_id: Column) -> Column:
    """First eight bytes of md5(``table:row``) as an unsigned number."""
    digest = F.md5(F.concat_ws(":", table_name, row_id.cast("string")))
    return F.conv(F.substring(digest, 1, 16), 16, 10).cast(U64)


def token_hash(token: Column) -> Column:
    """FNV-1a (64 bit) of the lower-cased token.

    The hash is kept as two halves of 32 bits in plain 64-bit numbers, none of which can overflow: the prime is 2^40 + 435.
    """
    digits = F.hex(F.lower(token).cast("binary"))
    value = lambda at: F.instr(F.lit("123456789ABCDEF"), F.substr(digits, at, F.lit(1)))
    byte_values = F.transform(F.sequence(F.lit(1), F.greatest(F.length(digits) / 2, F.lit(1)).cast("int")),
                              lambda i: (value(i * 2 - 1) * 16 + value(i * 2)).cast("bigint"))
    prime, half = FNV_PRIME - 2**40, F.lit(2**32 - 1).cast("bigint")

    def halves(high: Column, low: Column) -> Column:
        return F.struct(high.alias("high"), low.alias("low"))

    def step(acc: Column, byte: Column) -> Column:
        low = acc["low"].bitwiseXOR(byte)
        return halves((acc["high"] * prime + F.shiftright(low * prime, 32) + low * 256).bitwiseAND(half), (low * prime).bitwiseAND(half))

    start = halves(F.lit(FNV_OFFSET >> 32).cast("bigint"), F.lit(FNV_OFFSET & (2**32 - 1)).cast("bigint"))
    whole = lambda acc: (acc["high"].cast(U64) * F.lit(2**32).cast(U64) + acc["low"]).cast(U64)
    return F.when(F.length(token) == 0, whole(start)).otherwise(F.aggregate(byte_values, start, step, whole))


def table_id(name: str) -> int:
    """16-bit id of a table: the top bits of the FNV-1a hash of its name."""
    value = FNV_OFFSET
    for byte in name.encode():
        value = ((value ^ byte) * FNV_PRIME) % 2**64
    return value >> ROW_BITS


def table_id_collisions(names: Iterable[str]) -> dict[int, list[str]]:
    """Table ids that more than one of the tables would share."""
    seen: dict[int, list[str]] = defaultdict(list)
    for name in names:
        seen[table_id(name)].append(name)
    return {k: v for k, v in seen.items() if len(v) > 1}


def pack_global_id(table_name: str, row_id: Column) -> Column:
    """``table id * 2^48 + low 48 bits of the row id``."""
    high = F.lit(str(table_id(table_name) << ROW_BITS)).cast(U64)
    low = row_id.cast("bigint").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    return (high + low).cast(U64)


def unpack_table_id(global_id: Column) -> Column:
    return F.floor(global_id / F.lit(1 << ROW_BITS)).cast("int")


def unpack_row_id(global_id: Column) -> Column:
    return (global_id % F.lit(1 << ROW_BITS)).cast("bigint")
