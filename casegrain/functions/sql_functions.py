"""The column and table functions as SQL functions: no Python runs when a query calls them."""

from __future__ import annotations

from pyspark.sql import SparkSession

from casegrain.functions.identity import FNV_OFFSET, FNV_PRIME, ROW_BITS
from casegrain.functions.values import ID_PATTERNS


def _keep_last(visible: int, short_prefix: int) -> str:
    return (f"CASE WHEN length(s) < {visible} THEN concat('{'X' * short_prefix}', s) "
            f"ELSE concat(repeat('X', length(s) - {visible}), right(s, {visible})) END")


_CLASSIFY = "CASE " + " ".join(
    f"WHEN {'lower(v)' if kind == 'email' else 'c'} RLIKE r'{pattern}' THEN '{kind}'" for kind, pattern in ID_PATTERNS
) + " ELSE 'general' END"

_DIGITS = "'123456789ABCDEF'"
_BYTES = (f"transform(sequence(1, length(h) div 2), i -> CAST(instr({_DIGITS}, substr(h, CAST(i * 2 - 1 AS INT), 1)) * 16 "
          f"+ instr({_DIGITS}, substr(h, CAST(i * 2 AS INT), 1)) AS BIGINT))")
# The hash as two halves of 32 bits in plain 64-bit numbers, none of which can overflow: the prime is 2^40 + _FNV_LOW.
_FNV_LOW, _HALF = FNV_PRIME - 2**40, 2**32 - 1
_FNV_START = f"named_struct('high', CAST({FNV_OFFSET >> 32} AS BIGINT), 'low', CAST({FNV_OFFSET & _HALF} AS BIGINT))"
_FNV_STEP = (f"named_struct('high', (acc.high * {_FNV_LOW} + shiftright((acc.low ^ b) * {_FNV_LOW}, 32) + (acc.low ^ b) * 256) & CAST({_HALF} AS BIGINT), "
             f"'low', ((acc.low ^ b) * {_FNV_LOW}) & CAST({_HALF} AS BIGINT))")
_FNV_END = "CAST(CAST(acc.high AS DECIMAL(20,0)) * CAST(4294967296 AS DECIMAL(20,0)) + acc.low AS DECIMAL(20,0))"

SCALARS = {
    "classify_value": ("v STRING", "STRING",
                       f"(SELECT {_CLASSIFY} FROM (SELECT upper(regexp_replace(trim(v), '[ /-]', '')) AS c))"),
    "mask_document": ("kind STRING, number STRING", "STRING",
                      "CASE lower(kind) WHEN 'aadhaar' THEN mask_aadhaar(number) WHEN 'pan' THEN mask_pan(number) "
                      "WHEN 'driving_license' THEN mask_driving_license(number) ELSE mask_passport(number) END"),
    "token_hash": ("t STRING", "DECIMAL(20,0)",
                   f"CASE WHEN t = '' THEN CAST({FNV_OFFSET} AS DECIMAL(20,0)) ELSE (SELECT aggregate({_BYTES}, {_FNV_START}, "
                   f"(acc, b) -> {_FNV_STEP}, acc -> {_FNV_END}) FROM (SELECT hex(lower(t)) AS h)) END"),
    "global_id": ("table_id INT, row_id BIGINT", "DECIMAL(20,0)",
                  f"CAST(CAST(table_id AS DECIMAL(20,0)) * {1 << ROW_BITS} + (row_id & {(1 << ROW_BITS) - 1}) AS DECIMAL(20,0))"),
    "mask_aadhaar": ("s STRING", "STRING", "concat('XXXX-XXXX-', right(regexp_replace(s, '[ -]', ''), 4))"),
    "mask_pan": ("s STRING", "STRING",
                 "concat('XXXXX', CASE WHEN length(trim(s)) < 5 THEN upper(trim(s)) ELSE substr(upper(trim(s)), 6) END)"),
    "mask_passport": ("v STRING", "STRING", f"(SELECT {_keep_last(2, 7)} FROM (SELECT upper(trim(v)) AS s))"),
    "mask_driving_license": ("v STRING", "STRING", f"(SELECT {_keep_last(3, 10)} FROM (SELECT upper(trim(v)) AS s))"),
    "mask_phone": ("v STRING", "STRING", f"(SELECT {_keep_last(4, 6)} FROM (SELECT trim(v) AS s))"),
    "mask_bank_account": ("v STRING", "STRING", f"(SELECT {_keep_last(4, 6)} FROM (SELECT trim(v) AS s))"),
    "mask_email": ("s STRING", "STRING",
                   "CASE WHEN instr(trim(s), '@') <= 1 THEN '***@***' "
                   "WHEN instr(trim(s), '@') = 2 THEN concat(left(trim(s), 1), '***', substr(trim(s), 2)) "
                   "ELSE concat(left(trim(s), 1), repeat('*', instr(trim(s), '@') - 2), substr(trim(s), instr(trim(s), '@'))) END"),
    "mask_all_but_four": ("s STRING", "STRING", "regexp_replace(s, r'(?s).(?=.{4})', 'X')"),
    "id_hash": ("s STRING", "STRING", "sha2(upper(trim(s)), 256)"),
    "entity_key": ("t STRING, r STRING", "DECIMAL(20,0)",
                   "CAST(conv(substr(md5(concat_ws(':', t, r)), 1, 16), 16, 10) AS DECIMAL(20,0))"),
}


def register_scalars(spark: SparkSession) -> list[str]:
    """Create the scalar functions for this session and return their names."""
    for name in sorted(SCALARS, key=lambda n: n == "mask_document"):  # the one that calls others comes last
        params, returns, body = SCALARS[name]
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS {returns} RETURN {body}")
    return list(SCALARS)


def register_tables(spark: SparkSession, anchors: str, entities: str, tags: str) -> list[str]:
    """Create the table functions over the named views.

    ``find_entity_by_govt_id(type, number)`` gives the first matching entity,
    ``entities_by_category(id)`` the members of a category.
    """
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION find_entity_by_govt_id(p_type STRING, p_number STRING)
        RETURNS TABLE (entity_id BIGINT, anchor_id BIGINT, is_verified BOOLEAN, entity_status STRING)
        RETURN SELECT e.entity_id, a.id, a.is_verified, e.status FROM {anchors} a JOIN {entities} e ON e.entity_id = a.entity_id
               WHERE a.id_type = p_type AND sha2(upper(trim(a.id_number)), 256) = sha2(upper(trim(p_number)), 256)
               ORDER BY a.id LIMIT 1""")
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION entities_by_category(p_category INT)
        RETURNS TABLE (entity_id BIGINT, assigned_at TIMESTAMP_NTZ)
        RETURN SELECT entity_id, assigned_at FROM {tags} WHERE category_id = p_category""")
    return ["find_entity_by_govt_id", "entities_by_category"]
