"""Masks for personal identifiers, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _cleaned(value: Column) -> Column:
    return F.upper(F.trim(value))


def keep_last(value: Column, visible: int, short_prefix: int) -> Column:
    """X for all but the last ``visible`` characters; shorter text gets ``short_prefix`` X in front."""
    size = F.length(value)
    return (F.when(size < visible, F.concat(F.lit("X" * short_prefix), value))
            .otherwise(F.concat(F.repeat(F.lit("X"), size - visible), F.right(value, F.lit(visible)))))


def mask_aadhaar(value: Column) -> Column:
    digits = F.regexp_replace(value, "[ -]", "")
    return F.concat(F.lit("XXXX-XXXX-"), F.right(digits, F.lit(4)))


def mask_pan(value: Column) -> Column:
    text = _cleaned(value)
    shown = F.when(F.length(text) < 5, text).otherwise(F.substr(text, F.lit(6)))
    return F.concat(F.lit("XXXXX"), shown)


def mask_passport(value: Column) -> Column:
    """Also the rule for document types without one of their own."""
    return keep_last(_cleaned(value), 2, 7)


def mask_driving_license(value: Column) -> Column:
    return keep_last(_cleaned(value), 3, 10)


def mask_phone(value: Column) -> Column:
    return keep_last(F.trim(value), 4, 6)


def mask_bank_account(value: Column) -> Column:
    return keep_last(F.trim(value), 4, 6)


def mask_email(value: Column) -> Column:
    text = F.trim(value)
    at = F.instr(text, "@")
    user = F.substr(text, F.lit(1), at - 1)
    hidden = F.when(at == 2, F.lit("***")).otherwise(F.repeat(F.lit("*"), at - 2))
    return (F.when(at <= 1, F.lit("***@***"))
            .otherwise(F.concat(F.left(user, F.lit(1)), hidden, F.substr(text, at))))


def mask_document(kind: Column, number: Column, stored: Column | None = None) -> Column:
    """Mask by document type; a mask stored with the record wins."""
    kind = F.lower(kind)
    computed = (F.when(kind == "aadhaar", mask_aadhaar(number))
                .when(kind == "pan", mask_pan(number))
                .when(kind == "driving_license", mask_driving_license(number))
                .otherwise(mask_passport(number)))
    return computed if stored is None else F.coalesce(F.nullif(stored, F.lit("")), computed)


def mask_all_but_four(value: Column) -> Column:
    """X for every character that has four more behind it; up to four characters stay as they are."""
    return F.regexp_replace(value, "(?s).(?=.{4})", "X")
