"""Value checks as Columns (a matcher's ``validate`` is any ``Column -> Column``)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def luhn_ok(value: Column) -> Column:
    digits = F.regexp_replace(value, r"[^0-9]", "")
    return (F.length(digits) >= 2) & F.call_function("luhn_check", digits)


def ipv4_ok(value: Column) -> Column:
    """Four octets 0-255 without leading zeros."""
    return F.coalesce(
        F.regexp_like(value, F.lit(r"\A(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?:\.|\z)){4}\z"))
        & ~F.endswith(value, F.lit(".")), F.lit(False))


def jwt_ok(value: Column) -> Column:
    """The first segment decodes to a JSON object that has an ``alg`` key."""
    head = F.translate(F.split_part(value, F.lit("."), F.lit(1)), "-_", "+/")
    padded = F.rpad(head, (F.ceil(F.length(head) / 4) * 4).cast("int"), "=")
    text = F.try_to_binary(padded, F.lit("base64")).cast("string")
    return F.coalesce(F.array_contains(F.json_object_keys(text), "alg"), F.lit(False))


def mask_value(value: Column) -> Column:
    """First two characters, up to eight bullets, last character; short values fully hidden."""
    v = F.trim(value)
    n = F.length(v)
    return F.when(n <= 4, F.lit("••••")).otherwise(
        F.concat(F.substring(v, 1, 2), F.repeat(F.lit("•"), F.least(F.lit(8), n - 3)), F.right(v, F.lit(1))))
