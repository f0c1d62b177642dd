"""Placeholders: ``[LABEL_hhhhhh]`` from a salted 32-bit FNV-1a hash."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# FNV-1a parameters and the shape of a placeholder.
FNV_OFFSET, FNV_PRIME = 2166136261, 16777619
PLACEHOLDER = r"\[[A-Z0-9_]+_[0-9a-f]{6}(?:_[0-9]+)?\]"


def fnv1a6(text: Column) -> Column:
    """First six of eight hex digits, hashing the UTF-16 code units of ``text``."""
    units = F.regexp_extract_all(F.hex(F.encode(text, "UTF-16BE")), F.lit("(.{4})"), F.lit(1))
    digest = F.aggregate(
        units, F.lit(FNV_OFFSET).cast("bigint"),
        lambda h, u: F.pmod(h.bitwiseXOR(F.conv(u, 16, 10).cast("bigint")) * FNV_PRIME, F.lit(1 << 32)))
    return F.substring(F.lpad(F.lower(F.hex(digest)), 8, "0"), 1, 6)


def base_of(value: Column, salt: Column) -> Column:
    return fnv1a6(F.concat(salt, F.lit(":"), value))


def compose(label: Column, base: Column, number: Column | None = None) -> Column:
    """``[LABEL_base]``, or ``[LABEL_base_n]`` for the n-th value sharing a base."""
    plain = F.concat(F.lit("["), label, F.lit("_"), base, F.lit("]"))
    if number is None:
        return plain
    numbered = F.concat(F.lit("["), label, F.lit("_"), base, F.lit("_"), number.cast("string"), F.lit("]"))
    return F.when(number == 1, plain).otherwise(numbered)


def mint(label: Column, value: Column, salt: Column) -> Column:
    return compose(label, base_of(value, salt))
