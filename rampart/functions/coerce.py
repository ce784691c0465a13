"""Typed readings of text values; a null result from a non-null input is a mapping error."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from rampart.functions.ip import canonical_ip
from rampart.functions.text import strip
from rampart.functions.times import parse_ts_ns

# Accepted boolean words.
TRUE_WORDS = ["true", "t", "yes", "y", "1", "on"]
FALSE_WORDS = ["false", "f", "no", "n", "0", "off", ""]

SPARK_TYPES = {"str": "string", "int": "bigint", "float": "double", "bool": "boolean", "ip": "string", "timestamp": "bigint"}


def to_int(c: Column) -> Column:
    """Whole numbers only; ``12.0`` is 12, ``12.5`` and ``True`` are errors."""
    text = strip(c)
    number = text.try_cast("double")
    whole = F.when((number == F.floor(number)) & (F.abs(number) < 9.2e18), number.try_cast("bigint"))
    return F.coalesce(text.try_cast("bigint"), F.when(text.rlike(r"[.eE]"), whole))


def to_bool(c: Column) -> Column:
    word = F.lower(strip(c))
    return F.when(word.isin(TRUE_WORDS), True).when(word.isin(FALSE_WORDS), False)


def coerce(c: Column, kind: str, fmt: str | None = None, tz: str | None = None, now_ns: Column | None = None) -> Column:
    if kind == "str":
        return c
    if kind == "int":
        return to_int(c)
    if kind == "float":
        return strip(c).try_cast("double")
    if kind == "bool":
        return to_bool(c)
    if kind == "ip":
        return canonical_ip(strip(c))
    if kind == "timestamp":
        return parse_ts_ns(c, fmt, tz, now_ns)
    raise ValueError(f"unknown field type {kind!r}")
