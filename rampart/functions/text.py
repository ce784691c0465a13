"""Text column helpers: raw-byte decoding, one-pass regex capture, canonical JSON."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# Separator used to read all groups of one regex match in a single pass. Lines
# that contain it take the group-by-group path, so results never depend on it.
_SEP = "\u0001"
_WHITESPACE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    """Trim whitespace and control separators on both ends."""
    return F.btrim(c, F.lit(_WHITESPACE))


def decode_text(raw: Column) -> Column:
    """Bytes to text: a leading UTF-8/UTF-16 mark is dropped, bad bytes become U+FFFD."""
    head = F.hex(F.substring(raw, 1, 3))
    size = F.octet_length(raw)
    return (
        F.when(head == "EFBBBF", F.make_valid_utf8(F.substring(raw, F.lit(4), size).cast("string")))
        .when(head.startswith("FFFE"), F.decode(F.substring(raw, F.lit(3), size), "UTF-16LE"))
        .when(head.startswith("FEFF"), F.decode(F.substring(raw, F.lit(3), size), "UTF-16BE"))
        .otherwise(F.make_valid_utf8(raw.cast("string")))
    )


def has_bom(raw: Column) -> Column:
    head = F.hex(F.substring(raw, 1, 3))
    return (head == "EFBBBF") | head.startswith("FFFE") | head.startswith("FEFF")


def capture(c: Column, pattern: str, groups: int) -> Column:
    """All groups of the first match of ``pattern`` as an array.

    Element 0 is empty, element ``i`` is group ``i`` (empty when it took no part);
    an array of one element means no match. The pattern is anchored here, so one
    regex pass yields every group.
    """
    anchored = pattern.startswith(("^", "(?>^"))
    whole = rf"{'' if anchored else '^[^]*?'}(?:{pattern})[^]*".replace("[^]", r"[\s\S]") + r"\z"
    replacement = _SEP + _SEP.join(f"${i}" for i in range(1, groups + 1))
    one_pass = F.split(F.regexp_replace(c, F.lit(whole), F.lit(replacement)), _SEP, -1)
    each = F.when(
        c.rlike(pattern),
        F.array(F.lit(""), *[F.regexp_extract(c, pattern, i) for i in range(1, groups + 1)]),
    ).otherwise(F.array(c))
    return F.when(F.contains(c, F.lit(_SEP)), each).otherwise(one_pass)


def matched(groups: Column) -> Column:
    return F.size(groups) > 1


def group(groups: Column, i: int) -> Column:
    """Group ``i`` of a :func:`capture` result; null when there was no match."""
    return F.get(groups, F.lit(i))


def non_empty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def sorted_map(m: Column) -> Column:
    """``m`` without null values, keys in ascending order."""
    return F.map_from_entries(F.array_sort(F.map_entries(F.map_filter(m, lambda k, v: v.isNotNull()))))


def canonical_json(m: Column) -> Column:
    """Compact JSON with sorted keys; null for a null or empty map."""
    ordered = sorted_map(m)
    return F.when(F.size(ordered) > 0, F.to_json(ordered))
