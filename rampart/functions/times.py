"""Timestamp text to UTC epoch nanoseconds, and nanoseconds to dates and windows."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from rampart.functions.text import strip

NS = 1_000_000_000
# At or above this magnitude an epoch number is in milliseconds, below in seconds.
EPOCH_MS_FROM = 100_000_000_000

_DIRECTIVES = {
    "Y": "yyyy", "y": "yy", "m": "M", "d": "d", "H": "H", "I": "h", "M": "m", "S": "s",
    "f": "[SSSSSS][SSSSS][SSSS][SSS][SS][S]", "b": "MMM", "B": "MMMM",
    "p": "a", "j": "D", "z": "[XXX][XX][X]", "Z": "z", "%": "'%'",
}
_MONTH = "(?iu)^(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)"
# Further layouts in order, each with what its texts begin with: a layout that does not fit costs an exception per row.
_OTHER_LAYOUTS = [
    ("yyyy/M/d H:m:s", r"^[+-]?\d+/"), ("M/d/yyyy H:m:s", r"^[+-]?\d+/"), ("MMM d yyyy H:m:s", _MONTH), ("d MMM yyyy H:m:s", r"^[+-]?\d+ \D"),
    ("MMM d, yyyy H:m:s", _MONTH), ("MMM d H:m:s yyyy", _MONTH), ("d MMM yyyy H:m:s XX", r"^[+-]?\d+ \D"),
    ("yyyyMMdd'T'HHmmss[XX][XXX][X]", r"^[+-]?\d+[Tt]"), ("yyyyMMdd", r"^[+-]?\d+\z"), ("d/MMM/yyyy H:m:s", r"^[+-]?\d+/\D"), ("yyyy/M/d", r"^[+-]?\d+/"),
]
_WEEKDAY = "^(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)[a-z]*,? "
_UNIT_SECONDS = {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}


def floor_div(c: Column, n: int) -> Column:
    """Floor division of whole numbers; nanoseconds do not fit a double exactly."""
    by = F.lit(n).cast("bigint")
    return F.call_function("div", c - F.pmod(c, by), by)


def to_timestamp(ns: Column) -> Column:
    """The UTC timestamp of nanoseconds, cut to microseconds."""
    return F.timestamp_micros(floor_div(ns, 1000))


def java_layout(fmt: str) -> str:
    """A strptime layout as a Spark datetime pattern."""

    def one(match: re.Match) -> str:
        if match.group(1):
            return _DIRECTIVES[match.group(1)]
        return "'" + match.group(0).replace("'", "''") + "'"

    return re.sub(r"%(.)|[^%]+", one, fmt)


def to_ns(ts: Column) -> Column:
    return F.unix_micros(ts) * 1000


def _epoch_ns(text: Column) -> Column:
    number = text.try_cast("decimal(30,12)")
    scale = F.when(F.abs(number) >= EPOCH_MS_FROM, F.lit(1_000_000)).otherwise(F.lit(NS))
    return F.bround(number * scale.cast("decimal(10,0)"), 0).try_cast("bigint")


def _in_zone(ts: Column, tz: str | None) -> Column:
    return ts if tz in (None, "UTC") else F.to_utc_timestamp(ts, tz)


def _yearless(text: Column, now_ns: Column, tz: str | None) -> Column:
    """``Oct 11 22:14:15`` bound to the year of ``now_ns``; one year back for 29 February
    in a common year or a moment after ``now_ns``."""
    now = to_timestamp(now_ns)
    year = F.year(now)
    at = lambda y: _in_zone(F.try_to_timestamp(F.concat_ws(" ", y.cast("string"), F.initcap(text)), F.lit("yyyy MMM d H:m:s")), tz)
    guess, prior = at(year), at(year - 1)
    return F.when(guess.isNull(), prior).when(guess > now, F.coalesce(prior, guess)).otherwise(guess)


def parse_ts_ns(c: Column, fmt: str | None = None, tz: str | None = None, now_ns: Column | None = None) -> Column:
    """Nanoseconds for a timestamp text; null when it cannot be read.

    Epoch numbers, an explicit ``fmt`` (strptime letters), syslog time without a year
    (resolved against ``now_ns``, normally the row's ingest time) and ISO 8601 are
    read. ``tz`` applies to values without an offset.
    """
    if fmt is not None:
        ts = F.try_to_timestamp(c, F.lit(java_layout(fmt)))
        return to_ns(ts if "%z" in fmt else _in_zone(ts, tz))
    text = F.regexp_replace(strip(c), r"\s+", " ")
    now_ns = F.unix_micros(F.current_timestamp()) * 1000 if now_ns is None else now_ns
    zoned = text.rlike(r"(?:Z|[+-]\d{2}:?\d{2}|[+-]\d{2})\z") & text.rlike(r"\d[T ]?\d{2}:?\d{2}")
    local = lambda ts: ts if tz in (None, "UTC") else F.when(zoned, ts).otherwise(_in_zone(ts, tz))
    iso = local(text.try_cast("timestamp"))
    undayed = F.regexp_replace(text, _WEEKDAY, "")
    other = local(F.coalesce(*[F.when(undayed.rlike(begin), F.try_to_timestamp(undayed, F.lit(p))) for p, begin in _OTHER_LAYOUTS]))
    return (
        F.when(text.rlike(r"^-?\d+(?:\.\d+)?\z"), _epoch_ns(text))
        .when(text.rlike(r"^[A-Za-z]{3} \d{1,2} \d{2}:\d{2}:\d{2}\z"), to_ns(_yearless(text, now_ns, tz)))
        .when(text.rlike(r"^\d{4}-\d{2}-\d{2}(?:[T ]|\z)") & iso.isNotNull(), to_ns(iso))
        .otherwise(to_ns(other))
    )


def event_date(time_ns: Column, ingest_ns: Column | None = None) -> Column:
    """UTC ``yyyy-MM-dd`` of an event, from the ingest time when it has none."""
    ns = F.nullif(time_ns, F.lit(0).cast("bigint"))
    ns = ns if ingest_ns is None else F.coalesce(ns, ingest_ns)
    return F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), floor_div(ns, 86400 * NS).cast("int")), "yyyy-MM-dd")


def hour_of_day(ns: Column) -> Column:
    return F.pmod(floor_div(ns, 3600 * NS), F.lit(24)).cast("int")


def day_of_week(ns: Column) -> Column:
    """0 = Monday .. 6 = Sunday (the epoch began on a Thursday)."""
    return F.pmod(floor_div(ns, 86400 * NS) + 3, F.lit(7)).cast("int")


def seconds(interval: str | int) -> int:
    """``"5 minutes"``, ``"5m"``, ``"5min"`` or a number of seconds."""
    if isinstance(interval, int):
        return interval
    m = re.fullmatch(r"\s*(\d+)\s*(s|m|h|d|w)[a-z]*\s*", interval, re.IGNORECASE)
    if m is None:
        raise ValueError(f"invalid interval {interval!r}; expected '<n> <second|minute|hour|day|week>'")
    return int(m.group(1)) * _UNIT_SECONDS[m.group(2).lower()]


def floor_ns(ns: Column, width_s: int, origin_s: int = 0) -> Column:
    """Start of the tumbling window of ``width_s`` seconds that holds ``ns``."""
    width, origin = width_s * NS, origin_s * NS
    return ns - F.pmod(ns - origin, F.lit(width).cast("bigint"))
