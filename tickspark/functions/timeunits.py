"""Nanosecond stamps and durations: parsing, printing and window labels."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND = 10**9

#: Duration suffixes and their length in nanoseconds (months and years are calendar units, see calendar_unit).
UNITS = {"": SECOND, "s": SECOND, "ns": 1, "us": 10**3, "ms": 10**6, "m": 60 * SECOND, "h": 3600 * SECOND, "d": 86400 * SECOND, "w": 7 * 86400 * SECOND}
CALENDAR = {"d": "day", "mo": "month", "y": "year"}


def duration(text: str | int) -> int:
    """A duration in nanoseconds: a number of seconds, or a number with a suffix. An int is nanoseconds already."""
    if isinstance(text, int):
        return text
    m = re.fullmatch(r"([+-]?\d+)(?:\.(\d{1,9}))?([a-z]*)", text.strip())
    if not m or m[3] not in UNITS:
        raise ValueError(f"not a duration: {text!r}")
    unit, sign = UNITS[m[3]], -1 if m[1].startswith("-") else 1
    part = int(m[2].ljust(9, "0")) * unit // SECOND if m[2] else 0
    return int(m[1]) * unit + sign * part


def calendar_unit(text: str | int) -> tuple[int, str] | None:
    """(number, day, month or year) of a calendar duration such as d, 2mo or 1y, else None."""
    m = re.fullmatch(r"(\d*)(d|mo|y)", text.strip()) if isinstance(text, str) else None
    return (int(m[1] or 1), CALENDAR[m[2]]) if m else None


def parse_stamp(text: Column) -> Column:
    """Nanoseconds of ``seconds[.fraction]``; null unless the fraction has 0, 3, 6 or 9 digits and the seconds are not 0."""
    whole, part = F.split_part(text, F.lit("."), F.lit(1)), F.split_part(text, F.lit("."), F.lit(2))
    valid = text.rlike(r"^\d+(\.(\d{3}|\d{6}|\d{9}))?$") & (whole.try_cast("long") != 0)
    return F.when(valid, whole.try_cast("long") * SECOND + F.rpad(part, 9, "0").try_cast("long"))


def whole(a: Column, b: int | Column) -> Column:
    """Integer quotient rounded down, exact for 64-bit integers."""
    b = F.lit(b) if isinstance(b, int) else b
    return F.call_function("div", a - F.pmod(a, b), b)


def format_stamp(t: Column) -> Column:
    """Seconds with nine decimals."""
    return F.concat(whole(t, SECOND).cast("string"), F.lit("."), F.lpad(F.pmod(t, F.lit(SECOND)).cast("string"), 9, "0"))


def label(edge: Column, every: str | int | None) -> Column:
    """A window's label: ALL, the upper edge as a stamp, or the calendar day, month or year before the edge."""
    unit = calendar_unit(every) if every is not None else None
    if every is None:
        return F.lit("ALL")
    if unit is None:
        return format_stamp(edge)
    at = F.timestamp_seconds(whole(edge, SECOND) - 1)
    return F.date_format(at, {"day": "yyyy-MM-dd", "month": "yyyy-MM", "year": "yyyy"}[unit[1]])
