"""Conversions at ingest, as column expressions: missing texts, nanosecond times, names of paths, calendars."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fill_missing(text: Column, fill: str = "") -> Column:
    """A text column without nulls: what is missing has the fill value."""
    return F.coalesce(text, F.lit(fill))


def timestamp_to_ns(ts: Column) -> Column:
    """Nanoseconds since the epoch of a timestamp with or without time zone (taken as UTC)."""
    return F.unix_micros(ts.cast("timestamp")) * 1000


def ns_to_timestamp(ns: Column) -> Column:
    """A timestamp without zone, cut to microseconds; the canonical value stays the integer."""
    return F.timestamp_micros(F.call_function("div", ns - F.pmod(ns, F.lit(1000)), F.lit(1000))).cast("timestamp_ntz")


def duration_to_ns(interval: Column) -> Column:
    """Nanoseconds of a day-time interval."""
    return (F.extract(F.lit("DAY"), interval) * 86_400_000_000_000 + F.extract(F.lit("HOUR"), interval) * 3_600_000_000_000 + F.extract(F.lit("MINUTE"), interval) * 60_000_000_000).cast("long") + (F.extract(F.lit("SECOND"), interval) * 1_000_000_000).cast("long")


def dataset_name(path: Column) -> Column:
    """The last part of a path, with its suffix."""
    return F.element_at(F.split(path, "/"), -1)


def valid_name(name: Column) -> Column:
    """Whether a text may name a dataset or array."""
    return F.coalesce((name != "") & ~name.startswith("_") & ~name.contains("/") & ~name.isin(".", ".."), F.lit(False))


def day_number(year: Column, month: Column, day: Column, calendar: str = "julian") -> Column:
    """Days since 1970-01-01 (Gregorian) of a date of the Julian or proleptic Gregorian calendar."""
    a = F.floor((14 - month) / 12)
    y, m = year + 4800 - a, month + 12 * a - 3
    number = day + F.floor((153 * m + 2) / 5) + 365 * y + F.floor(y / 4)
    if calendar == "julian":
        return (number - 32083 - 2440588).cast("long")
    if calendar in ("proleptic_gregorian", "gregorian_only"):
        return (number - F.floor(y / 100) + F.floor(y / 400) - 32045 - 2440588).cast("long")
    if calendar in ("standard", "gregorian"):  # Julian before 1582-10-15
        late = (year > 1582) | ((year == 1582) & ((month > 10) | ((month == 10) & (day >= 15))))
        return F.when(late, day_number(year, month, day, "gregorian_only")).otherwise(day_number(year, month, day, "julian"))
    from ..errors import UnsupportedType

    raise UnsupportedType(f"a date of the calendar {calendar!r} names no instant")


def calendar_to_ns(year: Column, month: Column, day: Column, nanos_of_day: Column | None = None, calendar: str = "julian") -> Column:
    """Nanoseconds since the epoch of a calendar date; null where the date is null, an error beyond 1677-09-21 to 2262-04-11."""
    days = day_number(year, month, day, calendar)
    out = F.try_add(F.try_multiply(days, F.lit(86_400_000_000_000).cast("long")), nanos_of_day if nanos_of_day is not None else F.lit(0).cast("long"))
    return F.when(days.isNull() | out.isNotNull(), out).otherwise(F.raise_error(F.lit("a date is out of the range of nanosecond timestamps")))


def julian_to_gregorian(year: Column, month: Column, day: Column) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), day_number(year, month, day, "julian").cast("int"))
