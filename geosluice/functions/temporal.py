"""Date, datetime, time and time-range functions as Column expressions.

Null gives null throughout.  Datetimes are TIMESTAMP_NTZ read as UTC, epoch
values are milliseconds, weekdays run from Monday = 1 to Sunday = 7."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def weekday(x: Column) -> Column:
    return F.weekday(x) + 1


def date_from_millis(ms: Column) -> Column:
    return F.date_from_unix_date(F.floor(ms / F.lit(86_400_000)).cast("int"))


def date_to_millis(d: Column) -> Column:
    return F.unix_date(d.cast("date")).cast("long") * F.lit(86_400_000)


def date_from_string(text: Column) -> Column:
    """yyyy-MM-dd; anything else is an error."""
    return F.to_date(text, "yyyy-MM-dd")


def date_parse(text: Column, pattern: str) -> Column:
    """Null where the text does not fit the pattern."""
    return F.try_to_date(text, pattern)


def date_format(x: Column, pattern: str) -> Column:
    return F.date_format(x, pattern)


def days_between(first: Column, second: Column) -> Column:
    """Days from the first date to the second, signed."""
    return F.datediff(second, first).cast("long")


def datetime_from_millis(ms: Column) -> Column:
    return F.timestamp_millis(ms).cast("timestamp_ntz")


def datetime_to_millis(ts: Column) -> Column:
    return F.unix_millis(ts.cast("timestamp"))


def datetime_from_string(text: Column) -> Column:
    """ISO text, yyyy-MM-ddTHH:mm with optional seconds and fractions; anything else is an error."""
    iso = text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]{1,9})?)?$")
    return F.when(text.isNull() | iso, text.cast("timestamp_ntz")).otherwise(F.raise_error(F.concat(F.lit("not an ISO datetime: "), text)).cast("timestamp_ntz"))


def datetime_to_string(ts: Column) -> Column:
    """ISO text: seconds only if there are any, fractions in groups of three digits."""
    us = F.unix_micros(ts.cast("timestamp"))
    pattern = lambda p: F.date_format(ts, p)
    return (
        F.when(us % 60_000_000 == 0, pattern("yyyy-MM-dd'T'HH:mm"))
        .when(us % 1_000_000 == 0, pattern("yyyy-MM-dd'T'HH:mm:ss"))
        .when(us % 1_000 == 0, pattern("yyyy-MM-dd'T'HH:mm:ss.SSS"))
        .otherwise(pattern("yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    )


def datetime_parse(text: Column, pattern: str) -> Column:
    return F.try_to_timestamp(text, F.lit(pattern)).cast("timestamp_ntz")


def datetime_between(x: Column, begin: Column, end: Column) -> Column:
    """Both ends included, compared in milliseconds."""
    return datetime_to_millis(x).between(datetime_to_millis(begin), datetime_to_millis(end))


def time_to_string(t: Column) -> Column:
    """HH:mm, with seconds if there are any, fractions in groups of three digits."""
    return F.substring_index(datetime_to_string(_on_day(t)), "T", -1)


def _on_day(t: Column) -> Column:
    return F.make_timestamp_ntz(date=F.lit("1970-01-01").cast("date"), time=t)


def time_format(t: Column, pattern: str) -> Column:
    return F.date_format(_on_day(t), pattern)


def time_from_string(text: Column) -> Column:
    return text.cast("time(6)")


def time_parse(text: Column, pattern: str) -> Column:
    """Null where the text does not fit the pattern."""
    return F.date_format(datetime_parse(text, pattern), "HH:mm:ss.SSSSSS").cast("time(6)")


def date_now() -> Column:
    return F.current_date()


def datetime_now() -> Column:
    """The time of the query's start, the same for all rows."""
    return F.current_timestamp().cast("timestamp_ntz")


def time_now() -> Column:
    return F.date_format(datetime_now(), "HH:mm:ss.SSSSSS").cast("time(6)")


def date_from_object(value: Column, kind: str) -> Column:
    """A date from a date, a datetime, epoch milliseconds or text, by the type `kind` of the value."""
    if kind in ("long", "bigint"):
        return date_from_millis(value)
    return date_from_string(value) if kind == "string" else value.cast("date")


def at_time(d: Column, t: Column) -> Column:
    return F.make_timestamp_ntz(date=d, time=t)


def time_range(begin: Column, end: Column) -> Column:
    return F.struct(datetime_to_millis(begin).alias("start_ms"), datetime_to_millis(end).alias("end_ms"))


def ranges_overlap(a: Column, b: Column) -> Column:
    return (a["start_ms"] < b["end_ms"]) & (b["start_ms"] < a["end_ms"])


def range_contains(r: Column, ms: Column) -> Column:
    return (r["start_ms"] <= ms) & (ms < r["end_ms"])
