"""Scalar expressions shared by several operators."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed pattern: ISO-8601 date and time with an explicit offset.
ISO_WITH_OFFSET = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?(Z|[+-]\d{2}(:?\d{2})?)$"


# Fixed pattern: a sign that is no white space of any kind, controls and wide spaces included.
NOT_BLANK = r"[^\s\x1C-\x1F\u1680\u2000-\u2006\u2008-\u200A\u2028\u2029\u205F\u3000]"


def is_blank(c: Column) -> Column:
    return c.isNull() | ~c.rlike(NOT_BLANK)


def blank_to_null(c: Column) -> Column:
    return F.when(c.rlike(NOT_BLANK), c)


def as_instant(value: datetime | str | Column) -> Column:
    """A point in time as TIMESTAMP; naive datetimes and zone-less text are taken as UTC."""
    if isinstance(value, Column):
        return value.cast("timestamp")
    text = value if isinstance(value, str) else value.isoformat(sep=" ")
    return F.lit(text).cast("timestamp")


def utc_millis(text: Column) -> Column:
    """ISO-8601 text with any offset to its instant, cut to milliseconds; anything else gives NULL."""
    instant = F.when(text.rlike(ISO_WITH_OFFSET), text).try_cast("timestamp")
    return F.date_trunc("millisecond", instant)


def event_month(ts: Column) -> Column:
    """The month partition value, such as 202401."""
    return F.date_format(ts, "yyyyMM").cast("int")


def since_month(df: DataFrame, since: Column, to: Column | None = None) -> DataFrame:
    """``df`` without months before ``since`` or after ``to``; stored tables then skip their partitions."""
    if "event_month" not in df.columns:
        return df
    df = df.filter(F.col("event_month") >= event_month(since))
    return df if to is None else df.filter(F.col("event_month") <= event_month(to))


def plain(ts: Column) -> Column:
    """A TIMESTAMP as the zone-less UTC value shown in results."""
    return ts.cast("timestamp_ntz")


def endpoint_path(url: Column) -> Column:
    """Path of an absolute URL, otherwise the text before ``?``."""
    absolute = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"
    path = F.regexp_extract(url, absolute, 1)
    return F.when(url.rlike(absolute), F.when(path == "", "/").otherwise(path)).otherwise(F.split_part(url, F.lit("?"), F.lit(1)))


def http_method(method: Column) -> Column:
    return F.upper(F.coalesce(method, F.lit("GET")))


def error_name(name: Column) -> Column:
    return F.coalesce(blank_to_null(name), F.lit("Error"))


def dead_letter_topic(topic: Column) -> Column:
    return F.replace(topic, F.lit(".raw"), F.lit(".dlq"))


def compact_number(n: Column) -> Column:
    """12345 as 12.3K, 1200000 as 1.2M, smaller values with no decimals."""
    x = n.cast("double")
    return (
        F.when(x >= 1_000_000, F.format_string("%.1fM", x / 1_000_000))
        .when(x >= 1_000, F.format_string("%.1fK", x / 1_000))
        .otherwise(F.format_string("%.0f", x))
    )


def minutes_back(as_of: Column, ts: Column) -> Column:
    """Smallest whole window, in minutes before ``as_of``, that still reaches back to ``ts``.

    ``ts >= as_of - w minutes`` holds exactly when this value is ``<= w``, so telemetry can be
    summed per value before any rule, with whatever window, is looked at.
    """
    return F.ceil((F.unix_micros(as_of) - F.unix_micros(ts)) / F.lit(60_000_000.0)).cast("long")
