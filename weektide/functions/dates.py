"""Calendar expressions. Weeks start on Monday."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_day(text: Column, strict: bool = False) -> Column:
    """``yyyyMMdd`` text to DATE; bad text is NULL, or an error when ``strict``."""
    parse = F.to_date if strict else F.try_to_date
    return parse(text.cast("string"), "yyyyMMdd")


def monday_of(day: Column) -> Column:
    """Monday that opens the Monday-to-Sunday week of ``day``."""
    return F.trunc(day, "week")


def closing_monday(day: Column) -> Column:
    """Monday that closes the Tuesday-to-Monday price week of ``day``."""
    return F.next_day(F.date_sub(day, 1), "MON")


def day_start(day: Column) -> Column:
    """Instant of UTC midnight, whatever the session time zone is."""
    return F.timestamp_seconds(F.unix_date(day) * F.lit(86400))


def day_of_instant(instant: Column) -> Column:
    """Inverse of :func:`day_start`."""
    return F.date_from_unix_date(F.floor(F.unix_seconds(instant) / 86400).cast("int"))
