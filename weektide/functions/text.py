"""Cleaning of code columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def zero_pad(code: Column, length: int) -> Column:
    """Left-pad with zeros; longer codes stay whole (``lpad`` alone would cut them)."""
    return F.when(F.length(code) < length, F.lpad(code, length, "0")).otherwise(code)


def strip_float_suffix(code: Column) -> Column:
    """Undo the ``.0`` a numeric column leaves on a code, also with blanks around it."""
    return F.regexp_replace(F.trim(code), r"\.0$", "")


def root_of(code: Column) -> Column:
    return F.substring(code, 1, 2)
