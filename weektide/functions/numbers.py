"""Numeric expressions that stay NULL where pandas would give NaN or infinity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import WindowSpec

from weektide.constants import ZSCORE_EPSILON


def to_double(value: Column) -> Column:
    """Text to number; bad text and NaN are NULL."""
    number = value.try_cast("double")
    return F.when(~F.isnan(number), number)


def coerce_numbers(df: DataFrame, columns: list[str], whole: list[str] = (), fill: float | None = None) -> DataFrame:
    """Coerce columns to numbers in one projection.

    ``whole`` columns become BIGINT. Columns that are numeric already are not parsed
    again, so typed Parquet costs nothing here.
    """
    updates = {}
    for name in columns:
        if name not in df.columns:
            continue
        kind = df.schema[name].dataType
        number = F.col(name) if isinstance(kind, T.IntegralType) else to_double(F.col(name))
        if name in whole:
            number = number.try_cast("bigint")
        updates[name] = number if fill is None else F.coalesce(number, F.lit(fill).cast("bigint" if name in whole else "double"))
    return df.withColumns(updates)


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division whose result is NULL for a zero divisor."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def total(value: Column) -> Column:
    """Sum that is 0 when nothing was added."""
    return F.coalesce(F.sum(value), F.lit(0))


def total_if(condition: Column, value: Column) -> Column:
    """Sum of ``value`` over the rows that meet ``condition``."""
    return total(F.when(condition, value))


def gated(statistic: Column, value: Column, window: WindowSpec, at_least: int) -> Column:
    """Rolling statistic, NULL while the frame holds fewer than ``at_least`` values."""
    return F.when(F.count(value).over(window) >= at_least, statistic.over(window))


def rolling_zscore(name: str, rows: int, at_least: int, key: str = "ticker") -> str:
    """SQL of the z-score of a column over the last ``rows`` rows of its key, ordered by week."""
    frame = f"OVER (PARTITION BY {key} ORDER BY week ROWS {rows - 1} PRECEDING)"
    score = f"({name} - avg({name}) {frame}) / (stddev_samp({name}) {frame} + {ZSCORE_EPSILON}D)"
    return f"CASE WHEN count({name}) {frame} >= {at_least} THEN {score} END"


def complete_rows(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows without a NULL in the given, or in all, columns.

    One condition per column instead of ``na.drop()``: such conditions reach the scan
    one by one, while its single predicate over all columns makes the optimizer derive a
    variant for every combination of renamed columns, which on a panel of a hundred
    columns never ends. NaN cannot occur here, readers turn it into NULL.
    """
    return df.where(" AND ".join(f"`{name}` IS NOT NULL" for name in columns or df.columns))
