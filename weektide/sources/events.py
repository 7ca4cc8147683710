"""Event logs: history files and landed daily drops."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weektide.constants import REQUIRED_EVENT_COLUMNS
from weektide.schemas import LANDED_SCHEMA


def require_columns(df: DataFrame, columns: list[str] = REQUIRED_EVENT_COLUMNS) -> DataFrame:
    missing = [name for name in columns if name not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def stack(frames: list[DataFrame]) -> DataFrame:
    """Bag union by column name; columns a frame lacks become NULL."""
    return reduce(lambda top, below: top.unionByName(below, allowMissingColumns=True), frames)


def read_history(spark: SparkSession, paths: list[str], file_format: str = "csv") -> DataFrame:
    """Stack period files.

    CSV columns are taken by header name and kept as text, so codes keep their zeros;
    ``clean_events`` types them.
    """
    if file_format == "csv":
        return stack([spark.read.option("header", True).csv(path) for path in paths])
    return stack([spark.read.format(file_format).load(path) for path in paths])


def load_events(spark: SparkSession, paths: list[str], file_format: str = "csv") -> DataFrame:
    """History files that must hold every required column."""
    return require_columns(read_history(spark, paths, file_format))


def recent_days(df: DataFrame, as_of: dt.date | str | Column, days: int, column: str = "ingest_date") -> DataFrame:
    """Rows that landed in the ``days`` days up to ``as_of``.

    On a table laid out by ``column`` this prunes partitions, also when ``as_of`` is a
    scalar subquery.
    """
    last = as_of if isinstance(as_of, Column) else F.lit(as_of).cast("date")
    return df.where(F.col(column).between(F.date_sub(last, days - 1), last))


def read_landed(
    spark: SparkSession,
    root: str,
    as_of: dt.date | str,
    days: int,
    file_format: str = "parquet",
    skip_bad_files: bool = True,
) -> DataFrame:
    """Daily drops below ``root/ingest_date=.../``; missing and unreadable files are skipped."""
    reader = (
        spark.read.schema(LANDED_SCHEMA)
        .option("ignoreMissingFiles", skip_bad_files)
        .option("ignoreCorruptFiles", skip_bad_files)
        .option("basePath", root)
    )
    if file_format == "csv":
        reader = reader.option("sep", "\t").option("mode", "PERMISSIVE")
    return recent_days(reader.format(file_format).load(root), as_of, days)
