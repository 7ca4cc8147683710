"""Daily prices in one long table for all tickers."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weektide.constants import LIVE_PRICE_YEARS
from weektide.functions.numbers import to_double
from weektide.schemas import PRICE_SCHEMA


def read_prices(spark: SparkSession, path: str, file_format: str = "parquet") -> DataFrame:
    reader = spark.read.schema(PRICE_SCHEMA)
    if file_format == "csv":
        reader = reader.option("header", True)
    return reader.format(file_format).load(path)


def daily_prices(prices: DataFrame, tickers: list[str] | None = None) -> DataFrame:
    """``(ticker, d, px)`` with the adjusted close where there is one, else the close.

    ``tickers`` reaches the scan as a filter, so one plan serves every ticker.
    """
    if tickers is not None:
        prices = prices.where(F.col("ticker").isin(tickers))
    price = to_double(F.col("close"))
    if "adj_close" in prices.columns:
        price = F.coalesce(to_double(F.col("adj_close")), price)
    return prices.select("ticker", F.col("date").alias("d"), price.alias("px"))


def recent_prices(prices: DataFrame, as_of: dt.date | str | Column, years: int = LIVE_PRICE_YEARS) -> DataFrame:
    last = as_of if isinstance(as_of, Column) else F.lit(as_of).cast("date")
    return prices.where(F.col("d").between(F.add_months(last, -12 * years), last))


def price_range(prices: DataFrame, start: str, end: str) -> DataFrame:
    """Prices from ``start`` up to, without, ``end``."""
    day = F.col("d")
    return prices.where((day >= F.lit(start).cast("date")) & (day < F.lit(end).cast("date")))


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """Fail when a source has no row at all; reads one row."""
    if df.isEmpty():
        raise ValueError(f"no rows: {what}")
    return df
