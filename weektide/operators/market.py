"""Weekly market series.

Daily prices are reduced to one row per ticker and week first (map-side combined).
All windows then run on that small frame over one ``partitionBy("ticker")``, whose
rows are bounded by the number of calendar weeks however many prices a ticker has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weektide.constants import (
    DRAWDOWN_WEEKS,
    HORIZON_WEEKS,
    MOMENTUM_WEEKS,
    VOL_WEEKS,
    ZSCORE_MIN_WEEKS,
    ZSCORE_WEEKS,
)
from weektide.functions.dates import closing_monday
from weektide.functions.numbers import gated, ratio, rolling_zscore
from weektide.sources.tables import stored


def by_week(key: str = "ticker") -> WindowSpec:
    return W.partitionBy(key).orderBy("week")


def last_rows(n: int, key: str = "ticker") -> WindowSpec:
    return by_week(key).rowsBetween(-(n - 1), W.currentRow)


def by_ticker(weekly: DataFrame) -> DataFrame:
    """Hash the rows on the ticker. The number of partitions is left to adaptive execution."""
    return weekly.repartition("ticker")


def calendar_side(weekly: DataFrame) -> DataFrame:
    """Mark a frame that is keyed by calendar week alone for broadcast.

    Its size is bounded whatever the volume of events or prices: 52 or 53 rows per year
    of history, and at most about 520,000 over every four-digit year. Nothing keyed by
    ticker or event may be passed here.
    """
    return F.broadcast(weekly)


def weekly_prices(prices: DataFrame) -> DataFrame:
    """Last price of each Tuesday-to-Monday week on a gap-free calendar per ticker.

    Weeks without a price are inserted with a NULL price behind the week before them,
    so no calendar table has to be joined.
    """
    weekly = prices.groupBy("ticker", closing_monday(F.col("d")).alias("week")).agg(
        F.max_by("px", F.when(F.col("px").isNotNull(), F.col("d"))).alias("px")
    )
    weekly = by_ticker(weekly)
    following = F.lead("week").over(by_week())
    last_missing = F.coalesce(F.date_sub(following, 7), F.col("week"))
    weekly = weekly.withColumn("weeks", F.sequence("week", last_missing, F.expr("interval 7 days")))
    return weekly.select("ticker", "px", F.posexplode("weeks").alias("gap", "week")).select(
        "ticker", "week", F.when(F.col("gap") == 0, F.col("px")).alias("px")
    )


def padded(weekly: DataFrame) -> DataFrame:
    """Add the price carried forward over gaps."""
    carried = by_week().rowsBetween(W.unboundedPreceding, W.currentRow)
    return weekly.withColumn("px_padded", F.last("px", ignorenulls=True).over(carried))


def change(price: str, weeks: int) -> Column:
    return ratio(F.col(price), F.lag(price, weeks).over(by_week())) - 1


def weekly_returns(weekly: DataFrame) -> DataFrame:
    """One-week return of the carried price."""
    return padded(weekly).withColumn("weekly_return_current", change("px_padded", 1))


def market_features(weekly: DataFrame) -> DataFrame:
    """Return, volatility, momentum, drawdown and four-week outlook per ticker and week."""
    returns = F.col("weekly_return_current")
    columns = {f"vol_{n}w": gated(F.stddev_samp(returns), returns, last_rows(n), n) for n in VOL_WEEKS}
    columns |= {f"momentum_{n}w": change("px_padded", n) for n in MOMENTUM_WEEKS}
    peak = gated(F.max("px"), F.col("px"), last_rows(DRAWDOWN_WEEKS), DRAWDOWN_WEEKS)
    columns["drawdown_26w"] = ratio(F.col("px"), peak) - 1
    columns["future_return_4w"] = ratio(F.lead("px", HORIZON_WEEKS).over(by_week()), F.col("px")) - 1
    out = weekly_returns(weekly)
    return out.select(
        "ticker",
        "week",
        F.col("px").alias("weekly_price"),
        "weekly_return_current",
        *[column.alias(name) for name, column in columns.items()],
    )


def with_volatility_index(market: DataFrame, index_weekly: DataFrame, missing: str = "null") -> DataFrame:
    """Level, first difference and 52-week z-score of the volatility index.

    The index is aligned to each ticker's calendar before the windows run. With
    ``missing="zero"`` all three are 0 if the index has no price at all; a gap in it stays
    NULL, for ``fill_both`` to fill.
    """
    index = index_weekly.groupBy("week").agg(F.max("px").alias("vix"))
    side = calendar_side(index)
    out = market.join(side, "week", "left")
    out = out.withColumns(
        {
            "vix_delta_1w": F.col("vix") - F.lag("vix").over(by_week()),
            "vix_zscore_52w": F.expr(rolling_zscore("vix", ZSCORE_WEEKS, ZSCORE_MIN_WEEKS)),
        }
    )
    if missing == "zero":
        absent = index.agg(F.count("vix")).scalar() == 0
        out = out.withColumns(
            {n: F.when(absent, F.lit(0.0)).otherwise(F.col(n)) for n in ("vix", "vix_delta_1w", "vix_zscore_52w")}
        )
    return out


def market_panel(prices: DataFrame, index_ticker: str, missing: str = "null", tickers: list[str] | None = None) -> DataFrame:
    """Market features with the volatility index, for every ticker in one plan.

    The weekly prices are stored, as the index and the tickers both start from them.
    """
    weekly = stored(weekly_prices(prices), "weekly-prices")
    index = weekly.where(F.col("ticker") == index_ticker)
    if tickers is not None:
        weekly = weekly.where(F.col("ticker").isin(tickers))
    return with_volatility_index(market_features(weekly), index, missing)


def next_week_return(weekly: DataFrame) -> DataFrame:
    """``(ticker, week, target_return)``: the return of the following price week.

    An event week starts on the Monday that closes a price week, so this is the return
    over the event week itself.
    """
    returns = weekly_returns(weekly)
    return returns.select("ticker", "week", F.lead("weekly_return_current").over(by_week()).alias("target_return"))


def short_momentum(prices: DataFrame, steps: int = 4) -> DataFrame:
    """Return of the last daily price over the one ``steps`` rows before it.

    The rank filter lets Spark keep only the last rows per ticker before the shuffle.
    """
    newest_first = W.partitionBy("ticker").orderBy(F.col("d").desc())
    ranked = prices.withColumn("age", F.row_number().over(newest_first)).where(F.col("age") <= steps + 1)
    ends = ranked.groupBy("ticker").agg(
        F.max(F.when(F.col("age") == 1, F.col("px"))).alias("last_px"),
        F.max(F.when(F.col("age") == steps + 1, F.col("px"))).alias("base_px"),
    )
    change_ratio = ratio(F.col("last_px") - F.col("base_px"), F.col("base_px"))
    return ends.withColumn("current_return", change_ratio)
