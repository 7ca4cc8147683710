"""Panel of event and market features, its targets and its temporal features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weektide.constants import (
    CRISIS_THRESHOLD,
    DIRECTION_LAGGED,
    EVENT_FEATURES,
    ZSCORE_MIN_WEEKS,
    ZSCORE_WEEKS,
)
from weektide.functions.numbers import complete_rows, rolling_zscore
from weektide.operators.market import by_ticker, by_week, calendar_side

KEYS = ["ticker", "week"]


def join_training(weekly: DataFrame, market: DataFrame) -> DataFrame:
    """Event weeks with their market rows; only complete rows survive.

    A left join followed by the drop of incomplete rows is an inner join, and written
    so the market side keeps its partitioning by ticker for the windows that follow.
    """
    return complete_rows(market.join(calendar_side(weekly), "week"))


def join_live(weekly: DataFrame, market: DataFrame, tickers: list[str]) -> DataFrame:
    """Every event week for every ticker; gaps take the last known, then the next known value."""
    scaffold = weekly.withColumn("ticker", F.explode(F.array(*[F.lit(t) for t in tickers])))
    return fill_both(by_ticker(scaffold.join(market, KEYS, "left")))


def fill_both(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Forward fill, then back fill, per ticker.

    After the forward fill only leading gaps are left, and all of them take the first
    known value of the ticker. That is one pass; a frame that looks ahead from every row
    would be quadratic in the weeks.
    """
    names = columns or [name for name in df.columns if name not in KEYS]
    past = by_week().rowsBetween(W.unboundedPreceding, W.currentRow)
    whole = by_week().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    filled = [
        F.coalesce(
            F.last(name, ignorenulls=True).over(past),
            F.first(name, ignorenulls=True).over(whole),
        ).alias(name)
        if name in names
        else F.col(name)
        for name in df.columns
    ]
    return df.select(*filled)


def label_crisis(df: DataFrame, threshold: float = CRISIS_THRESHOLD) -> DataFrame:
    """1 where the four-week return falls to the threshold or below it."""
    level = F.when(F.col("future_return_4w") <= threshold, 1).otherwise(0)
    return complete_rows(df, ["future_return_4w"]).withColumn("crisis_level", level)


def with_lags(df: DataFrame, features: list[str] = EVENT_FEATURES) -> DataFrame:
    """``lag1``, ``lag2`` and ``delta1`` by row position within the ticker."""
    over = "OVER (PARTITION BY ticker ORDER BY week)"
    columns = []
    for name in features:
        columns += [
            f"lag({name}) {over} AS {name}_lag1",
            f"lag({name}, 2) {over} AS {name}_lag2",
            f"{name} - lag({name}) {over} AS {name}_delta1",
        ]
    return df.selectExpr("*", *columns)


def with_zscores(df: DataFrame, features: list[str] = EVENT_FEATURES) -> DataFrame:
    """52-row z-score, from the 20th row on."""
    scores = [f"{rolling_zscore(name, ZSCORE_WEEKS, ZSCORE_MIN_WEEKS)} AS {name}_zscore_52w" for name in features]
    return df.selectExpr("*", *scores)


def with_interactions(df: DataFrame) -> DataFrame:
    tension = F.col("tension_score_zscore_52w")
    return df.withColumns(
        {
            "tension_x_vol_4w": tension * F.col("vol_4w"),
            "conflict_x_drawdown": F.col("material_conflict_ratio_zscore_52w") * F.abs("drawdown_26w"),
            "vix_x_tension": F.col("vix_zscore_52w") * tension,
        }
    )


def add_temporal_features(df: DataFrame) -> DataFrame:
    """Lags, deltas, z-scores and interactions; rows without a full history are dropped.

    All windows share one partitioning and order, so Spark plans one sort and no
    exchange beyond the one by ticker.
    """
    return complete_rows(with_interactions(with_zscores(with_lags(df))))


def direction_panel(weekly: DataFrame, targets: DataFrame) -> DataFrame:
    """Direction training rows: lagged features, last target and the sign of the target."""
    joined = complete_rows(targets, ["target_return"]).join(calendar_side(weekly), "week")
    out = joined.select(
        "*",
        *[F.lag(name).over(by_week()).alias(f"{name}_lag1") for name in DIRECTION_LAGGED],
        F.lag("target_return").over(by_week()).alias("weekly_return_current"),
        (F.col("target_return") > 0).cast("int").alias("target_direction"),
    )
    return complete_rows(out)


def split_at(df: DataFrame, date: str) -> tuple[DataFrame, DataFrame]:
    """Rows before the date, and rows from it on."""
    boundary = F.lit(date).cast("date")
    return df.where(F.col("week") < boundary), df.where(F.col("week") >= boundary)


def with_split(df: DataFrame, date: str) -> DataFrame:
    return df.withColumn("split", F.when(F.col("week") < F.lit(date).cast("date"), "train").otherwise("test"))
