"""Training panels: events and prices to labelled rows per ticker and week."""

from __future__ import annotations

from pyspark.sql import DataFrame

from weektide.constants import CRISIS_THRESHOLD, VIX_TICKER
from weektide.operators.market import market_panel, next_week_return, weekly_prices
from weektide.operators.panel import add_temporal_features, direction_panel, join_training, label_crisis
from weektide.operators.weekly import weekly_features, weekly_features_lite
from weektide.sources.prices import require_rows


def crisis_training_panel(
    events: DataFrame,
    prices: DataFrame,
    index_ticker: str = VIX_TICKER,
    tickers: list[str] | None = None,
    threshold: float = CRISIS_THRESHOLD,
) -> DataFrame:
    """Cleaned events and daily prices to the crisis panel.

    Exchanges: the events once by week, after partial aggregation; the prices once by
    ticker and week, after partial aggregation; their weekly rows once by ticker.
    """
    market = market_panel(require_rows(prices, "prices"), index_ticker, tickers=tickers)
    panel = join_training(weekly_features(events), market)
    return add_temporal_features(label_crisis(panel, threshold))


def direction_training_panel(events: DataFrame, prices: DataFrame) -> DataFrame:
    """Cleaned events and daily prices to the direction panel."""
    targets = next_week_return(weekly_prices(prices))
    return direction_panel(weekly_features_lite(events), targets)
