"""Refresh of the snapshots from landed daily drops.

The weekly event features are computed once and joined to all tickers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weektide.constants import LIVE_EVENT_DAYS, RADAR_DAYS, VIX_TICKER
from weektide.operators.clean import clean_drops, decode_live, marked_drops, with_week
from weektide.operators.latest import crisis_snapshot, cube_as_events, event_cube, latest_week, three_weeks
from weektide.operators.market import market_panel
from weektide.operators.panel import add_temporal_features, join_live
from weektide.operators.radar import days_period, radar_candidates, radar_document
from weektide.operators.weekly import finish_weekly, live_features, marked_drop_features, merge_partials, sound_features
from weektide.sources.events import recent_days
from weektide.sources.prices import recent_prices, require_rows
from weektide.sources.tables import current_version, publish


def live_panel(weekly: DataFrame, prices: DataFrame, tickers: list[str], index_ticker: str = VIX_TICKER) -> DataFrame:
    """Live counterpart of the crisis panel: gaps are filled, no outlook, no label."""
    market = market_panel(prices, index_ticker, missing="zero", tickers=tickers)
    market = market.drop("weekly_price", "future_return_4w")
    return add_temporal_features(join_live(weekly, market, tickers))


def crisis_refresh(
    drops: DataFrame,
    prices: DataFrame,
    cameo: DataFrame,
    tickers: list[str],
    as_of: Column,
    index_ticker: str = VIX_TICKER,
    days: int = LIVE_EVENT_DAYS,
) -> DataFrame:
    """Crisis snapshot of every ticker from the last ``days`` drops and two years of prices.

    The events are read once; no event in the look-back is an error.
    """
    cube = event_cube(with_week(decode_live(recent_days(drops, as_of, days), cameo)))
    require_rows(cube, "events of the look-back")
    weekly = finish_weekly(merge_partials(cube))
    panel = live_panel(weekly, recent_prices(prices, as_of), tickers, index_ticker)
    return crisis_snapshot(panel, latest_week(cube_as_events(cube), "week"))


def direction_refresh(drops: DataFrame, as_of: Column, days: int = RADAR_DAYS, material_class: int = 4) -> DataFrame:
    """Three-week snapshot from the last ``days`` drops."""
    marked = marked_drops(recent_days(drops, as_of, days))
    return three_weeks(live_features(sound_features(marked_drop_features(marked, material_class))))


def radar_refresh(drops: DataFrame, as_of: Column, days: int = RADAR_DAYS) -> DataFrame:
    """Radar document from the last ``days`` drops."""
    candidates = radar_candidates(clean_drops(recent_days(drops, as_of, days)))
    return radar_document(candidates, days_period(as_of, days))


def newest_drop(drops: DataFrame) -> Column:
    """Newest ingest day as a literal, so that later filters reach the scan."""
    return F.lit(drops.agg(F.max("ingest_date").alias("day")).first()["day"]).cast("date")


def write_refresh(
    drops: DataFrame, prices: DataFrame, cameo: DataFrame, tickers: list[str], as_of: Column, out: str, index_ticker: str = VIX_TICKER
) -> str:
    """Publish the three documents of a refresh together, and return the folder of their version."""
    publish(
        {
            "crisis": crisis_refresh(drops, prices, cameo, tickers, as_of, index_ticker),
            "direction": direction_refresh(drops, as_of),
            "radar": radar_refresh(drops, as_of),
        },
        out,
    )
    return current_version(drops.sparkSession, out)
