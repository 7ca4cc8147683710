"""Market and temporal windows against pandas on series with gap weeks."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest

from weektide.operators import market, panel


def close(left, right):
    left = np.array([np.nan if v is None else v for v in left], dtype=float)
    np.testing.assert_allclose(left, np.asarray(right, dtype=float), rtol=1e-9, atol=1e-12)


@pytest.fixture(scope="module")
def series():
    rng = random.Random(7)
    out = {}
    for ticker, gap in (("A", 0.0), ("B", 0.2)):
        days, price = [], 100.0
        for n in range(560):
            day = dt.date(2020, 1, 1) + dt.timedelta(days=n)
            price *= 1 + rng.uniform(-0.03, 0.03)
            if rng.random() > 0.3 and not (gap and (n // 7) % 6 == 0):
                days.append((day, price))
        out[ticker] = days
    return out


@pytest.fixture(scope="module")
def prices(spark, series):
    rows = [(ticker, d, p) for ticker, days in series.items() for d, p in days]
    return spark.createDataFrame(rows, "ticker string, d date, px double").repartition(5)


@pytest.mark.parametrize("ticker", ["A", "B"])
def test_market_features(series, prices, ticker):
    s = pd.Series([p for _, p in series[ticker]], index=pd.to_datetime([d for d, _ in series[ticker]]))
    week = s.resample("W-MON").last()
    back = week.ffill()
    returns = back / back.shift(1) - 1
    got = market.market_features(market.weekly_prices(prices)).where(f"ticker = '{ticker}'").orderBy("week").toPandas()
    assert list(pd.to_datetime(got["week"])) == list(week.index)
    close(got["weekly_price"], week)
    close(got["weekly_return_current"], returns)
    for n in (4, 8, 12):
        close(got[f"vol_{n}w"], returns.rolling(n).std())
    for n in (4, 12, 26):
        close(got[f"momentum_{n}w"], back / back.shift(n) - 1)
    close(got["drawdown_26w"], week / week.rolling(26).max() - 1)
    close(got["future_return_4w"], week.shift(-4) / week - 1)


def test_volatility_index_is_aligned_first(series, prices):
    weeks = {
        t: pd.Series([p for _, p in s], index=pd.to_datetime([d for d, _ in s])).resample("W-MON").last()
        for t, s in series.items()
    }
    vix = weeks["B"].reindex(weeks["A"].index)
    rolling = vix.rolling(52, min_periods=20)
    got = market.market_panel(prices, "B", tickers=["A"]).orderBy("week").toPandas()
    close(got["vix"], vix)
    close(got["vix_delta_1w"], vix.diff())
    close(got["vix_zscore_52w"], (vix - rolling.mean()) / (rolling.std() + 1e-9))


def test_lags_and_zscores_go_by_row(spark):
    rng = random.Random(3)
    weeks = [dt.date(2020, 1, 6) + dt.timedelta(days=7 * n) for n in range(90) if n % 9]
    frame = pd.DataFrame({"week": weeks, "x": [rng.gauss(0, 1) for _ in weeks]})
    df = spark.createDataFrame(frame).selectExpr("'A' AS ticker", "CAST(week AS date) AS week", "x")
    got = panel.with_zscores(panel.with_lags(df, ["x"]), ["x"]).orderBy("week").toPandas()
    x = frame["x"]
    close(got["x_lag1"], x.shift(1))
    close(got["x_lag2"], x.shift(2))
    close(got["x_delta1"], x - x.shift(1))
    rolling = x.rolling(52, min_periods=20)
    close(got["x_zscore_52w"], (x - rolling.mean()) / (rolling.std() + 1e-9))
    assert got["x_zscore_52w"].isna().sum() == 19


def test_short_momentum(series, prices):
    got = {r["ticker"]: r["current_return"] for r in market.short_momentum(prices).collect()}
    for ticker, days in series.items():
        last, base = days[-1][1], days[-5][1]
        assert got[ticker] == pytest.approx((last - base) / base)


def test_properties(prices):
    got = market.market_features(market.weekly_prices(prices)).toPandas()
    assert set(pd.to_datetime(got["week"]).dt.dayofweek) == {0}
    assert (got["drawdown_26w"].dropna() <= 0).all()
    for _, part in got.sort_values("week").groupby("ticker"):
        step = pd.to_datetime(part["week"]).diff().dropna().dt.days
        assert set(step) == {7}
