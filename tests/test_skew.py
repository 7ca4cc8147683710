"""A third or more of all rows under one key: whole and equal results."""

import datetime as dt
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from weektide.operators import clean, latest, market, weekly

ROWS = 30_000


@pytest.fixture
def hot(spark):
    """Half of the rows share week, code and place; the rest is spread."""
    i = F.col("id")
    is_hot = i % 2 == 0
    day = F.date_add(F.lit(dt.date(2024, 1, 1)), F.when(is_hot, 0).otherwise(i % 70).cast("int"))
    return spark.range(0, ROWS, 1, 7).select(
        day.alias("SQLDATE"),
        F.when(is_hot, "190").otherwise(F.lpad((i % 200).cast("string"), 3, "0")).alias("EventCode"),
        F.when(is_hot, F.lit(None)).otherwise(F.concat(F.lit("C"), (i % 40).cast("string"))).alias("Actor1CountryCode"),
        F.lit("USA").alias("Actor2CountryCode"),
        F.when(is_hot, "US").otherwise("IR").alias("ActionGeo_CountryCode"),
        (i % 21 - 10).cast("double").alias("GoldsteinScale"),
        (i % 4 + 1).cast("int").alias("QuadClass"),
        (i % 9).alias("NumMentions"),
        (i % 9).alias("NumArticles"),
        (i % 5).cast("double").alias("AvgTone"),
        F.lit(0).alias("is_major_country"),
    )


def test_weekly_sums_by_hand(hot):
    want = defaultdict(lambda: [0, 0, 0.0])
    for n in range(ROWS):
        day = dt.date(2024, 1, 1) + dt.timedelta(days=0 if n % 2 == 0 else n % 70)
        cell = want[day - dt.timedelta(days=day.weekday())]
        cell[0] += 1
        cell[1] += n % 9
        cell[2] += max(0, 10 - n % 21) * (n % 9)
    got = weekly.weekly_features(clean.with_week(hot)).collect()
    assert {r["week"]: [r["nb_events"], r["total_mentions"], r["tension_score"]] for r in got} == dict(want)


@pytest.mark.parametrize("rows", [1_000_000, 1])
def test_lookup_join_keeps_every_row(spark, hot, monkeypatch, rows):
    """The same with a broadcast lookup and with one beyond the bound, NULL keys included."""
    monkeypatch.setattr("weektide.sources.lookups.BROADCAST_ROWS", rows)
    names = spark.createDataFrame([(f"C{n}", f"name {n}") for n in range(0, 40, 2)] + [("USA", "u")], "CountryCode string, CountryName string")
    out = clean.with_country_names(hot, names)
    assert out.count() == ROWS
    counts = out.agg(F.count("Actor1CountryName"), F.count("Actor2CountryName"), F.count("ActionGeo_CountryName")).first()
    known = sum(1 for n in range(ROWS) if n % 2 and (n % 40) % 2 == 0)
    assert tuple(counts) == (known, ROWS, 0)


def test_top_places_by_hand(hot):
    want = defaultdict(int)
    for n in range(ROWS):
        if n % 4 + 1 >= 3:
            want["US" if n % 2 == 0 else "IR"] += n % 9
    got = latest.top_conflict_places(hot).collect()
    assert [tuple(r) for r in got] == sorted(want.items(), key=lambda kv: (-kv[1], kv[0]))


def test_hot_ticker(spark):
    """One ticker with very many rows per day reduces to the same weeks as the others."""
    day = dt.date(2024, 1, 2)
    df = spark.range(20_000).select(
        F.when(F.col("id") % 3 == 0, "B").otherwise("A").alias("ticker"),
        F.date_add(F.lit(day), (F.col("id") % 28).cast("int")).alias("d"),
        (F.col("id") % 28 + 1).cast("double").alias("px"),
    )
    got = market.weekly_prices(df).orderBy("ticker", "week").collect()
    assert [(r["ticker"], r["px"]) for r in got] == [(t, p) for t in "AB" for p in (7.0, 14.0, 21.0, 28.0)]
