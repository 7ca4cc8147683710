"""Decided semantics on hand-made rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from weektide.functions import flags
from weektide.functions.dates import closing_monday, day_of_instant, day_start, monday_of, parse_day
from weektide.functions.intensity import negative_intensity, positive_intensity, risk_score
from weektide.functions.numbers import coerce_numbers, complete_rows, ratio
from weektide.functions.text import strip_float_suffix, zero_pad
from weektide.operators import clean, latest, panel, radar, weekly
from weektide.catalog import supplied
from weektide.operators.market import market_features, weekly_prices, with_volatility_index
from weektide.plans import refresh
from weektide.sources.events import recent_days, require_columns, stack
from weektide.sources.lookups import checked
from weektide.sources.prices import daily_prices, require_rows


def day(text):
    return dt.date.fromisoformat(text)


def values(df):
    return [tuple(row) for row in df.collect()]


EVENT = (
    "week date, EventCode string, NumMentions bigint, NumArticles bigint, GoldsteinScale double, AvgTone double, "
    "QuadClass int, Actor1CountryCode string, Actor2CountryCode string, ActionGeo_CountryCode string, is_major_country int"
)
W1, W2 = day("2024-01-01"), day("2024-01-08")


def events(spark, rows):
    return spark.createDataFrame(rows, EVENT)


@pytest.mark.parametrize(
    "given, opening, closing",
    [
        ("2024-01-07", "2024-01-01", "2024-01-08"),  # Sunday
        ("2024-01-08", "2024-01-08", "2024-01-08"),  # Monday
        ("2024-01-09", "2024-01-08", "2024-01-15"),  # Tuesday
    ],
)
def test_week_labels(spark, given, opening, closing):
    df = spark.createDataFrame([(day(given),)], "d date")
    row = df.select(monday_of(F.col("d")), closing_monday(F.col("d"))).first()
    assert tuple(row) == (day(opening), day(closing))


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Tokyo"])
def test_day_instants_ignore_the_session_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.createDataFrame([(W1,)], "d date").select(day_start(F.col("d")).alias("t"))
        row = df.select(F.unix_seconds("t") % 86400, day_of_instant(F.col("t"))).first()
        assert tuple(row) == (0, W1)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_dates_lenient_and_strict(spark):
    df = spark.createDataFrame([("20240105",), ("bad",), (None,), ("20241301",)], "SQLDATE string")
    assert values(clean.with_week(df).select("SQLDATE", "week")) == [(day("2024-01-05"), W1)]
    with pytest.raises(Exception):
        df.select(parse_day(F.col("SQLDATE"), strict=True)).collect()


def test_codes_are_padded_and_never_cut(spark):
    df = spark.createDataFrame([("11",), ("0211",), ("1",), ("110.0",), (None,)], "c string")
    padded = values(df.select(zero_pad(strip_float_suffix(F.col("c")), 3)))
    assert padded == [("011",), ("0211",), ("001",), ("110",), (None,)]


def test_long_code_with_zero_resolves(spark):
    lookup = spark.createDataFrame([("0211", "Appeal for economic cooperation")], "EventCode string, EventDescription string")
    df = spark.createDataFrame([("0211", "02"), ("021", "02")], "EventCode string, EventRootCode string")
    out = clean.with_event_descriptions(df, lookup)
    found = dict(values(out.select("EventCode", "EventDescriptionFinal")))
    assert found == {"0211": "Appeal for economic cooperation", "021": "Appeal"}


def test_unknown_live_code_describes_itself(spark):
    lookup = spark.createDataFrame([("010", "Make statement")], "EventCode string, EventDescription string")
    rows = [("10.0", 1, "USA", None, None), ("999", 9, None, None, None)]
    df = spark.createDataFrame(
        rows, "EventCode string, QuadClass int, Actor1CountryCode string, Actor2CountryCode string, ActionGeo_CountryCode string"
    )
    out = clean.decode_live(df, lookup).select("EventDescriptionFinal", "QuadClassLabel", "is_major_country")
    assert sorted(values(out), key=str) == [("999", None, 0), ("Make statement", "Verbal cooperation", 1)]


def test_lookup_with_repeated_keys_is_refused(spark):
    df = spark.createDataFrame([("A", "x"), ("A", "y")], "k string, v string")
    with pytest.raises(ValueError):
        checked(df, "k")


def test_large_lookup_is_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr("weektide.sources.lookups.BROADCAST_ROWS", 1)
    df = spark.createDataFrame([("A", "x"), ("B", "y")], "k string, v string")
    assert "broadcast" not in checked(df, "k")._jdf.queryExecution().logical().toString().lower()


def test_number_coercion(spark):
    df = spark.createDataFrame([("1.5",), ("x",), ("",), ("NaN",), (None,)], "a string").withColumn("b", F.col("a"))
    out = coerce_numbers(coerce_numbers(df, ["a"]), ["b"], whole=["b"], fill=0)
    assert values(out) == [(1.5, 1), (None, 0), (None, 0), (None, 0), (None, 0)]
    assert out.dtypes == [("a", "double"), ("b", "bigint")]


def test_division_by_zero_is_null(spark):
    df = spark.createDataFrame([(1.0, 0.0), (1.0, 2.0)], "a double, b double")
    assert values(df.select(ratio(F.col("a"), F.col("b")))) == [(None,), (0.5,)]


def test_flags_are_never_null(spark):
    df = events(spark, [(W1, "010", 1, 1, 0.0, 0.0, None, None, None, None, None), (W1, "010", 1, 1, 0.0, 0.0, 4, "USA", "CHN", "RS", 0)])
    columns = [
        flags.is_class(4), flags.is_conflict(), flags.is_major(), flags.involves("usa"), flags.involves("russia"),
        flags.in_middle_east(), flags.between("china", "usa"), flags.in_regions(),
    ]
    assert values(df.select(*columns)) == [(False,) * 8, (True, True, True, True, True, False, True, True)]


def test_intensities(spark):
    df = spark.createDataFrame([(-2.0, 3), (2.0, 3), (0.0, 3), (None, 3)], "GoldsteinScale double, NumMentions bigint")
    out = values(df.select(negative_intensity(), positive_intensity(), risk_score()))
    assert out == [(6.0, 0.0, 6.0), (0.0, 6.0, 0.0), (0.0, 0.0, 0.0), (None, None, 0.0)]


def test_weekly_sums_and_ratios(spark):
    rows = [
        (W1, "190", 10, 5, -5.0, -1.0, 4, "USA", "CHN", "IR", 0),
        (W1, "040", 4, 2, 3.0, 2.0, 1, None, None, None, None),
        (W1, None, 6, 3, -1.0, 0.5, 3, "FRA", "ZZZ", "RS", 0),
    ]
    got = weekly.weekly_features(events(spark, rows)).first().asDict()
    assert got["nb_events"] == 2 and got["total_mentions"] == 20 and got["total_articles"] == 10
    assert got["tension_score"] == 56.0 and got["cooperation_score"] == 12.0
    assert got["avg_goldstein"] == pytest.approx(-1.0) and got["min_tone"] == -1.0
    assert got["material_conflict_mentions"] == 10 and got["verbal_conflict_mentions"] == 6
    assert got["conflict_mentions"] == 16 and got["coop_mentions"] == 4
    assert got["conflict_ratio"] == pytest.approx(16 / 21)
    assert got["major_country_events"] == 2 and got["middle_east_conflict_mentions"] == 10
    assert got["usa_china_tension"] == 50.0 and got["usa_russia_tension"] == 0.0
    assert got["russia_conflict_mentions"] == 0


def test_material_class_is_a_parameter(spark):
    rows = [(W1, "1", 3, 1, -1.0, 0.0, 3, None, None, None, 0), (W1, "1", 8, 1, -1.0, 0.0, 4, None, None, None, 0)]
    df = events(spark, rows)
    assert weekly.weekly_features(df).first()["material_conflict_mentions"] == 8
    assert weekly.weekly_features(df, material_class=3).first()["material_conflict_mentions"] == 3


def test_identities_of_a_stored_snapshot(spark):
    names = [m.name for m in weekly.MEASURES]
    known = {
        "nb_events": 4744, "total_mentions": 22223, "verbal_conflict_mentions": 2930, "material_conflict_mentions": 3524,
        "verbal_coop_mentions": 12828, "material_coop_mentions": 2941, "major_country_conflict_mentions": 1714,
    }
    row = spark.range(1).select(*[F.lit(known.get(n, 1)).alias(n) for n in names])
    got = weekly.finish_weekly(row).first()
    assert got["conflict_mentions"] == 6454 and got["coop_mentions"] == 15769
    assert got["conflict_ratio"] == pytest.approx(0.29040676745860333, abs=1e-15)
    assert got["material_conflict_ratio"] == pytest.approx(0.1585673146148308, abs=1e-15)
    assert got["major_conflict_ratio"] == pytest.approx(0.07712383009359251, abs=1e-15)


def test_merged_parts_equal_one_pass(spark):
    rows = [(W1 if i % 3 else W2, str(i % 5), i, i, float(i % 7 - 3), i / 10, i % 4 + 1, "USA", "RUS", "US", 0) for i in range(60)]
    df = events(spark, rows).withColumn("part", F.col("NumMentions") % 6)
    parts = weekly.weekly_partials(df, ["part", "week"])
    whole = {r["week"]: r for r in weekly.weekly_features(df).collect()}
    for row in weekly.finish_weekly(weekly.merge_partials(parts)).collect():
        for name, value in row.asDict().items():
            if name != "week":
                assert value == pytest.approx(whole[row["week"]][name])


def test_mean_of_daily_means(spark):
    rows = [(day("2024-01-02"), W1, 10, 1.0, 1.0, 1), (day("2024-01-03"), W1, 1, 4.0, 1.0, 1)]
    df = spark.createDataFrame(
        rows, "ingest_date date, week date, nb_events bigint, avg_tone double, tension_score double, mat_conf_mentions bigint"
    )
    assert weekly.live_features(df).first()["avg_tone"] == 2.5


def test_order_and_partitions_do_not_matter(spark):
    rows = [(W1, str(i), i, i, float(i % 7 - 3), i / 8, i % 4 + 1, "USA", "CHN", "US", 0) for i in range(64)]
    df = events(spark, rows)
    one = weekly.weekly_features(df.repartition(1)).first()
    many = weekly.weekly_features(df.orderBy(F.rand(3)).repartition(13)).first()
    assert all(a == pytest.approx(b) if isinstance(a, float) else a == b for a, b in zip(one, many))


def test_recent_days_include_both_ends(spark):
    df = spark.createDataFrame([(day(f"2024-01-{n:02d}"),) for n in range(1, 11)], "ingest_date date")
    kept = [r[0].day for r in recent_days(df, "2024-01-09", 7).orderBy("ingest_date").collect()]
    assert kept == [3, 4, 5, 6, 7, 8, 9]


def test_stack_aligns_by_name(spark):
    a = spark.createDataFrame([(1, "x")], "a int, b string")
    b = spark.createDataFrame([("y", 2)], "b string, a int")
    c = spark.createDataFrame([(3,)], "a int")
    assert values(stack([a, b, c]).orderBy("a")) == [(1, "x"), (2, "y"), (3, None)]


def test_required_columns_and_rows(spark):
    df = spark.createDataFrame([], "SQLDATE string")
    with pytest.raises(ValueError, match="EventCode"):
        require_columns(df)
    with pytest.raises(ValueError):
        require_rows(df, "prices")


def test_adjusted_close_falls_back(spark):
    df = spark.createDataFrame(
        [("A", W1, 1.0, None), ("A", W2, 1.0, 2.0), ("B", W1, float("nan"), None)],
        "ticker string, date date, close double, adj_close double",
    )
    assert values(daily_prices(df).orderBy("ticker", "d")) == [("A", W1, 1.0), ("A", W2, 2.0), ("B", W1, None)]


def test_ties_follow_the_key(spark):
    rows = [("b", 5), ("a", 5), ("c", 9), (None, 99)]
    df = spark.createDataFrame(rows, "EventDescriptionFinal string, NumMentions bigint")
    assert values(latest.top_events(df, 2)) == [("c", 9), ("a", 5)]


def test_latest_week_holds_its_whole_week(spark):
    df = spark.createDataFrame([(day("2024-01-07"),), (day("2024-01-08"),), (day("2024-01-10"),)], "SQLDATE date")
    assert sorted(values(latest.latest_week(df))) == [(day("2024-01-08"),), (day("2024-01-10"),)]


def test_three_weeks_or_nothing(spark):
    rows = [(day("2024-01-01"), 1, 1.0, 1.0, 1), (day("2024-01-08"), 2, 2.0, 2.0, 2), (day("2024-01-15"), 3, 3.0, 3.0, 3)]
    df = spark.createDataFrame(rows, "week date, nb_events bigint, avg_tone double, tension_score double, mat_conf_mentions bigint")
    got = latest.three_weeks(df).first()
    assert (got["nb_events"], got["nb_events_lag1"], got["nb_events_lag2"], got["mat_conf_mentions"]) == (3, 2, 1, 3)
    assert latest.three_weeks(df.limit(2)).count() == 0


def test_evolution_skips_zero_and_missing(spark):
    from weektide.constants import EVOLUTION_VARIABLES

    base = dict.fromkeys(EVOLUTION_VARIABLES, 1.0)
    old = base | {"tension_score": 46908.1, "vix": 0.0, "vol_4w": None, "avg_tone": -2.0}
    new = base | {"tension_score": 40433.0, "avg_tone": -3.0}
    schema = "ticker string, week date, " + ", ".join(f"{n} double" for n in EVOLUTION_VARIABLES)
    df = spark.createDataFrame([("A", W1, *old.values()), ("A", W2, *new.values())], schema)
    row = latest.evolution(df).first()
    assert row["week"] == W2 and row["evolution"]["tension_score"] == -13.8 and row["evolution"]["avg_tone"] == -50.0
    assert "vix" not in row["evolution"] and "vol_4w" not in row["evolution"]
    alone = latest.evolution(df.where(F.col("week") == W1)).first()
    assert alone["evolution"] == {}


def test_focus_orders_scores_as_numbers(spark):
    rows = [("e1", 95.0), ("e2", 180.0), ("e3", 110.0), ("e4", 90.0)]
    df = spark.createDataFrame(rows, "SOURCEURL string, RiskScore double")
    assert [r["RiskScore"] for r in radar.focus(df).collect()] == [180.0, 110.0, 95.0]


def test_radar_document_is_ranked_text(spark):
    rows = [(W1, "n", "USA", None, None, -3.0, 2, "u1"), (W1, None, "FRA", None, "US", -5.0, 4, "u2"), (W1, "x", "USA", None, None, -9.0, 9, None)]
    df = spark.createDataFrame(
        rows,
        "SQLDATE date, Actor1Name string, Actor1CountryCode string, Actor2CountryCode string, ActionGeo_CountryCode string, "
        "GoldsteinScale double, NumMentions bigint, SOURCEURL string",
    )
    doc = radar.radar_document(radar.radar_candidates(df), F.lit("p")).first()
    assert (doc["total_events_filtered"], doc["events_returned"]) == ("2", "2")
    assert [e["RiskScore"] for e in doc["events"]] == ["20.0", "6.0"]
    assert doc["events"][0]["Actor1Name"] == "" and doc["events"][0]["SQLDATE"] == "2024-01-01"


def test_fill_forward_then_back(spark):
    weeks = [W1 + dt.timedelta(days=7 * i) for i in range(5)]
    rows = [("A", w, v) for w, v in zip(weeks, [None, 1.0, None, 2.0, None])] + [("B", weeks[0], None)]
    df = spark.createDataFrame(rows, "ticker string, week date, v double")
    out = values(panel.fill_both(df).orderBy("ticker", "week").select("v"))
    assert out == [(1.0,), (1.0,), (1.0,), (2.0,), (2.0,), (None,)]


def test_volatility_index_may_be_missing(spark):
    prices = spark.createDataFrame([("A", W1 + dt.timedelta(days=7 * i), 10.0 + i) for i in range(3)], "ticker string, d date, px double")
    market = market_features(weekly_prices(prices))
    none = spark.createDataFrame([], "week date, px double")
    assert {r["vix"] for r in with_volatility_index(market, none).collect()} == {None}
    assert {r["vix_zscore_52w"] for r in with_volatility_index(market, none, missing="zero").collect()} == {0.0}


def test_crisis_label_is_inclusive(spark):
    df = spark.createDataFrame([(-0.15,), (-0.1499,), (None,)], "future_return_4w double")
    assert [r["crisis_level"] for r in panel.label_crisis(df).collect()] == [1, 0]


def test_complete_rows(spark):
    df = spark.createDataFrame([(1, None), (1, 2)], "a int, b int")
    assert values(complete_rows(df)) == [(1, 2)]
    assert complete_rows(df, ["a"]).count() == 2


def test_a_day_with_a_bad_date_is_left_out(spark):
    rows = [("2024-01-01", "20240101", "1"), ("2024-01-02", "bad", "2"), ("2024-01-02", "20240102", "3"), ("2024-01-03", None, "4"), ("2024-01-03", "20240103", "x")]
    df = spark.createDataFrame(rows, "ingest_date string, SQLDATE string, NumMentions string").withColumns(
        {"ingest_date": F.col("ingest_date").cast("date"), "GoldsteinScale": F.lit("1"), "AvgTone": F.lit("1")}
    )
    assert sorted(r["NumMentions"] for r in clean.clean_drops(df).collect()) == [0, 1]
    assert [(str(r[0]), r[1], r[2]) for r in clean.skipped_days(df).collect()] == [("2024-01-02", 1, 2)]
    typed = clean.clean_drops(df.withColumn("SQLDATE", F.try_to_date("SQLDATE", "yyyyMMdd")))
    assert typed.count() == 3


def test_gaps_of_the_index_are_filled_and_an_absent_index_is_zero(spark):
    weeks = [day(f"2024-01-{d:02d}") for d in (1, 8, 15, 22, 29)]
    levels = [20.0, 21.0, 22.0, None, 24.0]
    stock = spark.createDataFrame([("A", w, 1.0) for w in weeks], "ticker string, week date, px double")
    index = spark.createDataFrame(list(zip(weeks, levels)), "week date, px double")
    out = with_volatility_index(stock, index, missing="zero")
    filled = panel.fill_both(out.select("ticker", "week", "vix", "vix_delta_1w")).orderBy("week").collect()
    assert [r["vix"] for r in filled] == [20.0, 21.0, 22.0, 22.0, 24.0]
    assert [r["vix_delta_1w"] for r in filled] == [1.0, 1.0, 1.0, 1.0, 1.0]
    none = with_volatility_index(stock, index.limit(0), missing="zero")
    assert {r["vix"] for r in none.collect()} == {0.0}


def test_text_of_codes_and_large_scores(spark):
    codes = spark.createDataFrame([("101.0 ",), (" 7.0",), ("10.05",)], "c string").select(strip_float_suffix(F.col("c")))
    assert [r[0] for r in codes.collect()] == ["101", "7", "10.05"]
    scores = spark.createDataFrame([(1.2e7,), (12345678.25,), (0.5,), (None,)], "RiskScore double")
    assert [r[0] for r in radar.as_text(scores).collect()] == ["12000000.0", "12345678.25", "0.5", ""]


def test_refresh_documents_are_written(spark, small, tmp_path):
    drops = supplied.daily_drops(spark, small)
    candidates = clean.clean_drops(drops)
    as_of = refresh.newest_drop(supplied.line_events(spark, small))
    found = refresh.radar_refresh(drops, as_of).first()
    assert int(found["events_returned"]) == len(found["events"]) <= 50 and candidates.count() > 0
    three = refresh.direction_refresh(drops, as_of, days=60).collect()
    assert len(three) == 1 and three[0]["nb_events"] > 0
