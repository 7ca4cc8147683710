"""Files in and out."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from weektide.operators import clean, panel, radar
from weektide.operators.quality import null_profile
from weektide.plans.history import quality_reports, store_history
from weektide.schemas import CRISIS_SNAPSHOT_SCHEMA, EVENT_SCHEMA, RADAR_SCHEMA
from weektide.sources.events import load_events, read_history, read_landed
from weektide.sources.lookups import read_country_lookup, read_event_lookup
from weektide.sources.prices import price_range, read_prices, recent_prices
from weektide.sources.tables import as_documents, current_version, pick, publish, read_documents, stored, write_documents, write_table

HEADER = "SQLDATE,EventCode,EventRootCode,Actor1CountryCode,Actor2CountryCode,ActionGeo_CountryCode,GoldsteinScale,QuadClass,NumMentions,NumArticles,AvgTone"


@pytest.fixture
def history(tmp_path):
    first = tmp_path / "a.csv"
    first.write_text(HEADER + "\n20240102,0211,02, USA ,CHN,US,3.0,1,5,4,1.5\n20240103,190,19,RUS,,IR,-10,4,7,x,-2\nbad,190,19,RUS,,IR,-10,4,7,1,-2\n")
    second = tmp_path / "b.csv"
    cells = HEADER.split(",")
    swapped = ",".join([cells[1], cells[0], *cells[2:]])
    second.write_text(swapped + "\n43,20250107,4,FRA,USA,FR,1.0,1,2,2,0\n")
    countries = tmp_path / "countries.txt"
    countries.write_text("USA\tUnited States\nCHN\tChina\nRUS\tRussia\n")
    codes = tmp_path / "codes.txt"
    codes.write_text("CAMEOEVENTCODE\tEVENTDESCRIPTION\n0211\tAppeal for economic cooperation\n43\tHost a visit\n")
    return [str(first), str(second)], str(countries), str(codes)


def test_history_is_stacked_by_name_and_keeps_zeros(spark, history):
    rows = read_history(spark, history[0]).select("EventCode", "SQLDATE").orderBy("SQLDATE").collect()
    assert [tuple(r) for r in rows] == [("0211", "20240102"), ("190", "20240103"), ("43", "20250107"), ("190", "bad")]


def test_history_with_missing_columns_is_refused(spark, history):
    with pytest.raises(ValueError, match="is_major_country"):
        load_events(spark, history[0])


def test_lookup_files(spark, history):
    assert read_country_lookup(spark, history[1]).count() == 3
    codes = {r[0]: r[1] for r in read_event_lookup(spark, history[2]).collect()}
    assert codes == {"0211": "Appeal for economic cooperation", "043": "Host a visit"}


def test_store_history(spark, history, tmp_path):
    out = str(tmp_path / "history")
    store_history(spark, *history, out)
    back = spark.read.parquet(out)
    rows = {r["EventCode"]: r for r in back.collect()}
    assert set(rows) == {"0211", "190", "043"}
    assert rows["0211"]["Actor1CountryName"] == "United States" and rows["0211"]["year"] == 2024
    assert rows["190"]["EventDescriptionFinal"] == "Fight" and rows["190"]["NumArticles"] is None
    assert rows["043"]["EventDescriptionFinal"] == "Host a visit" and rows["043"]["week"] == dt.date(2025, 1, 6)
    pruned = back.where("year = 2025")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in pruned


def test_quality_reports(spark, history):
    decoded = clean.decode_history(
        read_history(spark, history[0]), read_country_lookup(spark, history[1]), read_event_lookup(spark, history[2])
    )
    reports = quality_reports(decoded, read_country_lookup(spark, history[1]))
    profile = {r["column_name"]: r["n_null"] for r in reports["null_profile"].collect()}
    assert profile["EventDescription"] == 2 and profile["ActionGeo_CountryName"] == 4 and profile["EventDescriptionFinal"] == 0
    assert [r[0] for r in reports["unmapped_actor_codes"].collect()] == ["FRA"]
    assert reports["root_mismatch_examples"].count() == 0 and reports["fallback_examples"].count() == 1
    names = [*profile]
    rows = [sorted(map(str, df.select("column_name", "n_rows", "n_null", "match_rate").collect())) for df in (reports["null_profile"], null_profile(decoded, names))]
    assert rows[0] == rows[1]
    for name, report in reports.items():
        logs = [f for f in report.inputFiles() if f.endswith(".csv")]
        assert logs == [], name
    nothing = quality_reports(decoded.limit(0), read_country_lookup(spark, history[1]))
    assert {(r["n_rows"], r["n_null"], r["match_rate"]) for r in nothing["null_profile"].collect()} == {(0, 0, None)}
    assert nothing["code_examples"].count() == 0


def test_landed_days_are_pruned_and_bad_files_skipped(spark, tmp_path):
    root = tmp_path / "drops"
    row = ("20240101", "n", "USA", None, "US", "010", "01", 1.0, 1, 2, 3, 0.5, "u")
    df = spark.createDataFrame([row], EVENT_SCHEMA)
    for number in (1, 2, 9):
        df.write.parquet(str(root / f"ingest_date=2024-01-{number:02d}"))
    broken = root / "ingest_date=2024-01-08"
    broken.mkdir()
    (broken / "part-0.parquet").write_text("not parquet")
    got = read_landed(spark, str(root), dt.date(2024, 1, 9), 8)
    assert sorted(r["ingest_date"].day for r in got.collect()) == [2, 9]
    assert "PartitionFilters: [isnotnull(ingest_date" in got._jdf.queryExecution().executedPlan().toString()


def test_price_files_and_ranges(spark, tmp_path):
    path = tmp_path / "prices.csv"
    path.write_text("ticker,date,close,adj_close\nA,2022-12-30,1.0,\nA,2022-12-31,2.0,1.5\nA,2020-01-01,3.0,2.5\n")
    prices = read_prices(spark, str(path), "csv").withColumnRenamed("date", "d")
    assert price_range(prices, "2006-01-01", "2022-12-31").count() == 2
    assert recent_prices(prices, "2022-12-31").count() == 2


@pytest.mark.parametrize("file_format", ["parquet", "csv"])
def test_tables_by_year(spark, tmp_path, file_format):
    df = spark.createDataFrame([(dt.date(2020, 1, 6), 1), (dt.date(2021, 1, 4), 2)], "week date, n int")
    out = str(tmp_path / file_format)
    write_table(df, out, file_format, year_of="week")
    back = spark.read.schema("week date, n int, year int").option("header", True).format(file_format).load(out)
    assert sorted(tuple(r) for r in back.collect()) == [(dt.date(2020, 1, 6), 1, 2020), (dt.date(2021, 1, 4), 2, 2021)]


def test_documents_round_trip(spark, tmp_path):
    out = str(tmp_path / "docs")
    df = spark.createDataFrame(
        [("A", "t", "w", {"x": 1.5}, {"e": 2}, None, {})], CRISIS_SNAPSHOT_SCHEMA
    )
    write_documents(df, out)
    row = read_documents(spark, out, CRISIS_SNAPSHOT_SCHEMA).first()
    assert row["features"] == {"x": 1.5} and row["top_events"] == {"e": 2}
    assert row["top_conflict_countries"] == {} and row["evolution"] == {}
    text = as_documents(df, "ticker").first()["document"]
    assert json.loads(text)["features"] == {"x": 1.5}
    picked = read_documents(spark, out, CRISIS_SNAPSHOT_SCHEMA).select(pick("features", ["x", "y"]).alias("m")).first()["m"]
    assert picked == {"x": 1.5, "y": None}


def test_indented_radar_document(spark, tmp_path):
    event = dict.fromkeys(["SQLDATE", "Actor1Name", "ActionGeo_CountryCode", "GoldsteinScale", "NumMentions", "SOURCEURL"], "1")
    scores = ["90.0", "180.0", "110.0"]
    doc = {"period": "p", "regions_tracked": ["USA"], "events": [event | {"RiskScore": s} for s in scores]}
    (tmp_path / "radar.json").write_text(json.dumps(doc, indent=4))
    back = read_documents(spark, str(tmp_path / "radar.json"), RADAR_SCHEMA, multi_line=True)
    events = back.select(F.inline("events")).withColumn("RiskScore", F.col("RiskScore").cast("double"))
    assert [r["RiskScore"] for r in radar.focus(events).collect()] == [180.0, 110.0, 90.0]


def test_only_present_columns_are_shown(spark):
    df = spark.createDataFrame([(1.0, "u")], "RiskScore double, SOURCEURL string")
    assert radar.shown(df) == ["SOURCEURL", "RiskScore"]


def test_stored_ends_the_lineage(spark):
    df = stored(spark.range(5).withColumn("x", F.col("id") * 2), "t")
    assert df.count() == 5 and "Range" not in df._jdf.queryExecution().executedPlan().toString()


def test_split(spark):
    df = spark.createDataFrame([(dt.date(2018, 12, 31),), (dt.date(2019, 1, 1),)], "week date")
    train, test = panel.split_at(df, "2019-01-01")
    assert train.count() == 1 and test.first()["week"] == dt.date(2019, 1, 1)


def test_documents_are_published_together(spark, tmp_path):
    """If one of a set cannot be written, readers still have the whole set before it."""
    out = str(tmp_path / "documents")
    one = lambda n: spark.createDataFrame([(n,)], "n int")
    read = lambda: [spark.read.schema("n int").json(f"{current_version(spark, out)}/{name}").first()["n"] for name in ("a", "b")]
    assert current_version(spark, out) is None
    assert publish({"a": one(1), "b": one(1)}, out) == 1
    assert read() == [1, 1]
    broken = one(2).select(F.raise_error(F.lit("no space")).alias("n"))
    with pytest.raises(Exception, match="no space"):
        publish({"a": one(2), "b": broken}, out)
    assert read() == [1, 1]
    assert publish({"a": one(3), "b": one(3)}, out) == 3
    assert read() == [3, 3]
