"""Physical plans: what must and what must not be in them."""

import re

import pytest
from pyspark.sql import functions as F

from weektide.catalog import supplied
from weektide.catalog.queries import QUERIES
from weektide.functions.intensity import MENTIONS
from weektide.operators import clean, latest, radar, weekly
from weektide.plans.refresh import newest_drop
from weektide.sources.events import recent_days

PYTHON = ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas", "Scan ExistingRDD")
MODELS = {"gbt_scores", "forest_scores", "feature_importance", "scenario_scores", "direction_served", "crisis_reports", "parameter_search", "parameter_search_ranking", "holdout_metrics"}
RUNS = {n for n in QUERIES if n.startswith("stream")} | {"crisis_documents", "radar_documents", "published_refresh", "ledger_reads"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - MODELS - RUNS))
def test_no_python_and_no_product(spark, small, name):
    text = plan(QUERIES[name](spark, small))
    assert not [word for word in PYTHON if word in text]
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    # A window over everything would pull all rows into one task.
    assert not re.search(r"Window \[[^\n]*\n[^\n]*\n?[^\n]*SinglePartition", text)


def test_weekly_panel_aggregates_before_the_shuffle(spark, small):
    text = plan(weekly.weekly_features(clean.with_week(supplied.world_events(spark, small))))
    assert "partial_sum" in text and re.search(r"hashpartitioning\(week#\d+", text)


def test_only_needed_columns_and_filters_reach_the_scan(spark, small):
    events = supplied.line_events(spark, small).where("QuadClass >= 3 AND l_orderkey > 100").select(MENTIONS)
    text = plan(events)
    assert "l_extendedprice" not in text and "l_comment" not in text
    assert "GreaterThan(l_orderkey,100)" in text


def test_radar_keeps_top_rows_per_task(spark, small):
    text = plan(radar.top_radar(radar.radar_candidates(clean.clean_drops(supplied.daily_drops(spark, small)))))
    assert "TakeOrderedAndProject" in text and "rangepartitioning" not in text


def test_lookups_are_broadcast(spark, small):
    text = plan(QUERIES["country_lookup"](spark, small))
    assert text.count("BroadcastHashJoin") >= 3


def test_sides_above_the_threshold_are_not_broadcast(spark, small):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1k")
    try:
        text = plan(supplied.world_events(spark, small))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in text and "BroadcastHashJoin" not in text


def test_day_filters_reach_the_scan(spark, tmp_path):
    day = "date_add(DATE '2024-01-01', CAST(id AS INT))"
    spark.range(40).selectExpr(f"{day} AS SQLDATE", f"{day} AS ingest_date", "id AS NumMentions").write.parquet(str(tmp_path / "log"))
    log = spark.read.parquet(str(tmp_path / "log"))
    assert "GreaterThanOrEqual(SQLDATE,2024-02-05)" in plan(latest.latest_week(log))
    recent = plan(recent_days(log, newest_drop(log), 7))
    assert "GreaterThanOrEqual(ingest_date,2024-02-03)" in recent and "LessThanOrEqual(ingest_date" in recent


def test_snapshot_reads_the_events_once(spark, small):
    events = clean.with_week(supplied.world_events(spark, small)).withColumn("EventDescriptionFinal", F.col("EventCode"))
    cube = latest.event_cube(events)
    week = latest.latest_week(latest.cube_as_events(cube), "week")
    for frame in (weekly.finish_weekly(weekly.merge_partials(cube)), latest.top_events(week), latest.top_conflict_places(week)):
        assert "lineitem" not in plan(frame)


def test_rank_filter_limits_before_the_shuffle(spark, small):
    assert "WindowGroupLimit" in plan(QUERIES["short_momentum"](spark, small))


def test_temporal_windows_add_no_exchange(spark, medium):
    joined = plan(QUERIES["panel_join"](spark, medium)).count("Exchange ")
    finished = plan(QUERIES["interactions"](spark, medium)).count("Exchange ")
    assert finished <= joined
