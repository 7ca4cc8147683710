"""Streams: equal to the batch result, late events, restarts."""

import pytest
from pyspark.sql import functions as F

from weektide.catalog import supplied
from weektide.operators import clean, latest, radar, weekly
from weektide.streaming import weekly_stream as ST


@pytest.fixture(scope="module")
def activity(spark, small):
    return spark.read.parquet(f"{small}/events.parquet")


def landed(spark, folder, per_batch=1):
    return supplied.activity_as_events(ST.read_stream(spark, folder, supplied.stream_schema(), files_per_batch=per_batch))


@pytest.fixture
def folder(activity, tmp_path):
    out = str(tmp_path / "landed")
    activity.repartition(4, "event_id").write.parquet(out)
    return out


def rows(df):
    return {r["week"]: r.asDict() for r in df.collect()}


def test_stream_equals_batch(spark, activity, folder, tmp_path):
    out = str(tmp_path / "weeks")
    ST.upsert_open_weeks(ST.weekly_stream(landed(spark, folder), "365 days"), out, str(tmp_path / "state")).awaitTermination()
    got = rows(ST.current_weeks(spark, out))
    want = rows(weekly.weekly_features(clean.with_week(supplied.activity_as_events(activity))))
    assert got.keys() == want.keys()
    for week in want:
        for name, value in want[week].items():
            assert got[week][name] == (pytest.approx(value) if isinstance(value, float) else value)


def test_restart_reads_only_new_files(spark, activity, folder, tmp_path):
    out, state = str(tmp_path / "weeks"), str(tmp_path / "state")
    run = lambda: ST.upsert_open_weeks(ST.weekly_stream(landed(spark, folder), "365 days"), out, state).awaitTermination()
    run()
    once = rows(ST.current_weeks(spark, out))
    run()
    assert rows(ST.current_weeks(spark, out)) == once
    activity.limit(10).write.mode("append").parquet(folder)
    run()
    assert sum(r["nb_events"] for r in rows(ST.current_weeks(spark, out)).values()) == activity.count() + 10


def test_late_events_are_dropped_and_counted(spark, activity, tmp_path):
    folder, out, state = (str(tmp_path / n) for n in ("landed", "weeks", "state"))
    weekly_rows = lambda: ST.weekly_stream(landed(spark, folder), "1 day")
    activity.where("ts >= '2024-01-20'").coalesce(1).write.parquet(folder)
    ST.append_closed_weeks(weekly_rows(), out, state).awaitTermination()
    activity.where("ts < '2024-01-08'").coalesce(1).write.mode("append").parquet(folder)
    query = ST.append_closed_weeks(weekly_rows(), out, state)
    query.awaitTermination()
    assert ST.late_groups(query) > 0
    assert spark.read.parquet(out).agg(F.min("week")).first()[0].isoformat() == "2024-01-15"


def test_snapshots_equal_batch(spark, activity, folder, tmp_path):
    out = str(tmp_path / "parts")
    ST.refresh_snapshots(landed(spark, folder), out, str(tmp_path / "state")).awaitTermination()
    newest = latest.latest_week(supplied.activity_as_events(activity))
    assert ST.current_top_events(spark, out).collect() == latest.top_events(newest).collect()
    places = ST.current_top_conflict_places(spark, out).collect()
    assert places == latest.top_conflict_places(newest).collect()
    assert ST.current_radar(spark, out).collect() == radar.top_radar(radar.radar_candidates(newest)).collect()


def test_late_rows_are_counted_over_restarts(spark, activity, tmp_path):
    """Every row of a closed week counts, the newest day is remembered, a batch run again changes nothing."""
    folder, out, state = (str(tmp_path / n) for n in ("landed", "arrivals", "state"))
    land = lambda rows: rows.repartition(3).write.mode("append").parquet(folder)
    count = lambda where=state: ST.count_arrivals(landed(spark, folder, 3), out, where, 1).awaitTermination()
    land(activity.where("ts >= '2024-01-20'"))
    count()
    assert ST.late_rows(spark, out).count() == 0
    late = activity.where("ts < '2024-01-08'")
    land(late)
    count()
    assert {(r["batch_id"], r["rows"]) for r in ST.late_rows(spark, out).groupBy("batch_id").agg(F.sum("rows").alias("rows")).collect()} == {(1, late.count())}
    before = sorted(map(tuple, ST.late_rows(spark, out).collect()))
    count(str(tmp_path / "another"))
    assert sorted(map(tuple, ST.late_rows(spark, out).collect())) == before
    land(activity.orderBy(F.col("ts").desc()).limit(5))
    count()
    assert sorted(map(tuple, ST.late_rows(spark, out).collect())) == before


def test_there_are_as_many_folders_as_weeks(spark, activity, folder, tmp_path):
    out = tmp_path / "weeks"
    ST.upsert_open_weeks(ST.weekly_stream(landed(spark, folder), "365 days"), str(out), str(tmp_path / "state")).awaitTermination()
    weeks = activity.selectExpr("trunc(ts, 'week') AS week").distinct().count()
    assert len([p for p in out.iterdir() if p.name.startswith("week=")]) == weeks


def test_merged_parts_give_the_same_and_old_ones_stay_until_cleared(spark, activity, folder, tmp_path, monkeypatch):
    out, state = str(tmp_path / "parts"), str(tmp_path / "state")
    run = lambda: ST.refresh_snapshots(landed(spark, folder), out, state).awaitTermination()
    shown = lambda: (ST.current_top_events(spark, out).collect(), ST.current_top_conflict_places(spark, out).collect(), ST.current_radar(spark, out).collect())
    run()
    before = shown()
    reader = ST._parts(spark, out, "mentions")
    sums = reader.agg(F.sum("mentions")).first()
    assert ST.compact_snapshots(spark, out) == 1 and ST.compact_snapshots(spark, out) == 1
    assert shown() == before and reader.agg(F.sum("mentions")).first() == sums
    assert len(list((tmp_path / "parts" / "mentions" / "state=1").glob("week=*"))) == activity.selectExpr("trunc(ts, 'week') AS week").distinct().count()
    ST.clear_merged(spark, out)
    assert shown() == before
    assert [p.name for p in (tmp_path / "parts" / "mentions").iterdir()] == ["state=1"]
    activity.limit(20).write.mode("append").parquet(folder)
    run()
    newer = shown()
    # A merge that fails before its manifest leaves the state as it is.
    with monkeypatch.context() as m:
        m.setattr(type(spark.range(1).write), "json", lambda *_: (_ for _ in ()).throw(OSError("no space")))
        with pytest.raises(OSError):
            ST.compact_snapshots(spark, out)
    assert shown() == newer
    assert ST.compact_snapshots(spark, out) == 2 and shown() == newer
