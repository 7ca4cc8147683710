"""The ledger of ingested days, bad days in one scan, and the report of what could not be read."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from weektide.catalog import supplied
from weektide.catalog.queries import QUERIES
from weektide.operators import clean, radar, weekly
from weektide.plans import ledger as L
from weektide.plans.refresh import direction_refresh
from weektide.sources import quarantine as Q
from weektide.sources.events import read_landed, recent_days

DAYS = 12


@pytest.fixture(scope="module")
def drops(spark, small):
    drops = supplied.dirty_drops(spark, small)
    newest = drops.agg(F.max("ingest_date")).first()[0]
    return recent_days(drops, newest, 2 * DAYS), newest


@pytest.mark.parametrize("name", ["live_two_phase", "radar_top50"])
def test_bad_days_are_found_in_the_same_scan(spark, small, name):
    plan = QUERIES[name](spark, small)
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("l_shipdate#") and sum(line.lstrip(" :+-").startswith("Relation") and "l_shipdate" in line for line in text.splitlines()) == 1


def test_marked_drops_give_what_the_cleaned_ones_give(spark, small):
    dirty = supplied.dirty_drops(spark, small)
    marked, cleaned = clean.marked_drops(dirty), clean.clean_drops(dirty)
    ours = weekly.sound_features(weekly.marked_drop_features(marked)).orderBy("ingest_date", "week").collect()
    theirs = weekly.drop_features(cleaned).orderBy("ingest_date", "week").collect()
    assert [r["nb_events"] for r in ours] == [r["nb_events"] for r in theirs]
    assert [r["avg_tone"] for r in ours] == pytest.approx([r["avg_tone"] for r in theirs])
    top = radar.top_of_days(radar.day_tops(marked)).collect()
    assert top == radar.top_radar(radar.radar_candidates(cleaned)).collect()


def test_an_update_reads_only_days_that_are_new_or_changed(spark, drops, tmp_path):
    rows, newest = drops
    root, ledger = f"{tmp_path}/landed", f"{tmp_path}/ledger"
    one = dt.timedelta(days=1)
    L.write_days(rows.where(F.col("ingest_date") < newest), root)
    of = lambda days: spark.read.schema(rows.schema).parquet(root).where(F.col("ingest_date").isin(days))
    update = lambda as_of: L.update_ledger(spark, of, root, ledger, as_of, DAYS)

    def full(as_of):
        landed = recent_days(spark.read.schema(rows.schema).parquet(root), as_of, DAYS)
        return direction_refresh(landed, F.lit(as_of), DAYS).drop("last_updated").collect()

    def check(as_of):
        assert L.direction_from_ledger(spark, ledger, as_of, DAYS).drop("last_updated").collect() == full(as_of)
        landed = recent_days(spark.read.schema(rows.schema).parquet(root), as_of, DAYS)
        want = radar.top_radar(radar.radar_candidates(clean.clean_drops(landed)))
        assert L.radar_from_ledger(spark, ledger, as_of, DAYS).collect() == want.collect()
        counts = L.counts_from_ledger(spark, ledger, as_of, DAYS).first()
        assert counts["total_events_filtered"] == radar.radar_candidates(clean.clean_drops(landed)).count()
        assert counts["skipped_days"] == clean.skipped_days(landed).count()

    first = update(newest - one)
    assert len(first) == DAYS
    check(newest - one)
    assert update(newest - one) == []
    L.write_days(rows.where(F.col("ingest_date") == newest), root)
    assert update(newest) == [newest]
    check(newest)
    # A day that lands again is read again, one that is gone is taken out.
    again = newest - 3 * one
    L.write_days(rows.where(F.col("ingest_date") == again).limit(2), root)
    assert update(newest) == [again]
    check(newest)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/ingest_date={newest - 5 * one}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    assert update(newest) == []
    check(newest)


def test_an_update_that_failed_is_run_again(spark, drops, tmp_path, monkeypatch):
    rows, newest = drops
    root, ledger = f"{tmp_path}/landed", f"{tmp_path}/ledger"
    L.write_days(rows.where(F.col("ingest_date") >= newest - dt.timedelta(days=1)), root)
    of = lambda days: spark.read.schema(rows.schema).parquet(root).where(F.col("ingest_date").isin(days))
    whole = L.write_days

    def failing(df, path):
        if path.endswith("tops"):
            raise OSError("no space")
        whole(df, path)

    monkeypatch.setattr(L, "write_days", failing)
    with pytest.raises(OSError):
        L.update_ledger(spark, of, root, ledger, newest, DAYS)
    monkeypatch.setattr(L, "write_days", whole)
    assert len(L.update_ledger(spark, of, root, ledger, newest, DAYS)) == 2
    assert L.counts_from_ledger(spark, ledger, newest, DAYS).first()["days"] >= 1


def test_what_could_not_be_read_is_reported(spark, tmp_path):
    def land(day, name, text):
        folder = tmp_path / f"ingest_date=2024-01-{day:02d}"
        folder.mkdir(exist_ok=True)
        (folder / name).write_text(text)

    good = "20240101\tA\tUSA\tCHN\tUS\t0211\t02\t1.0\t1\t5\t4\t1.5\thttp://x\n"
    land(1, "a.csv", good * 3)
    land(2, "a.csv", good + "20240101\tcut\n" + good)
    land(2, "b.csv", "")
    land(3, "a.csv", good.replace("\t5\t", "\tmany\t"))
    reads = Q.file_reads(spark, str(tmp_path), "2024-01-03", 3)
    found = {(r["ingest_date"].day, r["file"]): (r["rows"], r["malformed"]) for r in reads.collect()}
    assert found == {(1, "a.csv"): (3, 0), (2, "a.csv"): (3, 1), (3, "a.csv"): (1, 1)}
    skipped = {(r["ingest_date"].day, r["file"]): (r["reason"], r["rows"]) for r in Q.skipped_files(reads).collect()}
    assert skipped == {(2, "a.csv"): ("malformed lines", 1), (3, "a.csv"): ("malformed lines", 1)}
    lines = Q.landed_lines(spark, str(tmp_path), "2024-01-03", 3)
    assert Q.sound_lines(lines).count() == 5 and lines.count() == 7
    assert read_landed(spark, str(tmp_path), "2024-01-03", 3, "csv").count() == 7
    torn = tmp_path / "parquet"
    spark.createDataFrame([("0211", dt.date(2024, 1, 1))], "EventCode string, ingest_date date").write.partitionBy("ingest_date").parquet(str(torn))
    (torn / "ingest_date=2024-01-01" / "torn.parquet").write_text("no parquet")
    reads = Q.file_reads(spark, str(torn), "2024-01-03", 3, "parquet")
    assert [(r["file"], r["reason"]) for r in Q.skipped_files(reads).collect()] == [("torn.parquet", "unreadable")]
