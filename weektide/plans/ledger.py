"""Ledger of ingested days: what landed, and what each day adds to the snapshots.

A refresh of the last 7 or 90 days reads the events of days that are new or whose files have changed;
all other days are added from the ledger, and days that leave the look-back are not read any more. Each day has its
own folder in each table, which a repeated update replaces, so an update that fails can simply be run again.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weektide.constants import RADAR_DAYS, RADAR_REGIONS, RADAR_ROWS
from weektide.operators.clean import marked_drops
from weektide.operators.latest import three_weeks
from weektide.operators.radar import day_tops, in_regions, top_of_days
from weektide.operators.weekly import live_features, marked_drop_features, sound_features
from weektide.sources.events import recent_days
from weektide.sources.tables import stored

TABLES = ("features", "counts", "tops", "files")
FILE_SCHEMA = "ingest_date date, file string, bytes bigint, modified bigint"


def landed_files(spark: SparkSession, root: str, as_of: dt.date, days: int) -> list[tuple]:
    """``(day, file, bytes, modified)`` of the files in the day folders of the look-back, by listing only those folders."""
    out = []
    for back in range(days):
        day = as_of - dt.timedelta(days=back)
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/ingest_date={day}")
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if fs.exists(path):
            files = [f for f in fs.listStatus(path) if f.isFile() and not f.getPath().getName().startswith(("_", "."))]
            out.extend((day, f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in files)
    return out


def read_table(spark: SparkSession, ledger: str, name: str, schema: T.StructType | str) -> DataFrame:
    """A table of the ledger, empty before the first update."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{ledger}/{name}")
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{ledger}/{name}").select(schema.names)


def changed_days(spark: SparkSession, root: str, ledger: str, as_of: dt.date, days: int) -> tuple[list[dt.date], list[tuple]]:
    """Days of the look-back whose files are not those of the ledger, and their files."""
    landed = landed_files(spark, root, as_of, days)
    # As many rows as files in the look-back.
    known = {tuple(r) for r in recent_days(read_table(spark, ledger, "files", FILE_SCHEMA), as_of, days).collect()}
    per_day: dict[dt.date, set] = {}
    for source in (landed, known):
        for row in source:
            per_day.setdefault(row[0], set())
    changed = sorted(d for d in per_day if {r for r in landed if r[0] == d} != {r for r in known if r[0] == d})
    return changed, [r for r in landed if r[0] in set(changed)]


def write_days(df: DataFrame, path: str) -> None:
    """Replace the folders of the days in ``df``, and no others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("ingest_date").parquet(path)


def day_parts(drops: DataFrame, material_class: int) -> dict[str, DataFrame]:
    """What the days of ``drops`` add: features per week, counts of candidates, and top candidates."""
    marked = stored(marked_drops(drops), "new-days")
    candidate = in_regions(RADAR_REGIONS) & F.col("week").isNotNull()
    if "SOURCEURL" in marked.columns:
        candidate = candidate & F.col("SOURCEURL").isNotNull()
    counts = marked.groupBy("ingest_date").agg(
        F.count_if(candidate).alias("candidates"), F.count_if("bad_date").alias("bad_rows"), F.count(F.lit(1)).alias("rows")
    )
    return {"features": marked_drop_features(marked, material_class), "counts": counts, "tops": day_tops(marked)}


def update_ledger(spark: SparkSession, drops_of, root: str, ledger: str, as_of: dt.date, days: int, material_class: int = 4) -> list[dt.date]:
    """Bring the ledger up to date with what landed below ``root`` and return the days that were read.

    ``drops_of`` gives the events of the day folders it is given, with ``ingest_date``. The list of files is written
    last: an update that fails before leaves the days to be read again. A day whose files are gone is taken out.
    """
    changed, files = changed_days(spark, root, ledger, as_of, days)
    present = sorted({row[0] for row in files})
    if present:
        for name, part in day_parts(drops_of(present), material_class).items():
            write_days(part, f"{ledger}/{name}")
        write_days(spark.createDataFrame(files, FILE_SCHEMA).coalesce(1), f"{ledger}/files")
    for name in TABLES:
        for day in set(changed) - set(present):
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{ledger}/{name}/ingest_date={day}")
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return present


def ledger_days(spark: SparkSession, ledger: str, name: str, as_of: dt.date, days: int) -> DataFrame:
    return recent_days(spark.read.parquet(f"{ledger}/{name}"), as_of, days)


def direction_from_ledger(spark: SparkSession, ledger: str, as_of: dt.date, days: int = RADAR_DAYS) -> DataFrame:
    """The three-week snapshot of ``direction_refresh`` without reading an event."""
    return three_weeks(live_from_ledger(spark, ledger, as_of, days))


def live_from_ledger(spark: SparkSession, ledger: str, as_of: dt.date, days: int = RADAR_DAYS) -> DataFrame:
    return live_features(sound_features(ledger_days(spark, ledger, "features", as_of, days)))


def radar_from_ledger(spark: SparkSession, ledger: str, as_of: dt.date, days: int = RADAR_DAYS, rows: int = RADAR_ROWS) -> DataFrame:
    """The top rows of the look-back from the top rows of its days."""
    return top_of_days(ledger_days(spark, ledger, "tops", as_of, days), rows)


def counts_from_ledger(spark: SparkSession, ledger: str, as_of: dt.date, days: int = RADAR_DAYS, rows: int = RADAR_ROWS) -> DataFrame:
    """``(days, skipped_days, total_events_filtered, events_returned)`` of the look-back."""
    sound = F.col("bad_rows") == 0
    kept = F.coalesce(F.sum(F.when(sound, F.col("candidates"))), F.lit(0))
    return ledger_days(spark, ledger, "counts", as_of, days).agg(
        F.count_if(sound).alias("days"), F.count_if(~sound).alias("skipped_days"), kept.alias("total_events_filtered"), F.least(kept, F.lit(rows)).alias("events_returned")
    )
