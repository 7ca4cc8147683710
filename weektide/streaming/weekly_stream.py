"""Weekly features kept fresh while event files land, with late events.

State is one row per open week: the mergeable measures of the batch job. The watermark
closes weeks and drops what arrives later. A table of arrivals counts, for each micro-batch and week, the rows
that came and whether the watermark had closed their week; it outlives restarts.

What a micro-batch writes replaces what the same batch wrote before, so a batch that is run again changes nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from weektide.constants import RADAR_ROWS, TOP_ROWS
from weektide.functions import flags
from weektide.functions.dates import day_of_instant, day_start, monday_of
from weektide.functions.intensity import MENTIONS
from weektide.functions.numbers import total
from weektide.operators.radar import radar_candidates, risk_order, shown
from weektide.operators.weekly import MEASURES, finish_weekly, weekly_partials

# Weeks are seven days long and start four days after the epoch's Thursday.
WEEK = "7 days"
MONDAY_OFFSET = "4 days"

ARRIVALS = "week date, rows bigint, last_day date, is_late boolean, batch_id bigint"

# A backlog is worked off in micro-batches of this size.
FILES_PER_BATCH = 1000


def read_stream(
    spark: SparkSession,
    folder: str,
    schema: T.StructType,
    file_format: str = "parquet",
    files_per_batch: int = FILES_PER_BATCH,
    file_pattern: str | None = None,
) -> DataFrame:
    """Event files as they land in a folder, so many in a micro-batch at most."""
    reader = spark.readStream.schema(schema).format(file_format).option("maxFilesPerTrigger", files_per_batch)
    if file_pattern:
        reader = reader.option("pathGlobFilter", file_pattern)
    return reader.load(folder)


def weekly_stream(events: DataFrame, delay: str = "14 days", day: str = "SQLDATE") -> DataFrame:
    """Weekly measures over event time.

    ``events`` has the cleaned columns with ``day`` as DATE. Weeks are cut on UTC midnight
    of the day, so the session time zone has no part in it.
    """
    timed = events.withColumn("event_ts", day_start(F.col(day))).withWatermark("event_ts", delay)
    measures = weekly_partials(timed, [F.window("event_ts", WEEK, WEEK, MONDAY_OFFSET)])
    return measures.withColumn("week", day_of_instant(F.col("window.start"))).drop("window")


def append_closed_weeks(weekly: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Write each week once, when the watermark has passed its end."""
    return (
        weekly.writeStream.outputMode("append")
        .format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def upsert_open_weeks(weekly: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Write every changed week of a micro-batch, also the newest, still open one.

    Each week has one folder, which its newest state replaces: there are as many folders as weeks, however many batches
    run. A batch that is run again writes the same states again.
    """

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        states = batch.withColumn("batch_id", F.lit(batch_id))
        states.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("week").parquet(out)

    return (
        weekly.writeStream.outputMode("update")
        .foreachBatch(write_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def count_arrivals(events: DataFrame, out: str, checkpoint: str, delay_days: int, day: str = "SQLDATE") -> StreamingQuery:
    """Keep ``(week, rows, last_day, is_late)`` of every micro-batch, one row for each of its weeks.

    A week is late as the watermark has it: its end lies ``delay_days`` or more behind the newest day of the batches
    before. That day is read from what those batches wrote, so it is the same after a restart.
    """

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        weeks = batch.where(F.col(day).isNotNull()).groupBy(monday_of(F.col(day)).alias("week"))
        counted = weeks.agg(F.count(F.lit(1)).alias("rows"), F.max(day).alias("last_day"))
        closed = F.lit(False)
        if batch_id:
            newest = spark.read.schema(ARRIVALS).parquet(out).where(F.col("batch_id") < batch_id).agg(F.max("last_day")).first()[0]
            if newest is not None:
                closed = F.date_add("week", 7) <= F.date_sub(F.lit(newest), delay_days)
        counted.withColumn("is_late", closed).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    return (
        events.writeStream.foreachBatch(write_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def late_rows(spark: SparkSession, out: str) -> DataFrame:
    """``(batch_id, week, rows)`` of the rows that came after their week was closed."""
    return spark.read.schema(ARRIVALS).parquet(out).where("is_late").select("batch_id", "week", "rows")


def late_groups(query: StreamingQuery) -> int:
    """Rows that the watermark has dropped so far, as Spark counts them: after each task has
    added up what it read of a week."""
    return sum(int(op["numRowsDroppedByWatermark"]) for batch in query.recentProgress for op in batch["stateOperators"])


def current_weeks(spark: SparkSession, out: str) -> DataFrame:
    """Weekly features from the newest state of each week."""
    return finish_weekly(spark.read.parquet(out).select("week", *[m.name for m in MEASURES]))


def refresh_snapshots(events: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Keep what the latest-week snapshots need, per micro-batch.

    Sums per week and key merge by adding, and the top rows of a week are among the top
    rows of its batches, so the stored parts are small and the snapshots exact. The parts
    are laid out by week, and a snapshot reads those of the newest week alone. For the
    radar, each task passes on its own 50 top rows of a week, also of a week that holds most
    of a batch.
    """

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        dated = batch.withColumn("week", monday_of(F.col("SQLDATE")))
        by_key = dated.groupBy("week", "EventDescriptionFinal", flags.GEO, flags.is_conflict().alias("is_conflict"))
        sums = by_key.agg(total(F.col(MENTIONS)).alias("mentions"))
        sums.write.mode("overwrite").partitionBy("week").parquet(f"{out}/mentions/batch_id={batch_id}")
        candidates = radar_candidates(dated)
        columns = shown(candidates)
        ranked = F.row_number().over(W.partitionBy("week").orderBy(*risk_order(columns)))
        top = candidates.select("week", *columns).withColumn("rank", ranked).where(F.col("rank") <= RADAR_ROWS)
        top.drop("rank").write.mode("overwrite").partitionBy("week").parquet(f"{out}/radar/batch_id={batch_id}")

    return (
        events.writeStream.foreachBatch(write_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def compact_snapshots(spark: SparkSession, out: str) -> int:
    """Merge the parts of all batches so far into one folder per week, and return the number of the new state.

    The merged parts are written beside the old ones and become the state when their manifest is written, which comes
    last: readers see the old parts or the new ones, and a merge that fails leaves the old. Only one merge may run at
    a time. ``clear_merged`` removes what no manifest names any more.
    """
    now, through = _manifest(spark, out)
    batches = sorted(_batches(spark, out))
    if not [b for b in batches if b > through]:
        return now
    mentions, tops = _parts(spark, out, "mentions"), _parts(spark, out, "radar")
    sums = mentions.groupBy("week", "EventDescriptionFinal", flags.GEO, "is_conflict").agg(F.sum("mentions").alias("mentions"))
    sums.hint("rebalance", "week").write.mode("overwrite").partitionBy("week").parquet(f"{out}/mentions/state={now + 1}")
    columns = shown(tops)
    ranked = F.row_number().over(W.partitionBy("week").orderBy(*risk_order(columns)))
    top = tops.select("week", *columns).withColumn("rank", ranked).where(F.col("rank") <= RADAR_ROWS).drop("rank")
    top.hint("rebalance", "week").write.mode("overwrite").partitionBy("week").parquet(f"{out}/radar/state={now + 1}")
    row = spark.range(1).select(F.lit(now + 1).alias("state"), F.lit(batches[-1]).alias("through"))
    row.coalesce(1).write.mode("overwrite").json(f"{out}/manifests/state={now + 1}")
    return now + 1


def clear_merged(spark: SparkSession, out: str) -> None:
    """Remove the batches and states that the newest manifest has replaced, once nobody reads them."""
    now, through = _manifest(spark, out)
    fs, base = _files(spark, out)
    for kind in ("mentions", "radar"):
        for name in _names(spark, f"{out}/{kind}"):
            key, _, number = name.partition("=")
            if (key == "batch_id" and int(number) <= through) or (key == "state" and int(number) < now):
                fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{out}/{kind}/{name}"), True)


def _files(spark: SparkSession, path: str):
    base = spark._jvm.org.apache.hadoop.fs.Path(path)
    return base.getFileSystem(spark._jsc.hadoopConfiguration()), base


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, base = _files(spark, path)
    return [f.getPath().getName() for f in fs.listStatus(base)] if fs.exists(base) else []


def _manifest(spark: SparkSession, out: str) -> tuple[int, int]:
    """Newest state whose manifest is complete, and the last batch it holds; 0 and -1 before the first merge."""
    fs, _ = _files(spark, out)
    done = [n for n in _names(spark, f"{out}/manifests") if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{out}/manifests/{n}/_SUCCESS"))]
    if not done:
        return 0, -1
    newest = max(int(n.partition("=")[2]) for n in done)
    row = spark.read.schema("state bigint, through bigint").json(f"{out}/manifests/state={newest}").first()
    return row["state"], row["through"]


def _batches(spark: SparkSession, out: str) -> list[int]:
    """Batches that have written both of their parts."""
    both = [{int(n.partition("=")[2]) for n in _names(spark, f"{out}/{kind}") if n.startswith("batch_id=")} for kind in ("mentions", "radar")]
    return list(both[0] & both[1])


def _parts(spark: SparkSession, out: str, kind: str) -> DataFrame:
    """The merged parts of the newest state, and those of the batches after it."""
    state, through = _manifest(spark, out)
    folders = [f"{out}/{kind}/state={state}"] if state else []
    folders += [f"{out}/{kind}/batch_id={b}" for b in sorted(_batches(spark, out)) if b > through]
    frames = [spark.read.option("basePath", folder).parquet(folder) for folder in folders]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def _newest(parts: DataFrame) -> DataFrame:
    return parts.where(F.col("week") == parts.agg(F.max("week")).scalar())


def current_top_events(spark: SparkSession, out: str, rows: int = TOP_ROWS) -> DataFrame:
    return _top(_newest(_parts(spark, out, "mentions")), "EventDescriptionFinal", rows)


def current_top_conflict_places(spark: SparkSession, out: str, rows: int = TOP_ROWS) -> DataFrame:
    parts = _newest(_parts(spark, out, "mentions"))
    return _top(parts.where("is_conflict"), flags.GEO, rows)


def _top(parts: DataFrame, key: str, rows: int) -> DataFrame:
    sums = parts.where(F.col(key).isNotNull()).groupBy(key).agg(F.sum("mentions").alias("mentions"))
    return sums.orderBy(F.col("mentions").desc(), key).limit(rows)


def current_radar(spark: SparkSession, out: str, rows: int = RADAR_ROWS) -> DataFrame:
    parts = _newest(_parts(spark, out, "radar"))
    columns = shown(parts)
    return parts.select(*columns).orderBy(*risk_order(columns)).limit(rows)
