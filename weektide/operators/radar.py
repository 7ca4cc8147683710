"""Radar of the riskiest events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weektide.constants import FOCUS_ROWS, RADAR_COLUMNS, RADAR_REGIONS, RADAR_ROWS
from weektide.functions.flags import in_regions
from weektide.functions.numbers import complete_rows
from weektide.operators.clean import with_risk


def radar_candidates(drops: DataFrame, regions: list[str] = RADAR_REGIONS) -> DataFrame:
    """Scored events of the tracked regions that can be linked."""
    scored = with_risk(drops.where(in_regions(regions)))
    return complete_rows(scored, ["SOURCEURL"]) if "SOURCEURL" in scored.columns else scored


def shown(df: DataFrame) -> list[str]:
    return [name for name in RADAR_COLUMNS if name in df.columns]


def risk_order(columns: list[str]) -> list[Column]:
    """By score; every other shown column breaks ties, so the list is the same on each run."""
    return [F.col("RiskScore").desc(), *[F.col(name).asc() for name in columns if name != "RiskScore"]]


def top_radar(candidates: DataFrame, rows: int = RADAR_ROWS) -> DataFrame:
    """Top rows by score: each task keeps ``rows`` rows, there is no global sort."""
    columns = shown(candidates)
    return candidates.select(*columns).orderBy(*risk_order(columns)).limit(rows)


def day_tops(marked: DataFrame, regions: list[str] = RADAR_REGIONS, rows: int = RADAR_ROWS) -> DataFrame:
    """The top ``rows`` candidates of each ingest day, and with them whether the day holds a bad date.

    ``marked`` comes from ``marked_drops``. Rows with a bad date rank before all others, so the first row of a bad day
    tells, and each task hands on ``rows`` rows of a day at most.
    """
    scored = with_risk(marked).withColumn("is_candidate", in_regions(regions) & F.col("week").isNotNull())
    if "SOURCEURL" in scored.columns:
        scored = scored.withColumn("is_candidate", F.col("is_candidate") & F.col("SOURCEURL").isNotNull())
    columns = shown(scored)
    kept = scored.where("bad_date OR is_candidate").select("ingest_date", "bad_date", *columns)
    ranked = F.row_number().over(W.partitionBy("ingest_date").orderBy(F.col("bad_date").desc(), *risk_order(columns)))
    top = kept.withColumn("place", ranked).where(F.col("place") <= rows)
    return top.withColumn("bad_day", F.max("bad_date").over(W.partitionBy("ingest_date"))).drop("place", "bad_date")


def top_of_days(tops: DataFrame, rows: int = RADAR_ROWS) -> DataFrame:
    """Top of the days without a bad date, from the tops of the days."""
    return top_radar(tops.where("NOT bad_day"), rows)


def focus(radar: DataFrame, rows: int = FOCUS_ROWS) -> DataFrame:
    """Top of the radar by the numeric score."""
    return radar.orderBy(*risk_order(radar.columns)).limit(rows)


def as_text(radar: DataFrame) -> DataFrame:
    """All fields as text for export; missing ones are empty."""
    return radar.select(*[F.coalesce(plain_text(radar, n), F.lit("")).alias(n) for n in radar.columns])


def plain_text(df: DataFrame, name: str) -> Column:
    """A column as text; large numbers are written out and not with an exponent."""
    text = F.col(name).cast("string")
    if not isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return text
    written_out = F.regexp_replace(text.cast("decimal(38, 12)").cast("string"), r"(\.\d+?)0*$", "$1")
    return F.when(F.abs(name).between(1e7, 1e16), written_out).otherwise(text)


def radar_header(candidates: DataFrame, period: Column, regions: list[str] = RADAR_REGIONS, rows: int = RADAR_ROWS) -> DataFrame:
    """One row with the period and the counts."""
    counted = F.count(F.lit(1))
    return candidates.agg(
        period.alias("period"),
        F.array(*[F.lit(code) for code in regions]).alias("regions_tracked"),
        counted.cast("string").alias("total_events_filtered"),
        F.least(counted, F.lit(rows)).cast("string").alias("events_returned"),
    )


def radar_document(candidates: DataFrame, period: Column, regions: list[str] = RADAR_REGIONS, rows: int = RADAR_ROWS) -> DataFrame:
    """Header and ranked events as one nested row; the array holds at most ``rows`` events."""
    top = top_radar(candidates, rows)
    columns = top.columns
    keyed = F.struct((-F.col("RiskScore")).alias("rank_score"), *[F.col(n).alias(f"k_{n}") for n in columns if n != "RiskScore"])
    text = F.struct(*[F.coalesce(plain_text(top, n), F.lit("")).alias(n) for n in columns])
    ranked = F.array_sort(F.collect_list(F.struct(keyed.alias("key"), text.alias("event"))))
    events = top.agg(F.transform(ranked, lambda row: row["event"]).alias("events")).scalar()
    return radar_header(candidates, period, regions, rows).withColumn("events", events)


def days_period(as_of: Column, days: int) -> Column:
    """``yyyyMMdd to yyyyMMdd`` text of the look-back."""
    return F.concat_ws(" to ", F.date_format(F.date_sub(as_of, days - 1), "yyyyMMdd"), F.date_format(as_of, "yyyyMMdd"))
