"""Reports on the latest week."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weektide.constants import EVOLUTION_VARIABLES, TOP_ROWS
from weektide.functions import flags
from weektide.functions.dates import monday_of
from weektide.functions.intensity import MENTIONS
from weektide.functions.numbers import coerce_numbers, ratio, total
from weektide.operators.weekly import weekly_partials
from weektide.sources.tables import stored


def latest_week(events: DataFrame, day: str = "SQLDATE") -> DataFrame:
    """Rows of the newest week.

    The newest day is read first, from that column alone. The filter then compares the day
    column with a literal, which reaches the scan and skips files and row groups.
    """
    newest = events.agg(monday_of(F.max(day)).alias("monday")).first()["monday"]
    return events.where(F.col(day) >= F.lit(newest).cast("date"))


def event_cube(events: DataFrame) -> DataFrame:
    """Mergeable measures by week, description, place and conflict, stored.

    One pass over the events gives all that a snapshot needs: weekly features, newest week
    and both top lists come from this small table.
    """
    keys = ["week", "EventDescriptionFinal", flags.GEO, flags.is_conflict().alias("is_conflict")]
    return stored(weekly_partials(events, keys), "event-cube")


def cube_as_events(cube: DataFrame) -> DataFrame:
    """The cube in the shape that the top lists read."""
    return cube.select(
        "week",
        "EventDescriptionFinal",
        flags.GEO,
        F.when(F.col("is_conflict"), 4).otherwise(1).alias("QuadClass"),
        F.col("total_mentions").alias(MENTIONS),
    )


def top_by_mentions(events: DataFrame, key: str, rows: int = TOP_ROWS) -> DataFrame:
    """The ``rows`` keys with most mentions; ties go to the smaller key."""
    grouped = (
        coerce_numbers(events, [MENTIONS], whole=[MENTIONS], fill=0)
        .where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(total(F.col(MENTIONS)).alias("mentions"))
    )
    return grouped.orderBy(F.col("mentions").desc(), key).limit(rows)


def top_events(latest: DataFrame, rows: int = TOP_ROWS) -> DataFrame:
    return top_by_mentions(latest, "EventDescriptionFinal", rows)


def top_conflict_places(latest: DataFrame, rows: int = TOP_ROWS) -> DataFrame:
    conflicts = coerce_numbers(latest, ["QuadClass"]).where(flags.is_conflict())
    return top_by_mentions(conflicts, flags.GEO, rows)


def as_map(top: DataFrame, key: str) -> Column:
    """Top list as a map in rank order; holds no more entries than the list has rows."""
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("mentions")).alias("order"), key, "mentions")))
    entries = F.transform(ranked, lambda row: F.struct(row[key], row["mentions"]))
    return top.agg(F.map_from_entries(entries).alias("entries")).scalar()


def last_two(panel: DataFrame) -> DataFrame:
    """Newest row per ticker with the row before it as ``previous``."""
    newest_first = W.partitionBy("ticker").orderBy(F.col("week").desc())
    before = F.lead(F.struct(*EVOLUTION_VARIABLES)).over(newest_first)
    return (
        panel.withColumns({"previous": before, "age": F.row_number().over(newest_first)})
        .where(F.col("age") == 1)
        .drop("age")
    )


def evolution_map(current: str | None = None, previous: str = "previous") -> Column:
    """Percent change per variable; left out where the earlier value is missing or 0."""
    entries = []
    for name in EVOLUTION_VARIABLES:
        now = F.col(f"{current}.{name}" if current else name)
        then = F.col(f"{previous}.{name}")
        percent = F.round(ratio(now - then, F.abs(then)) * 100, 2)
        entries += [F.lit(name), percent]
    return F.map_filter(F.create_map(*entries), lambda _, value: value.isNotNull())


def evolution(panel: DataFrame) -> DataFrame:
    """``(ticker, week, evolution)`` for the newest week of each ticker."""
    return last_two(panel).select("ticker", "week", evolution_map().alias("evolution"))


def features_map(panel: DataFrame) -> Column:
    """All numeric features of a row that have a value."""
    names = [name for name in panel.columns if name not in ("ticker", "week", "previous")]
    entries = [item for name in names for item in (F.lit(name), F.col(name).cast("double"))]
    return F.map_filter(F.create_map(*entries), lambda _, value: value.isNotNull())


def crisis_snapshot(panel: DataFrame, latest: DataFrame, as_of: Column | None = None) -> DataFrame:
    """One document per ticker: features, top lists and change of the newest week.

    The top lists do not depend on the ticker and come in as scalar subqueries.
    """
    updated = F.date_format(as_of if as_of is not None else F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")
    newest = last_two(panel)
    return newest.select(
        "ticker",
        updated.alias("last_updated"),
        F.date_format("week", "yyyy-MM-dd HH:mm:ss").alias("week"),
        features_map(newest).alias("features"),
        as_map(top_events(latest), "EventDescriptionFinal").alias("top_events"),
        as_map(top_conflict_places(latest), flags.GEO).alias("top_conflict_countries"),
        evolution_map().alias("evolution"),
    )


def three_weeks(weekly: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Current, previous and second previous week side by side; no row unless all three exist.

    Only the three newest rows reach the final step.
    """
    updated = F.date_format(as_of if as_of is not None else F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")
    names = ["nb_events", "avg_tone", "tension_score", "mat_conf_mentions"]
    newest = weekly.orderBy(F.col("week").desc()).limit(3)
    rows = newest.agg(F.sort_array(F.collect_list(F.struct("week", *names)), asc=False).alias("w"))
    lagged = [
        F.col("w")[age][name].alias(f"{name}_lag{age}") for age in (1, 2) for name in names[:3]
    ]
    return rows.where(F.size("w") >= 3).select(
        updated.alias("last_updated"), *[F.col("w")[0][name].alias(name) for name in names], *lagged
    )
