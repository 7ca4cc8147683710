"""Weekly event features.

One grouped aggregation serves all measures. Every measure is a sum or a minimum, so
Spark combines them map-side and a week that holds a third of all rows still reaches
the shuffle as one row per task. The same measures can be stored per ingest day and
merged later without reading the events again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weektide.constants import QUAD_LABELS
from weektide.functions import flags
from weektide.functions.intensity import MENTIONS, SCALE, negative_intensity, positive_intensity
from weektide.functions.numbers import ratio, total, total_if


@dataclass(frozen=True)
class Measure:
    """A column that merges by sum, or by minimum, and the SQL it starts from."""

    name: str
    start: str
    smallest: bool = False

    def first(self) -> Column:
        return F.expr(self.start).alias(self.name)

    def merge(self) -> Column:
        return (F.min(self.name) if self.smallest else F.sum(self.name)).alias(self.name)


def _sum(value: str, condition: str | None = None) -> str:
    """Sum that is 0 when nothing was added."""
    return f"coalesce(sum({value if condition is None else f'if({condition}, {value}, NULL)'}), 0)"


# Every measure merges, so the list serves one pass, stored parts and streams alike.
MEASURES = [
    Measure("nb_events", "count(EventCode)"),
    Measure("total_mentions", _sum("NumMentions")),
    Measure("total_articles", _sum("NumArticles")),
    Measure("goldstein_sum", "sum(GoldsteinScale)"),
    Measure("goldstein_rows", "count(GoldsteinScale)"),
    Measure("min_goldstein", "min(GoldsteinScale)", smallest=True),
    Measure("tone_sum", "sum(AvgTone)"),
    Measure("tone_rows", "count(AvgTone)"),
    Measure("min_tone", "min(AvgTone)", smallest=True),
    Measure("tension_score", _sum("negative_intensity")),
    Measure("cooperation_score", _sum("positive_intensity")),
    Measure("verbal_conflict_mentions", _sum("NumMentions", "is_verbal_conflict")),
    Measure("material_conflict_mentions", _sum("material_mentions")),
    Measure("verbal_coop_mentions", _sum("NumMentions", "is_verbal_coop")),
    Measure("material_coop_mentions", _sum("NumMentions", "is_material_coop")),
    Measure("major_country_events", "count_if(is_major)"),
    Measure("major_country_conflict_mentions", _sum("material_mentions", "is_major")),
    Measure("usa_conflict_mentions", _sum("material_mentions", "usa_event")),
    Measure("china_conflict_mentions", _sum("material_mentions", "china_event")),
    Measure("russia_conflict_mentions", _sum("material_mentions", "russia_event")),
    Measure("middle_east_conflict_mentions", _sum("material_mentions", "middle_east_event")),
    Measure("usa_china_tension", _sum("negative_intensity", "usa_china_relation")),
    Measure("usa_russia_tension", _sum("negative_intensity", "usa_russia_relation")),
]


def with_event_flags(events: DataFrame, material_class: int = 4) -> DataFrame:
    """Flags and intensities the measures use.

    What several measures share is computed once per row: the optimizer keeps such
    columns in their own projection and inlines the rest.
    """
    material = flags.is_class(material_class)
    return events.withColumns(
        {
            "negative_intensity": negative_intensity(),
            "positive_intensity": positive_intensity(),
            "material_mentions": F.when(material, F.col(MENTIONS)),
            "is_verbal_coop": flags.is_class(1),
            "is_material_coop": flags.is_class(2),
            "is_verbal_conflict": flags.is_class(3),
            "is_major": flags.is_major(),
            "usa_event": flags.involves("usa"),
            "china_event": flags.involves("china"),
            "russia_event": flags.involves("russia"),
            "middle_east_event": flags.in_middle_east(),
            "usa_china_relation": flags.between("usa", "china"),
            "usa_russia_relation": flags.between("usa", "russia"),
        }
    )


def weekly_partials(events: DataFrame, keys: list[Column | str] = ("week",), material_class: int = 4) -> DataFrame:
    """Mergeable measures per key, for example per ingest day and week.

    ``material_class`` is the class counted as material conflict.
    """
    return with_event_flags(events, material_class).groupBy(*keys).agg(*[m.first() for m in MEASURES])


def merge_partials(partials: DataFrame, keys: list[str] = ("week",)) -> DataFrame:
    """Exact weekly measures from stored partial ones."""
    return partials.groupBy(*keys).agg(*[m.merge() for m in MEASURES])


def finish_weekly(measures: DataFrame) -> DataFrame:
    """Averages, class totals and ratios from the measures."""
    mentions = F.col("total_mentions") + 1
    out = measures.withColumns(
        {
            "avg_goldstein": ratio(F.col("goldstein_sum"), F.col("goldstein_rows")),
            "avg_tone": ratio(F.col("tone_sum"), F.col("tone_rows")),
            "conflict_mentions": F.col("verbal_conflict_mentions") + F.col("material_conflict_mentions"),
            "coop_mentions": F.col("verbal_coop_mentions") + F.col("material_coop_mentions"),
        }
    ).drop("goldstein_sum", "goldstein_rows", "tone_sum", "tone_rows")
    return out.withColumns(
        {
            "conflict_ratio": ratio(F.col("conflict_mentions"), mentions),
            "material_conflict_ratio": ratio(F.col("material_conflict_mentions"), mentions),
            "major_conflict_ratio": ratio(F.col("major_country_conflict_mentions"), mentions),
        }
    )


def weekly_features(events: DataFrame, material_class: int = 4) -> DataFrame:
    """Weekly panel of the crisis model, one row per week that has events."""
    return finish_weekly(weekly_partials(events, material_class=material_class))


def weekly_features_lite(events: DataFrame) -> DataFrame:
    """Weekly panel of the direction model; classes are told by their label."""
    mentions = F.col(MENTIONS)

    def labelled(number: int) -> Column:
        return flags.known(f"QuadClassLabel = '{QUAD_LABELS[number]}'")

    return events.groupBy("week").agg(
        F.count("EventCode").alias("nb_events"),
        total(mentions).alias("total_mentions"),
        F.avg(SCALE).alias("avg_goldstein"),
        F.avg("AvgTone").alias("avg_tone"),
        total(negative_intensity()).alias("tension_score"),
        total_if(labelled(4), mentions).alias("mat_conf_mentions"),
        total_if(labelled(3), mentions).alias("verb_conf_mentions"),
    )


def drop_features(drops: DataFrame, material_class: int = 4) -> DataFrame:
    """Features per ingest day and week; 3 as ``material_class`` repeats the old live snapshot."""
    return drops.groupBy("ingest_date", "week").agg(*drop_measures(material_class))


def drop_measures(material_class: int) -> list[Column]:
    return [
        F.count("EventCode").alias("nb_events"),
        F.avg("AvgTone").alias("avg_tone"),
        total(negative_intensity()).alias("tension_score"),
        total_if(flags.is_class_text(material_class), F.col(MENTIONS)).alias("mat_conf_mentions"),
    ]


def marked_drop_features(marked: DataFrame, material_class: int = 4) -> DataFrame:
    """``drop_features`` with ``bad_rows`` of each ingest day, bad days and rows without a date included.

    ``marked`` comes from ``marked_drops``. The events are aggregated in one pass; what is left to compare within a day
    is one row for each of its weeks.
    """
    grouped = marked.groupBy("ingest_date", "week").agg(*drop_measures(material_class), F.count_if("bad_date").alias("bad"), F.count(F.lit(1)).alias("rows"))
    day = W.partitionBy("ingest_date")
    return grouped.withColumns({"bad_rows": F.sum("bad").over(day), "day_rows": F.sum("rows").over(day)}).drop("bad", "rows")


def sound_features(day_features: DataFrame) -> DataFrame:
    """The day features of days without a bad date."""
    return day_features.where("bad_rows = 0 AND week IS NOT NULL").drop("bad_rows", "day_rows")


def live_features(day_features: DataFrame) -> DataFrame:
    """Weekly live features; the tone is a mean of daily means."""
    return day_features.groupBy("week").agg(
        F.sum("nb_events").alias("nb_events"),
        F.avg("avg_tone").alias("avg_tone"),
        F.sum("tension_score").alias("tension_score"),
        F.sum("mat_conf_mentions").alias("mat_conf_mentions"),
    )
