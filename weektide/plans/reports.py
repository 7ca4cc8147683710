"""Reports that serve the snapshots and the models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weektide.constants import DIRECTION_NAMES, REPORT_VARIABLES
from weektide.models.score import class_name, crisis_levels, percent_text, score_each
from weektide.models.train import Bundle
from weektide.sources.tables import pick


def crisis_report(snapshot: DataFrame, bundles: list[Bundle]) -> DataFrame:
    """Latest-week crisis report for every ticker that has a model."""
    names = sorted({name for bundle in bundles for name in bundle.features})
    flat = snapshot.select("ticker", *[F.try_element_at("features", F.lit(n)).alias(n) for n in names])
    levels = crisis_levels(score_each(flat, bundles, ["ticker"]))
    return levels.join(snapshot, "ticker").select(
        F.col("ticker").alias("actif"),
        "niveau_crise",
        "classe_predite",
        "probabilites",
        "confiance_prediction",
        F.col("last_updated").alias("derniere_maj_gdelt"),
        F.col("week").alias("semaine_gdelt"),
        pick("features", REPORT_VARIABLES).alias("variables_importantes"),
        "top_events",
        "top_conflict_countries",
        "evolution",
    )


def direction_report(snapshot: DataFrame, momentum: DataFrame, bundles: list[Bundle]) -> DataFrame:
    """Served direction per ticker: the one-row three-week snapshot with the ticker's short return."""
    week = snapshot.agg(F.first(F.struct(*snapshot.columns)).alias("week")).scalar()
    rows = momentum.select("ticker", "current_return", week.alias("week")).select(
        "ticker", "current_return", "week.*", F.col("current_return").alias("weekly_return_current")
    )
    scored = score_each(rows, bundles, ["ticker", "current_return", "last_updated"])
    return scored.select(
        F.col("ticker").alias("actif"),
        class_name(DIRECTION_NAMES).alias("tendance"),
        F.col("confidence").alias("confiance"),
        F.col("last_updated").alias("derniere_maj_gdelt"),
        percent_text(F.col("current_return")).alias("rendement_actuel_pris_en_compte"),
    )
