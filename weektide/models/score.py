"""Scoring and scenario tables."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weektide.constants import CRISIS_CLASSES, DIRECTION_NAMES, SCENARIO_BASELINE, SERVING_PROBABILITY
from weektide.models.features import aligned
from weektide.models.train import Bundle


def score(df: DataFrame, bundle: Bundle, keep: list[str], threshold: float = SERVING_PROBABILITY) -> DataFrame:
    """Probabilities, predicted class and confidence in percent, beside the columns to keep.

    A column to keep may be a feature as well.
    """
    ready = aligned(df.withColumn("kept", F.struct(*keep)), bundle.features, ["kept"])
    probability = vector_to_array(F.col("probability"))
    scored = bundle.model.transform(ready).select(
        "kept.*", probability[0].alias("proba_0"), probability[1].alias("proba_1")
    )
    predicted = F.when(F.col("proba_1") >= threshold, 1).otherwise(0)
    confidence = F.when(F.col("predicted") == 1, F.col("proba_1")).otherwise(F.col("proba_0"))
    return scored.withColumn("predicted", predicted).withColumn("confidence", F.round(confidence * 100, 2))


def score_each(df: DataFrame, bundles: list[Bundle], keep: list[str], threshold: float = SERVING_PROBABILITY) -> DataFrame:
    """Score the rows of every ticker with its own model."""
    parts = [score(df.where(F.col("ticker") == b.ticker), b, keep, threshold) for b in bundles]
    return reduce(DataFrame.unionByName, parts)


def class_name(names: dict[int, str]) -> Column:
    pairs = [F.lit(item) for pair in names.items() for item in pair]
    return F.try_element_at(F.create_map(*pairs), F.col("predicted"))


def percent_text(value: Column) -> Column:
    return F.concat(F.format_string("%.2f", value * 100), F.lit("%"))


def scenario_rows(scenarios: DataFrame, tickers: list[str]) -> DataFrame:
    """Scenarios ``(simulated_tone, simulated_tension, simulated_material_conflicts)`` per asset,
    each laid on the neutral week."""
    neutral = [F.lit(value).alias(name) for name, value in SCENARIO_BASELINE.items()]
    return scenarios.select(
        F.explode(F.array(*[F.lit(t) for t in tickers])).alias("ticker"),
        "simulated_tone",
        "simulated_tension",
        "simulated_material_conflicts",
        F.col("simulated_tone").cast("double").alias("avg_tone"),
        F.col("simulated_tension").cast("double").alias("tension_score"),
        F.col("simulated_material_conflicts").cast("double").alias("mat_conf_mentions"),
        *neutral,
    )


def scenario_report(scenarios: DataFrame, bundles: list[Bundle]) -> DataFrame:
    keep = ["ticker", "simulated_tone", "simulated_tension", "simulated_material_conflicts"]
    scored = score_each(scenario_rows(scenarios, [b.ticker for b in bundles]), bundles, keep)
    named = scored.withColumn("tendance", class_name(DIRECTION_NAMES))
    message = F.concat(
        F.col("tendance"),
        F.lit(" anticipée pour "),
        F.col("ticker"),
        F.lit(" avec une confiance de "),
        F.col("confidence").cast("string"),
        F.lit("%."),
    )
    return named.select(
        F.col("ticker").alias("actif"),
        *keep[1:],
        F.col("predicted").alias("prediction"),
        "tendance",
        F.col("confidence").alias("confiance"),
        message.alias("message_analyse"),
    )


def crisis_levels(scored: DataFrame) -> DataFrame:
    """Class name and probabilities in percent per class."""
    percents = [
        item
        for number, name in CRISIS_CLASSES.items()
        for item in (F.lit(name.lower()), F.round(F.col(f"proba_{number}") * 100, 2))
    ]
    return scored.select(
        "ticker",
        class_name(CRISIS_CLASSES).alias("niveau_crise"),
        F.col("predicted").alias("classe_predite"),
        F.create_map(*percents).alias("probabilites"),
        F.col("confidence").alias("confiance_prediction"),
    )
