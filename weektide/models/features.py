"""Feature lists, alignment and class weights."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weektide.constants import EVENT_FEATURES, TEMPORAL_SUFFIXES


def crisis_features(columns: list[str]) -> list[str]:
    """Event features, the current return, and each temporal feature the panel has."""
    wanted = [f"{name}{suffix}" for name in EVENT_FEATURES for suffix in TEMPORAL_SUFFIXES]
    return EVENT_FEATURES + ["weekly_return_current"] + [name for name in wanted if name in columns]


def aligned(df: DataFrame, features: list[str], keep: list[str] = ()) -> DataFrame:
    """Columns in the order a model expects; a feature that is absent or NULL is 0."""
    ready = [
        F.coalesce(F.col(name).cast("double"), F.lit(0.0)).alias(name) if name in df.columns else F.lit(0.0).alias(name)
        for name in features
    ]
    return df.select(*keep, *ready)


def assembler(features: list[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="error")


def class_weights(df: DataFrame, label: str, groups: list[str] = ()) -> DataFrame:
    """Weight of a class: rows of the largest class over its own rows, per group."""
    counts = df.groupBy(*groups, label).agg(F.count(F.lit(1)).alias("n"))
    if groups:
        largest = F.max("n").over(W.partitionBy(*groups))
    else:
        largest = counts.agg(F.max("n")).scalar()
    return counts.select(*groups, label, "n", (largest / F.col("n")).alias("weight"))


def with_class_weight(df: DataFrame, label: str) -> DataFrame:
    """Add the weight of each row's class; there are as many weights as classes."""
    weights = class_weights(df, label).select(label, "weight")
    return df.join(F.broadcast(weights), label)
