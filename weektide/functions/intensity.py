"""Mention-weighted intensity of events."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCALE = "GoldsteinScale"
MENTIONS = "NumMentions"


def negative_intensity() -> Column:
    scale = F.col(SCALE)
    return F.when(scale.isNotNull(), F.when(scale < 0, -scale).otherwise(F.lit(0.0)) * F.col(MENTIONS))


def positive_intensity() -> Column:
    scale = F.col(SCALE)
    return F.when(scale.isNotNull(), F.when(scale > 0, scale).otherwise(F.lit(0.0)) * F.col(MENTIONS))


def risk_score() -> Column:
    return F.when(F.col(SCALE) < 0, -F.col(SCALE) * F.col(MENTIONS)).otherwise(F.lit(0.0))
