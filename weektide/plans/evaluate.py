"""Fit, score the hold-out weeks, evaluate, and store what came out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weektide.constants import CRISIS_CLASSES, CRISIS_SPLIT, STRESS_PROBABILITY
from weektide.models.metrics import confusion_counts, metrics, per_class_report
from weektide.models.score import score_each
from weektide.models.train import CRISIS_TREES, BoostedTrees, Bundle, fit_crisis, fit_each, save_bundle
from weektide.operators.panel import split_at
from weektide.sources.prices import require_rows
from weektide.sources.tables import write_table

# Columns of the stored predictions beside the model's own.
PREDICTION_COLUMNS = ["ticker", "week", "weekly_return_current", "future_return_4w", "crisis_level"]


def hold_out_predictions(
    panel: DataFrame, bundles: list[Bundle], split: str = CRISIS_SPLIT, threshold: float = STRESS_PROBABILITY
) -> DataFrame:
    """Hold-out weeks with returns, label, predicted class and both probabilities."""
    _, test = split_at(panel, split)
    scored = score_each(test, bundles, PREDICTION_COLUMNS, threshold)
    return scored.select(*PREDICTION_COLUMNS, "predicted", "proba_0", "proba_1", "confidence")


def evaluation(predictions: DataFrame) -> dict[str, DataFrame]:
    """Confusion counts, metrics and the report by class, each by ticker."""
    counts = confusion_counts(predictions, "crisis_level", "predicted", groups=["ticker"])
    names = {number: name.title() for number, name in CRISIS_CLASSES.items()}
    return {"confusion": counts, "metrics": metrics(counts, ["ticker"]), "per_class": per_class_report(counts, names, ["ticker"])}


def evaluate_crisis(
    panel: DataFrame,
    tickers: list[str],
    out: str,
    settings: BoostedTrees = CRISIS_TREES,
    split: str = CRISIS_SPLIT,
    threshold: float = STRESS_PROBABILITY,
) -> dict[str, DataFrame]:
    """Fit the crisis model of each ticker and write models, predictions and reports below ``out``."""
    spark = panel.sparkSession
    require_rows(panel, "crisis panel")
    bundles = fit_each(tickers, lambda ticker: fit_crisis(panel.where(F.col("ticker") == ticker), ticker, settings, split))
    for bundle in bundles:
        save_bundle(spark, bundle, f"{out}/models/{bundle.ticker}")
    predictions = hold_out_predictions(panel, bundles, split, threshold)
    write_table(predictions, f"{out}/predictions")
    stored = spark.read.schema(predictions.schema).parquet(f"{out}/predictions")
    reports = evaluation(stored)
    for name, report in reports.items():
        write_table(report, f"{out}/{name}")
    return {"predictions": stored} | reports
