"""Classifiers, one per ticker, on a temporal split.

Fits are distributed by Spark ML. Each runs Spark jobs on the weeks of one configured
ticker, and several tickers are fitted at a time.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import SparkContext
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, RandomForestClassifier
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weektide.constants import (
    CRISIS_CLASSES,
    CRISIS_SPLIT,
    DIRECTION_FEATURES,
    DIRECTION_NAMES,
    DIRECTION_SPLIT,
    FOREST_TICKERS,
)
from weektide.models.features import assembler, crisis_features, with_class_weight
from weektide.operators.panel import split_at
from weektide.session import ensure_checkpoints

SEED = 42


@dataclass(frozen=True)
class BoostedTrees:
    """Settings of a boosted-tree fit.

    ``patience_share`` is the share of the newest training weeks kept aside to choose the
    number of rounds; 0 turns that off. The round with the smallest loss on them is kept
    when ``patience`` further rounds bring no smaller one. The hold-out weeks are never
    used for it.
    """

    iterations: int = 100
    depth: int = 2
    rate: float = 0.02
    min_rows: int = 1
    patience_share: float = 0.0
    patience: int = 100


# Settings of the two published models.
CRISIS_TREES = BoostedTrees(iterations=100, depth=2, rate=0.02, patience_share=0.2)
DIRECTION_TREES = BoostedTrees(iterations=892, depth=3, rate=0.09093093204104495, min_rows=12, patience_share=0.2)


@dataclass(frozen=True)
class Bundle:
    """Fitted model with what is needed to score with it."""

    model: PipelineModel
    ticker: str
    target: str
    features: list[str] = field(default_factory=list)
    classes: dict[int, str] = field(default_factory=dict)


def mark_validation(train: DataFrame, share: float) -> DataFrame:
    """Flag the newest ``share`` of the training weeks."""
    days = train.agg(
        F.min(F.unix_date("week")).alias("first"), F.max(F.unix_date("week")).alias("last")
    ).select(F.col("last") - (F.col("last") - F.col("first")) * F.lit(share))
    return train.withColumn("is_validation", F.unix_date("week") > days.scalar())


def boosted(settings: BoostedTrees, label: str, iterations: int | None = None) -> GBTClassifier:
    return GBTClassifier(
        labelCol=label,
        featuresCol="features",
        weightCol="weight",
        maxIter=iterations or settings.iterations,
        maxDepth=settings.depth,
        stepSize=settings.rate,
        minInstancesPerNode=settings.min_rows,
        seed=SEED,
    )


def fit_best(rows: DataFrame, label: str, features: list[str], settings: BoostedTrees) -> PipelineModel:
    """Boosted trees up to the round with the smallest loss on the rows marked ``is_validation``.

    Rounds are fitted until ``patience`` of them follow the best one, twice as many at each
    attempt. The best round is then cut out of the fitted ensemble and not fitted again.
    """
    learn, check = rows.where("NOT is_validation"), rows.where("is_validation")
    if check.isEmpty():
        return Pipeline(stages=[assembler(features), boosted(settings, label)]).fit(rows)
    n = min(settings.iterations, 2 * settings.patience)
    while True:
        model = Pipeline(stages=[assembler(features), boosted(settings, label, n)]).fit(learn)
        best, _, enough = best_round(model, check, settings)
        if enough:
            return truncated(model, best)
        n = min(settings.iterations, 2 * n)


def best_round(model: PipelineModel, check: DataFrame, settings: BoostedTrees) -> tuple[int, float, bool]:
    """Round with the smallest loss, that loss, and whether the settings allow no round that could be better."""
    return best_of(validation_losses(model, check), settings)


def best_of(losses: list[float], settings: BoostedTrees) -> tuple[int, float, bool]:
    """The same of the losses after each round."""
    best = losses.index(min(losses)) + 1
    return best, losses[best - 1], len(losses) >= settings.iterations or best + settings.patience <= len(losses)


def truncated(model: PipelineModel, rounds: int) -> PipelineModel:
    """The model of the first ``rounds`` rounds.

    Boosting without sampling repeats its first rounds exactly, so this is the model that a fit of
    so many rounds would give.
    """
    trees = model.stages[-1]
    if rounds >= trees.getNumTrees:
        return model
    java, context = trees._java_obj, SparkContext.getOrCreate()
    jvm, gateway = context._jvm, context._gateway
    kept = gateway.new_array(jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, rounds)
    weights = gateway.new_array(jvm.double, rounds)
    whole, of_whole = java.trees(), java.treeWeights()
    for number in range(rounds):
        kept[number], weights[number] = whole[number], of_whole[number]
    cut = jvm.org.apache.spark.ml.classification.GBTClassificationModel(java.uid(), kept, weights, java.numFeatures(), java.numClasses())
    for name in ("labelCol", "featuresCol", "weightCol"):
        cut.set(cut.getParam(name), trees.getOrDefault(name))
    return PipelineModel([*model.stages[:-1], GBTClassificationModel(cut)])


def validation_losses(model: PipelineModel, check: DataFrame) -> list[float]:
    """Loss after each round."""
    return list(model.stages[-1].evaluateEachIteration(PipelineModel(model.stages[:-1]).transform(check)))


def forest(label: str, trees: int = 100, depth: int = 5) -> RandomForestClassifier:
    return RandomForestClassifier(
        labelCol=label, featuresCol="features", weightCol="weight", numTrees=trees, maxDepth=depth, seed=SEED
    )


def prepared(train: DataFrame, label: str, features: list[str], settings: BoostedTrees | None) -> DataFrame:
    """Weighted training rows: the weeks of one ticker from a stored panel."""
    rows = train.select("week", label, *features)
    if settings is not None and settings.patience_share:
        rows = mark_validation(rows, settings.patience_share)
    return with_class_weight(rows, label)


def fit(train: DataFrame, label: str, features: list[str], settings: BoostedTrees | None, **forest_settings) -> PipelineModel:
    """Fit boosted trees, or a random forest where ``settings`` is None.

    ``train`` should come from a stored panel: fitting reads it several times. Boosting
    cuts its lineage with checkpoints in the shared folder.
    """
    ensure_checkpoints(train.sparkSession)
    rows = prepared(train, label, features, settings)
    if settings is not None and settings.patience_share:
        return fit_best(rows, label, features, settings)
    learner = boosted(settings, label) if settings is not None else forest(label, **forest_settings)
    return Pipeline(stages=[assembler(features), learner]).fit(rows)


def direction_settings(ticker: str, forests: list[str] = FOREST_TICKERS) -> BoostedTrees | None:
    """Model family of an asset: forests for some, boosted trees for the others."""
    return None if ticker in forests else DIRECTION_TREES


def fit_crisis(panel: DataFrame, ticker: str, settings: BoostedTrees = CRISIS_TREES, split: str = CRISIS_SPLIT) -> Bundle:
    """Crisis model of one ticker from the complete panel."""
    train, _ = split_at(panel.where(F.col("ticker") == ticker), split)
    features = crisis_features(panel.columns)
    model = fit(train, "crisis_level", features, settings)
    return Bundle(model, ticker, "crisis_level", features, CRISIS_CLASSES)


def fit_direction(
    panel: DataFrame,
    ticker: str,
    settings: BoostedTrees | None = DIRECTION_TREES,
    split: str = DIRECTION_SPLIT,
) -> Bundle:
    """Direction model of one ticker; ``settings=None`` fits the forest used for some assets."""
    train, _ = split_at(panel.where(F.col("ticker") == ticker), split)
    model = fit(train, "target_direction", DIRECTION_FEATURES, settings)
    return Bundle(model, ticker, "target_direction", DIRECTION_FEATURES, DIRECTION_NAMES)


def fit_each(tickers: list[str], fit_one: Callable[[str], Bundle], parallelism: int = 4) -> list[Bundle]:
    """Fit several tickers at a time, so the jobs of one fill the gaps of another."""
    with ThreadPoolExecutor(parallelism) as pool:
        return list(pool.map(fit_one, tickers))


def save_bundle(spark: SparkSession, bundle: Bundle, path: str) -> None:
    bundle.model.write().overwrite().save(f"{path}/model")
    meta = {
        "ticker": bundle.ticker,
        "target": bundle.target,
        "features": list(bundle.features),
        "classes": {str(number): name for number, name in bundle.classes.items()},
    }
    row = spark.range(1).select(F.lit(json.dumps(meta, ensure_ascii=False)).alias("value"))
    row.write.mode("overwrite").text(f"{path}/metadata")


def load_bundle(spark: SparkSession, path: str) -> Bundle:
    meta = json.loads(spark.read.text(f"{path}/metadata").first()["value"])
    classes = {int(k): v for k, v in meta["classes"].items()}
    return Bundle(PipelineModel.load(f"{path}/model"), meta["ticker"], meta["target"], meta["features"], classes)


def importances(spark: SparkSession, bundle: Bundle, rows: int) -> DataFrame:
    """Features by importance; there are at most as many rows as features."""
    values = bundle.model.stages[-1].featureImportances.toArray()
    table = spark.createDataFrame(
        [(bundle.ticker, name, float(value)) for name, value in zip(bundle.features, values)],
        "ticker string, feature string, importance double",
    )
    return table.orderBy(F.col("importance").desc(), "feature").limit(rows)
