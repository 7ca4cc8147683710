"""Model jobs: fitted on the panel, scored, stored and reported."""

import pytest
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from weektide.catalog import queries as Q
from weektide.catalog import supplied
from weektide.constants import DIRECTION_FEATURES
from weektide.models import metrics as M
from weektide.models import score as SC
from weektide.models import search as SE
from weektide.models import train as TR
from weektide.models.features import aligned, class_weights, crisis_features
from weektide.operators.panel import split_at
from weektide.plans.reports import crisis_report
from weektide.plans.evaluate import evaluate_crisis
from weektide.sources.tables import stored

TINY = TR.BoostedTrees(iterations=3, depth=2, rate=0.1)


@pytest.fixture(scope="module")
def direction(spark, medium):
    return Q._direction(spark, medium)


@pytest.fixture(scope="module")
def crisis(spark, medium):
    return stored(Q._panel(spark, medium), "panel")


def test_crisis_features_are_complete(crisis):
    assert len(crisis_features(crisis.columns)) == 91


def test_alignment(spark):
    df = spark.createDataFrame([(1, None, 2.0)], "a int, b double, c double")
    assert tuple(aligned(df, ["c", "b", "x", "a"]).first()) == (2.0, 0.0, 0.0, 1.0)


def test_class_weights(spark):
    df = spark.createDataFrame([(0,)] * 6 + [(1,)] * 2, "y int")
    assert {r["y"]: r["weight"] for r in class_weights(df, "y").collect()} == {0: 1.0, 1: 3.0}


def test_validation_rows_are_the_newest_training_weeks(direction):
    marked = TR.mark_validation(direction, 0.2)
    flags = marked.groupBy("is_validation").agg(F.min("week").alias("first"), F.max("week").alias("last")).collect()
    by_flag = {r["is_validation"]: r for r in flags}
    assert by_flag[False]["last"] < by_flag[True]["first"]


def test_crisis_model_scores_and_reports(spark, crisis, medium, tmp_path):
    bundle = TR.fit_crisis(crisis, supplied.TICKERS[0], TINY, Q.SPLIT)
    _, test = split_at(crisis.where(F.col("ticker") == bundle.ticker), Q.SPLIT)
    scored = SC.score(test, bundle, ["ticker", "week", "crisis_level"], 0.55)
    for row in scored.collect():
        assert row["proba_0"] + row["proba_1"] == pytest.approx(1.0)
        assert row["predicted"] == int(row["proba_1"] >= 0.55)
        assert row["confidence"] == pytest.approx(100 * (row["proba_1"] if row["predicted"] else row["proba_0"]), abs=0.006)
    path = str(tmp_path / "bundle")
    TR.save_bundle(spark, bundle, path)
    loaded = TR.load_bundle(spark, path)
    assert (loaded.ticker, loaded.features, loaded.classes) == (bundle.ticker, bundle.features, bundle.classes)
    again = SC.score(test, loaded, ["ticker", "week", "crisis_level"], 0.55)
    assert sorted(again.collect()) == sorted(scored.collect())
    ranked = [r["importance"] for r in TR.importances(spark, bundle, 25).collect()]
    assert len(ranked) == 25 and ranked == sorted(ranked, reverse=True)

    report = crisis_report(stored(Q._snapshot(spark, medium), "snapshot"), [bundle]).first()
    assert report["actif"] == bundle.ticker and report["niveau_crise"] in ("NORMAL", "STRESS")
    assert set(report["probabilites"]) == {"normal", "stress"}
    assert len(report["variables_importantes"]) == 18 and len(report["top_events"]) <= 10


def test_published_crisis_settings(crisis):
    bundle = TR.fit_crisis(crisis, supplied.TICKERS[0], split=Q.SPLIT)
    trees = bundle.model.stages[-1]
    assert trees.getNumTrees <= 100 and max(t.depth for t in trees.trees) <= 2
    train, test = split_at(crisis.where(F.col("ticker") == bundle.ticker), Q.SPLIT)
    seen = M.metrics(M.confusion_counts(SC.score(train, bundle, ["crisis_level"]), "crisis_level", "predicted")).first()
    held = M.metrics(M.confusion_counts(SC.score(test, bundle, ["crisis_level"]), "crisis_level", "predicted")).first()
    assert seen["accuracy"] > 0.6 and 0.0 <= held["f1_macro"] <= 1.0


def test_early_stopping_and_forest(direction):
    early = TR.BoostedTrees(iterations=6, depth=2, rate=0.1, patience_share=0.2)
    boosted = TR.fit_direction(direction, supplied.TICKERS[0], early, Q.SPLIT)
    assert 1 <= boosted.model.stages[-1].getNumTrees <= 6
    forest = TR.fit_direction(direction, supplied.TICKERS[0], None, Q.SPLIT)
    assert forest.model.stages[-1].getNumTrees == 100


def test_the_best_round_is_kept(direction):
    settings = TR.BoostedTrees(iterations=12, depth=2, rate=0.3, patience_share=0.3, patience=3)
    train, _ = split_at(direction.where(F.col("ticker") == supplied.TICKERS[1]), Q.SPLIT)
    kept = TR.fit(train, "target_direction", DIRECTION_FEATURES, settings).stages[-1].getNumTrees
    rows = TR.prepared(train, "target_direction", DIRECTION_FEATURES, settings)
    every = Pipeline(stages=[TR.assembler(DIRECTION_FEATURES), TR.boosted(settings, "target_direction")]).fit(rows.where("NOT is_validation"))
    losses = TR.validation_losses(every, rows.where("is_validation"))
    seen = losses[: max(6, kept + 3)]
    assert kept == seen.index(min(seen)) + 1


def test_families_by_asset():
    assert TR.direction_settings("CL=F") is None and TR.direction_settings("GLD") == TR.DIRECTION_TREES


def test_evaluation_is_stored(spark, crisis, tmp_path):
    out = evaluate_crisis(crisis, supplied.TICKERS[:2], str(tmp_path), TINY, Q.SPLIT, 0.5)
    _, test = split_at(crisis, Q.SPLIT)
    assert out["predictions"].count() == test.where(F.col("ticker").isin(supplied.TICKERS[:2])).count()
    stored_rows = spark.read.parquet(str(tmp_path / "metrics")).collect()
    assert {r["ticker"] for r in stored_rows} == set(supplied.TICKERS[:2])
    assert TR.load_bundle(spark, str(tmp_path / "models" / supplied.TICKERS[0])).ticker == supplied.TICKERS[0]
    with pytest.raises(ValueError):
        evaluate_crisis(crisis.limit(0), supplied.TICKERS[:1], str(tmp_path / "none"), TINY, Q.SPLIT)


def test_scenarios_cover_every_asset(spark, direction):
    bundles = [TR.fit_direction(direction, t, TINY, Q.SPLIT) for t in supplied.TICKERS[:2]]
    grid = spark.createDataFrame(
        [(-5.0, 300.0, 10), (0.0, 100.0, 0)], "simulated_tone double, simulated_tension double, simulated_material_conflicts int"
    )
    out = SC.scenario_report(grid, bundles).collect()
    assert len(out) == 4 and {r["actif"] for r in out} == set(supplied.TICKERS[:2])
    for r in out:
        assert r["message_analyse"].startswith(f"{r['tendance']} anticipée pour {r['actif']}")


def test_metrics_on_known_counts(spark):
    pairs = [(0, 0)] * 5 + [(0, 1)] * 1 + [(1, 0)] * 2 + [(1, 1)] * 2
    df = spark.createDataFrame(pairs, "label int, prediction int")
    counts = M.confusion_counts(df)
    got = M.metrics(counts).first()
    assert got["accuracy"] == pytest.approx(0.7)
    assert got["balanced_accuracy"] == pytest.approx((5 / 6 + 2 / 4) / 2)
    assert got["f1_macro"] == pytest.approx((10 / 13 + 4 / 7) / 2)
    report = {r["class"]: r for r in M.per_class_report(counts, {0: "Normal", 1: "Stress"}).collect()}
    assert report["Stress"]["precision"] == pytest.approx(2 / 3) and report["Normal"]["support"] == 6
    assert [tuple(r) for r in M.confusion_matrix(df).orderBy("label").collect()] == [(0, 5, 1), (1, 2, 2)]
    one = M.metrics(M.confusion_counts(df.where("label = 0 AND prediction = 0"))).first()
    assert tuple(one) == (1.0, 1.0, 1.0)


def test_search_is_seeded(direction):
    assert SE.draw(1) == SE.draw(1) and len(SE.draw(1)) == 50
    train, test = split_at(direction.where(F.col("ticker") == supplied.TICKERS[0]), Q.SPLIT)
    out = SE.search(train, test, SE.draw(1, trials=2, iterations=(2, 3), depths=(2, 2), min_rows=(1, 1), patience_share=0.0))
    best = [r["accuracy"] for r in out.collect()]
    assert best == sorted(best, reverse=True)


def test_search_drops_trials_and_keeps_the_best(spark, direction):
    """Few trials over small ranges: budgets grow, the last trial stops by itself, ranks follow accuracy."""
    settings = SE.draw(3, trials=8, iterations=(20, 40), depths=(2, 3), patience=5)
    out = SE.search_each(direction, supplied.TICKERS[:2] + ["ABSENT"], settings, Q.SPLIT, first_rounds=4)
    rows = out.orderBy("ticker", "rank").collect()
    assert [(r["ticker"], r["rank"]) for r in rows] == [(t, k) for t in supplied.TICKERS[:2] for k in range(1, 9)]
    for ticker in supplied.TICKERS[:2]:
        mine = [r for r in rows if r["ticker"] == ticker]
        assert [r["accuracy"] for r in mine] == sorted((r["accuracy"] for r in mine), reverse=True)
        assert sorted(r["trial"] for r in mine) == list(range(8))
        assert {(r["trial"], r["iterations"], r["depth"], r["min_rows"]) for r in mine} == {(n, s.iterations, s.depth, s.min_rows) for n, s in enumerate(settings)}
        tried = sorted(r["tried"] for r in mine)
        assert tried[:7] == [4] * 7 and tried[-1] >= 8
        assert all(1 <= r["rounds"] <= r["tried"] <= r["iterations"] for r in mine)
    assert {r["rank"] for r in SE.best_settings(out).collect()} == {1}


def test_the_end_of_a_trial():
    assert SE.end_of([3.0, 2.0, 2.0, 2.5, 1.0], 3) == 5 and SE.end_of([3.0, 2.0, 2.0, 2.5, 1.0], 2) == 4
    assert SE.end_of([1.0], 2) == 1 and SE.end_of([1.0, 1.0, 1.0], 2) == 3


def test_every_trial_of_a_search_is_fitted_in_whole(direction, monkeypatch):
    """Each has the rounds, loss and accuracy that a single fit of all the rounds it was drawn with gives."""
    patience = 6
    settings = SE.draw(5, trials=4, iterations=(18, 30), depths=(2, 3), patience=patience)
    fitted, make = [], SE.boosted
    monkeypatch.setattr(SE, "boosted", lambda settings, label, n: fitted.append(n) or make(settings, label, n))
    ticker = supplied.TICKERS[0]
    rows = {r["trial"]: r for r in SE.search_each(direction, [ticker], settings, Q.SPLIT).collect()}
    assert sorted(rows) == list(range(4)) and sorted(r["rank"] for r in rows.values()) == list(range(1, 5))
    halves = SE.halves_of(direction.where(F.col("ticker") == ticker), Q.SPLIT, "target_direction", DIRECTION_FEATURES, settings[0], SE.FIT_ROWS)
    for number, setting in enumerate(settings):
        every = Pipeline(stages=[make(setting, "target_direction")]).fit(halves.learn)
        losses = TR.validation_losses(every, halves.check)
        end = next((n for n in range(1, len(losses)) if n - 1 - losses.index(min(losses[:n])) >= patience), len(losses))
        best = losses.index(min(losses[:end])) + 1
        found = rows[number]
        assert (found["tried"], found["rounds"], found["loss"]) == (end, best, losses[best - 1])
        assert found["accuracy"] == SE.accuracy_of(TR.truncated(every, best), halves.test, "target_direction")
        assert found["tried"] == found["iterations"] or found["tried"] == found["rounds"] + patience
    assert min(fitted) == patience + 1 and set(fitted) <= {7, 14, 28, *(s.iterations for s in settings)}


def test_every_training_week_is_fitted(spark):
    """Nothing is left out of a long history, unless a caller asks for fewer rows."""
    rows = spark.range(5010).selectExpr(
        "date_add(DATE'1900-01-01', CAST(7 * id AS INT)) AS week", "CAST(id % 3 = 0 AS INT) AS up", "CAST(id % 7 AS DOUBLE) AS x"
    )
    split = str(rows.orderBy("week").tail(10)[0]["week"])
    setting = TR.BoostedTrees(iterations=2, depth=2, patience_share=0.2, patience=1)
    halves = SE.halves_of(rows, split, "up", ["x"], setting)
    assert (halves.learn.count() + halves.check.count(), halves.test.count()) == (5000, 10)
    few = SE.halves_of(rows, split, "up", ["x"], setting, 100)
    assert few.learn.count() + few.check.count() == 100
    assert SE.search_each.__defaults__[2:] == (None, None)


def test_the_last_trial_is_not_fitted_for_every_number_of_rounds(direction, monkeypatch):
    """What a trial has after 4, 8, 16 and 30 rounds is read off two fits, and is what four fits give."""
    setting = TR.BoostedTrees(iterations=30, depth=2, rate=0.05, patience_share=0.2, patience=5)
    rows = direction.where(F.col("ticker") == supplied.TICKERS[0])
    halves = SE.halves_of(rows, Q.SPLIT, "target_direction", DIRECTION_FEATURES, setting, SE.FIT_ROWS)
    fitted, make = [], SE.boosted
    monkeypatch.setattr(SE, "boosted", lambda settings, label, n: fitted.append(n) or make(settings, label, n))
    last = SE.Trial("", 0, setting, alone=True)
    for rounds in (4, 8, 16, 32):
        SE.fit_further(last, halves, "target_direction", rounds)
        plain = Pipeline(stages=[make(setting, "target_direction", min(rounds, 30))]).fit(halves.learn)
        wanted = TR.best_round(plain, halves.check, setting)
        assert (last.tried, last.rounds, last.loss, last.enough) == (min(rounds, 30), *wanted)
    assert fitted == [8, 30]
    assert last.model.stages[-1].getNumTrees == last.rounds
    wide = [SE.ahead(n, TR.BoostedTrees(iterations=2000, patience=50)) for n in (16, 128, 512)]
    assert wide == [64, 256, 2000]


def test_the_first_rounds_of_a_model_are_a_fit_of_so_many(direction):
    train, test = split_at(direction.where(F.col("ticker") == supplied.TICKERS[0]), Q.SPLIT)
    shape = dict(depth=3, rate=0.1)
    long, short = (TR.fit(train, "target_direction", TR.DIRECTION_FEATURES, TR.BoostedTrees(iterations=n, **shape)) for n in (12, 5))
    cut = TR.truncated(long, 5)
    assert cut.stages[-1].getNumTrees == 5 and TR.truncated(long, 12) is long
    found, wanted = (m.transform(test).select("probability", "prediction").collect() for m in (cut, short))
    assert found == wanted
    assert cut.stages[-1].featureImportances == short.stages[-1].featureImportances


def test_models_are_fitted_again_when_tables_change(spark, small, tmp_path):
    for name in ("lineitem", "orders", "customer", "supplier"):
        spark.read.parquet(f"{small}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    before = supplied.state(spark, str(tmp_path))
    assert supplied.state(spark, str(tmp_path)) == before
    spark.read.parquet(f"{small}/orders.parquet").limit(10).write.mode("append").parquet(f"{tmp_path}/orders.parquet")
    assert supplied.state(spark, str(tmp_path)) != before
