import datetime as dt
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from panelweave import operators as op
from panelweave.models import (
    BoostingParams,
    ForestBaseline,
    HorizonForecaster,
    assemble,
    backtest,
    backtest_f1,
)
from panelweave.models.forecaster import unpivot_scores
from panelweave.plans import forecast_template
from panelweave.sources import shared_dir, staged

H = 2
FEATURES = ["signal", "noise"]


@pytest.fixture(scope="module")
def panel(spark):
    """A flag that repeats every four months, so that the calendar month tells it."""
    months = "sequence(DATE'2016-01-01', DATE'2019-04-01', INTERVAL 1 MONTH)"
    rows = spark.range(200).selectExpr("CAST(id AS INT) AS entity", f"explode({months}) AS month")
    rows = rows.withColumns(
        {
            "idx": F.year("month") * 12 + F.month("month"),
            "flag": ((F.month("month") + F.col("entity")) % 4 == 0).cast("int"),
            "noise": F.when(F.col("entity") % 3 != 0, F.pmod(F.hash("entity", "month"), F.lit(10)).cast("double")),
        }
    ).withColumn("signal", ((F.month("month") + F.col("entity")) % 4).cast("double"))
    return op.horizon_targets(rows, "entity", "idx", "flag", H).cache()


def model(**kw):
    params = BoostingParams(rounds=2, max_depth=2, max_bins=16, min_rows=5, feature_fraction=1.0, learning_rate=0.5)
    return HorizonForecaster(FEATURES, params, horizons=H, **kw)


def test_fit_scores_and_thresholds(panel):
    train = panel.na.drop(subset=op.label_columns(H))
    fitted = model(n_models=2).fit(train)
    assert set(fitted.models) == {(s, h) for s in (0, 1) for h in (1, 2)}
    scores = fitted.predict_proba(panel)
    outside = " OR ".join(f"p_{h} IS NULL OR p_{h} < 0 OR p_{h} > 1" for h in (1, 2))
    assert scores.where(outside).count() == 0 and scores.count() == panel.count()

    # The stored thresholds give the stored F1 on the validation months.
    last = train.agg(F.max("month")).first()[0]
    recent = train.where(F.col("month") > F.add_months(F.lit(last), -3))
    both = scores.join(recent.select("entity", "month", *op.label_columns(H)), ["entity", "month"])
    long = unpivot_scores(both, ["entity", "month"], H, with_labels=True)
    again = op.f1_by(op.apply_thresholds(long, fitted.thresholds), ["horizon"])
    want = {r["horizon"]: r["f1"] for r in fitted.thresholds.collect()}
    got = {r["horizon"]: r["f1"] for r in again.collect()}
    assert got == pytest.approx(want) and min(want.values()) > 0.99


def test_backtest(panel):
    points = [dt.date(2018, 1, 1), dt.date(2017, 7, 1)]
    preds = backtest(panel, points, model, horizons=H)
    per_fold, means = backtest_f1(preds)
    assert per_fold.count() == 4 and means.count() == 2
    assert min(r["f1"] for r in means.collect()) > 0.99
    assert preds.groupBy("fold", "entity", "month", "horizon").count().where("count > 1").count() == 0


def test_forecast_fills_the_template(spark, panel):
    cutoff = dt.date(2019, 3, 1)
    template = spark.createDataFrame(
        [(e, m, 0) for e in (0, 1, 999) for m in (dt.date(2019, 4, 1), dt.date(2019, 5, 1))],
        "entity int, month date, target int",
    )
    filled = forecast_template(panel, template, cutoff, model(), horizons=H)
    got = {(r["entity"], r["month"].month): r["target"] for r in filled.collect()}
    assert got == {(0, 4): 1, (0, 5): 0, (1, 4): 0, (1, 5): 0, (999, 4): None, (999, 5): None}


def test_forest(panel):
    fitted = ForestBaseline(FEATURES, trees=2, max_depth=3, horizons=H).fit(panel)
    predicted = fitted.predict(panel).join(panel.select("entity", "month", "idx", "flag"), ["entity", "month"])
    wrong = predicted.where("y_1 <> CAST((month(month) + 1 + entity) % 4 = 0 AS INT)").count()
    assert wrong == 0


def test_missing_values_can_be_told_from_zero(spark):
    rows = spark.sql("SELECT * FROM VALUES (1, 0.0D, 2), (2, NULL, NULL) AS t(entity, noise, signal)")
    vectors = assemble(rows, FEATURES, ["entity"], flag_missing=["noise"]).orderBy("entity").collect()
    assert [list(r["features"]) for r in vectors] == [[2.0, 0.0, 0.0], [0.0, 0.0, 1.0]]


def test_each_model_names_the_labels_its_rows_need(panel):
    assert model().required_labels == ["y_1", "y_2"]
    forest = ForestBaseline(FEATURES, trees=2, max_depth=3, horizons=H)
    cutoff = dt.date(2019, 4, 1)
    rows = [op.time_split(panel, "month", cutoff, m.required_labels)[0].count() for m in (model(), forest)]
    assert rows[1] - rows[0] == 200  # the month before the cutoff, whose second label is unknown


def test_fits_leave_no_training_rows_behind(spark, panel):
    folder = Path(shared_dir(spark))
    before = set(folder.iterdir())
    model().fit(panel.na.drop(subset=op.label_columns(H)))
    ForestBaseline(FEATURES, trees=2, max_depth=3, horizons=H).fit(panel)
    left = {p.name.split("-")[0] for p in set(folder.iterdir()) - before}
    assert left == {"thresholds"}


def test_a_staged_table_is_removed_when_its_block_fails(spark):
    with pytest.raises(ValueError), staged(spark.range(3), "doomed") as table:
        assert table.count() == 3
        raise ValueError
    assert not list(Path(shared_dir(spark)).glob("doomed-*"))


def test_forest_stages_columns_and_bounds_its_copies(panel, monkeypatch):
    from panelweave.models import forecaster

    written, real = {}, forecaster.staged

    def noted(df, name):
        written[name] = df.columns
        return real(df, name)

    monkeypatch.setattr(forecaster, "staged", noted)
    forest = ForestBaseline(FEATURES, trees=2, max_depth=2, horizons=H)
    forest.fit(panel)
    assert written["training"] == ["entity", "month", "y_1", "y_2", *FEATURES]
    assert forest._at_once(8_000) == 4 and forest._at_once(1 << 30) == 1


def test_the_known_panel_is_made_by_all_cores(spark, sf_dir):
    from panelweave.catalog import queries

    known = queries._known_panel(spark, sf_dir)
    assert known.rdd.getNumPartitions() == 3 * spark.sparkContext.defaultParallelism
