import random

import pytest

from panelweave import operators as op
from panelweave.models import ensemble_scores


def brute_best(pairs):
    best = None
    positives = sum(label for label, _ in pairs)
    for t in sorted({s for _, s in pairs}):
        tp = sum(label for label, s in pairs if s >= t)
        f1 = 2 * tp / (sum(s >= t for _, s in pairs) + positives) if tp else -1
        if tp and (best is None or f1 > best[1]):
            best = (t, f1)
    return best


def test_fixture(spark):
    rows = [(1, 0.9), (0, 0.8), (1, 0.8), (1, 0.4), (0, 0.3), (0, 0.1)]
    df = spark.createDataFrame([(1, *r) for r in rows], "horizon int, label int, score double")
    curve = {r["score"]: round(r["f1"], 6) for r in op.threshold_curve(df, "horizon", "label", "score").collect()}
    assert curve == {0.9: 0.5, 0.8: 0.666667, 0.4: 0.857143, 0.3: 0.75, 0.1: 0.666667}
    best = op.best_f1_threshold(df).first()
    assert best["threshold"] == 0.4
    hits = op.apply_thresholds(df, op.best_f1_threshold(df))
    assert sorted((r["score"], r["prediction"]) for r in hits.collect()) == [
        (0.1, 0), (0.3, 0), (0.4, 1), (0.8, 1), (0.8, 1), (0.9, 1),
    ]


@pytest.mark.parametrize("bins", [1, 2, 7, 1024])
def test_any_number_of_ranges_gives_the_brute_force_result(spark, bins):
    rng = random.Random(bins)
    rows = [(h, int(rng.random() < 0.3), round(rng.random() ** 3, 2)) for h in (1, 2, 3) for _ in range(300)]
    rows += [(2, 1, 0.5)] * 400 + [(4, 0, 0.1), (5, None, 0.4), (5, 1, None)]
    df = spark.createDataFrame(rows, "horizon int, label int, score double")
    got = {r["horizon"]: (r["threshold"], r["f1"]) for r in op.best_f1_threshold(df, bins=bins).collect()}
    want = {h: brute_best([(l, s) for hh, l, s in rows if hh == h]) for h in (1, 2, 3)}
    assert got == want


def test_f1(spark):
    rows = [(1, 1, 1), (1, 0, 1), (1, 1, 0), (2, 0, 0)]
    df = spark.createDataFrame(rows, "horizon int, label int, prediction int").selectExpr("*", "1 AS fold")
    got = {r["horizon"]: (r["tp"], r["fp"], r["fn"], r["f1"]) for r in op.f1_by(df).collect()}
    assert got == {1: (1, 1, 1, 0.5), 2: (0, 0, 0, 0.0)}
    assert {r["horizon"]: r["f1"] for r in op.mean_f1(op.f1_by(df)).collect()} == {1: 0.5, 2: 0.0}


def test_ensemble_mean(spark):
    df = spark.createDataFrame([(1, 1, 0.2), (1, 1, 0.4), (2, 1, 0.9)], "entity int, horizon int, score double")
    got = {r["entity"]: round(r["score"], 9) for r in ensemble_scores(df, ["entity", "horizon"]).collect()}
    assert got == {1: 0.3, 2: 0.9}


def test_no_scores_no_threshold(spark):
    df = spark.createDataFrame([], "horizon int, label int, score double")
    assert op.best_f1_threshold(df).collect() == []
