import math
import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelweave import operators as op
from panelweave.operators.history import PERIODS, _growth


@pytest.fixture(scope="module")
def short(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 2, 2), (1, 4, 0), (1, 5, 1)], "k int, m int, v int")


@pytest.fixture(scope="module")
def noisy(spark):
    rng = random.Random(7)
    rows = [
        (k, m, None if rng.random() < 0.2 else round(rng.random() * 50, 2), rng.random() < 0.6)
        for k in range(20)
        for m in range(60)
        if rng.random() < 0.8
    ]
    return spark.createDataFrame(rows, "k int, m int, v double, present boolean").cache()


def ordered(df, *cols):
    return [tuple(r) for r in df.orderBy("k", "m").select(*cols).collect()]


def close(a, b):
    return (a is None and b is None) or (a is not None and b is not None and math.isclose(a, b, abs_tol=1e-9))


def test_fixture_of_three_rows(short):
    got = ordered(
        op.history_block(short, "k", "m", ["v"]),
        *[f"v_rolling_{s}_3" for s in ("mean", "std", "max", "min")],
        "v_cummean",
        "v_cummax",
        "trend_v_1_3",
    )
    want = [
        (0, None, 0, 0, 0, 0, None),
        (1, 1.414214, 2, 0, 1, 2, 2),
        (0.666667, 1.154701, 2, 0, 0.666667, 2, 0),
        (1, 1, 2, 0, 0.75, 2, 1),
    ]
    rounded = [tuple(None if x is None else round(x, 6) for x in row) for row in got]
    assert rounded == want


def test_block_has_forty_columns(short):
    assert len(op.history_block(short, "k", "m", ["v"]).columns) == len(short.columns) + 40


@pytest.mark.parametrize("periods", [PERIODS, (5,), (1,), (4, 7, 10, 31)])
def test_growth_reaches_every_period(periods):
    ready = {1: 0}
    for i, joins in enumerate(_growth(periods), start=1):
        for near, far in joins:
            assert ready[far] < i and near in ready
            ready[near + far] = i
    assert set(periods) <= set(ready)


@pytest.mark.parametrize("periods", [PERIODS, (4, 7, 10)])
def test_rolling_equals_sliding_aggregates(noisy, periods):
    w = W.partitionBy("k").orderBy("m")
    calls = {"mean": F.avg, "std": F.stddev_samp, "max": F.max, "min": F.min}
    names = [f"v_rolling_{s}_{p}" for p in periods for s in calls]
    got = ordered(op.rolling_stats(noisy, "k", "m", "v", periods), *names)
    frames = [
        f("v").over(w.rowsBetween(1 - p, 0)).alias(f"v_rolling_{s}_{p}")
        for p in periods
        for s, f in calls.items()
    ]
    want = ordered(noisy.select("k", "m", *frames), *names)
    assert len(got) == len(want) > 0
    assert all(close(a, b) for g, t in zip(got, want) for a, b in zip(g, t))


def test_equal_values_deviate_by_zero(spark):
    df = spark.createDataFrame([(1, m, 0.1) for m in range(30)], "k int, m int, v double")
    got = ordered(op.rolling_stats(df, "k", "m", "v", [24]), "v_rolling_std_24")
    assert [r[0] for r in got[1:]] == [0.0] * 29


def test_sparse_history_skips_absent_rows(noisy):
    got = op.sparse_history(noisy, "k", "m", F.col("present"), "v")
    only = op.history_block(noisy.where("present"), "k", "m", ["v"])
    names = [c for c in only.columns if c not in noisy.columns]
    kept = ordered(got.where("present"), *names)
    assert kept == ordered(only, *names)
    absent = got.where("NOT present")
    assert absent.where(" OR ".join(f"`{c}` IS NOT NULL" for c in names)).count() == 0


def test_zero_streak(spark):
    values = [0, 0, 1, 0, None, 0, 0, 0]
    df = spark.createDataFrame([(1, m, v) for m, v in enumerate(values)], "k int, m int, v int")
    got = ordered(op.zero_streak(df, "k", "m", "v"), "zero_streak")
    assert [r[0] for r in got] == [0, 1, 0, 0, 0, 0, 1, 2]


def test_targets_are_calendar_exact(short):
    got = ordered(op.horizon_targets(short, "k", "m", "v", 3), "y_1", "y_2", "y_3")
    assert got == [(2, None, 0), (None, 0, 1), (1, None, None), (None, None, None)]


def test_repeated_month_fails(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (1, 2)], "k int, m int").withColumn("d", F.col("m"))
    with pytest.raises(Exception, match="occurs twice"):
        op.unique_months(df, "k", "m", "d").collect()
    assert op.unique_months(df.distinct(), "k", "m", "d").count() == 2


def test_one_sort_and_no_python(short):
    plan = op.history_block(short.repartition("k"), "k", "m", ["v"])
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("Sort [") == 1
    assert "Python" not in text


def test_sparse_and_whole_histories_share_a_sort(noisy):
    rows = noisy.repartition("k").select("k", "m", "v", "present", F.col("v").alias("w"), F.col("v").alias("x"))
    block = op.history_block(rows, "k", "m", ["v"], F.col("present"))
    block = op.history_block(block, "k", "m", ["w"], F.col("v").isNotNull())
    block = op.history_block(block.where("m > 3"), "k", "m", ["x"])
    text = block._jdf.queryExecution().executedPlan().toString()
    assert text.count("Sort [") == 1


def test_sparse_history_steps_over_missing_parts(spark):
    """A present row with a missing value counts as a row; an absent row does not."""
    values = [(5.0, True), (None, True), (9.0, False), (1.0, True), (None, False), (3.0, True)]
    df = spark.createDataFrame([(1, m, *v) for m, v in enumerate(values)], "k int, m int, v double, p boolean")
    got = ordered(op.sparse_history(df, "k", "m", F.col("p"), "v"), "v_rolling_mean_3", "v_cummean", "v_cummax")
    assert got[:4] == [(5.0, 5.0, 5.0), (5.0, None, None), (None, None, None), (3.0, 2.0, 5.0)]
    assert got[4] == (None, None, None) and got[5][0] == 2.0 and close(got[5][1], 9.0 / 4)
