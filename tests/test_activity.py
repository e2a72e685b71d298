import datetime as dt

import pytest
from pyspark.sql import functions as F

from panelweave import operators as op
from panelweave.functions import parse_decimal

D = dt.date


@pytest.fixture(scope="module")
def log(spark):
    rows = [
        (1, D(2018, 2, 5), "shift 1", "7,2", "work"),
        (1, D(2018, 2, 6), "shift 2", None, "work"),
        (1, D(2018, 2, 27), None, None, "sick"),
        (1, D(2018, 2, 28), None, None, "sick"),
        (1, D(2018, 2, 10), None, None, "off"),
        (1, D(2018, 3, 3), None, None, "off"),
        (None, D(2018, 3, 3), "shift 1", "8", "work"),
    ]
    return spark.createDataFrame(rows, "entity int, day date, shift string, hours string, kind string")


SHIFT = ["shift 1", "shift 2"]


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_sparse_measures_leave_months_out(log):
    feb = D(2018, 2, 1)
    assert rows(op.monthly_count(log, "entity", "day", F.col("shift").isin(SHIFT), "n")) == [(1, feb, 2)]
    hours = parse_decimal(F.col("hours"))
    assert rows(op.monthly_sum(log, "entity", "day", F.col("shift").isin(SHIFT), hours, "h")) == [(1, feb, 7.2)]
    sick = F.col("kind") == "sick"
    assert rows(op.monthly_flag(log, "entity", "day", sick, "f")) == [(1, feb, 1)]
    assert rows(op.last_day_count(log, "entity", "day", sick, "n")) == [(1, feb, 1)]


def test_all_missing_sum_is_zero(log):
    only = F.col("shift") == "shift 2"
    hours = parse_decimal(F.col("hours"))
    assert rows(op.monthly_sum(log, "entity", "day", only, hours, "h"))[0][2] == 0.0


def test_category_counts_are_dense(log):
    got = op.category_counts(log, "entity", "day", "kind", ["off", "sick", "work"], "days")
    assert got.columns == ["entity", "month", "days_off", "days_sick", "days_work"]
    assert rows(got) == [(1, D(2018, 2, 1), 1, 2, 2), (1, D(2018, 3, 1), 1, 0, 0)]
