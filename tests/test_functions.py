import datetime as dt

import pytest
from pyspark.sql import functions as F

from panelweave.functions import (
    age_at,
    is_month_end,
    latin,
    month_index,
    month_start,
    parse_decimal,
    recode,
    safe_names,
    threshold_bins,
)


def values(df):
    return [tuple(r) for r in df.collect()]


def test_parse_decimal(spark):
    df = spark.createDataFrame([("7,2",), ("8",), ("nan",), ("",), (None,), ("x",)], "t string")
    got = [r[0] for r in df.select(parse_decimal(F.col("t"))).collect()]
    assert got == [7.2, 8.0, None, None, None, None]


def test_month_functions(spark):
    df = spark.createDataFrame([("2018-02-28",), ("2020-02-28",)], "d string")
    got = values(
        df.select(month_start(F.col("d")), month_index(F.col("d")), is_month_end(F.col("d")))
    )
    assert got == [
        (dt.date(2018, 2, 1), 2018 * 12 + 2, True),
        (dt.date(2020, 2, 1), 2020 * 12 + 2, False),
    ]


def test_age_may_be_negative(spark):
    df = spark.createDataFrame([(dt.date(2018, 5, 1), 2020)], "m date, b int")
    assert df.select(age_at(F.col("m"), F.col("b"))).first()[0] == -2


def test_threshold_bins(spark):
    df = spark.createDataFrame([(0.5,), (0.51,), (5.0,), (5.01,), (8.0,), (8.01,), (None,)], "x double")
    got = values(df.select(*threshold_bins(F.col("x"), [0.5, 5, 8], "s")))
    assert [[i for i, b in enumerate(row) if b] for row in got] == [[0], [1], [1], [2], [2], [3], []]


def test_recode_sends_missing_to_default(spark):
    df = spark.createDataFrame([("a",), ("b",), ("z",), (None,)], "x string")
    got = [r[0] for r in df.select(recode(F.col("x"), {"one": ["a"], "two": ["b"]}, "rest")).collect()]
    assert got == ["one", "two", "rest", "rest"]


def test_latin_names(spark):
    assert latin("Больничный") == "Bolnichnyj"
    assert latin("Темп Средняя") == "Temp_Srednjaja"
    assert latin("жидкие осадки") == "zhidkie_osadki"
    df = spark.createDataFrame([(1, 2)], "`Дождь` int, `рост ёлок` int")
    assert safe_names(df).columns == ["Dozhd", "rost_elok"]
    with pytest.raises(ValueError):
        safe_names(spark.createDataFrame([(1, 2)], "`мел` int, `мель` int"))
