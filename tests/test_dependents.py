import datetime as dt

from pyspark.sql import functions as F

from panelweave import operators as op

MALE = ["son", "father"]
CHILD = ["son", "daughter"]
DEPS = [
    ("daughter", 2012),
    ("son", 2006),
    ("daughter", 2005),
    ("son", 2020),
    ("mother", 1963),
    ("mother-in-law", 1962),
    ("father", 1958),
    ("father", 1957),
    ("son", None),
]
NAMES = ["retired", "children_6", "children_12", "children_6_female", "children_12_female"]


def test_counts_by_age_kind_and_sex(spark):
    month = dt.date(2018, 3, 1)
    snap = spark.createDataFrame(
        [(1, month, "f"), (2, month, "f"), (3, month, "m"), (1, dt.date(2019, 1, 1), "f")],
        "entity int, month date, sex string",
    )
    deps = spark.createDataFrame(
        [(e, k, b) for e in (1, 3) for k, b in DEPS], "entity int, kind string, birth int"
    )
    rules = op.standard_rules(MALE, CHILD, F.col("sex") == "f")
    df = op.dependent_counts(snap, deps, "entity", "month", "kind", "birth", rules)
    got = {(r["entity"], r["month"].year): tuple(r[n] for n in NAMES) for r in df.collect()}
    assert got == {
        (1, 2018): (2, 2, 3, 2, 3),
        (1, 2019): (4, 1, 2, 1, 2),
        (2, 2018): (None,) * 5,
        (3, 2018): (2, 2, 3, None, None),
    }


def test_lower_age_bound_and_weights(spark):
    snap = spark.createDataFrame([(1, dt.date(2018, 1, 1))], "entity int, month date")
    deps = spark.createDataFrame(
        [(1, "son", 2012, 4), (1, "son", 2020, 9)], "entity int, kind string, birth int, n int"
    )
    rules = op.standard_rules(MALE, CHILD, F.lit(True), min_age=0)
    df = op.dependent_counts(snap, deps, "entity", "month", "kind", "birth", rules, "n")
    assert df.first()["children_6"] == 4
    assert op.dependent_totals(deps, "entity", "n").first()["n_dependents"] == 13
