import pytest
from pyspark.sql import functions as F

from panelweave import operators as op

ROWS = [
    (1, 1, "a", 1, 0),
    (2, 1, "a", 0, 1),
    (3, 1, "a", None, 3),
    (4, 1, "b", None, None),
    (5, 1, None, 1, 2),
    (1, 2, "a", 1, 0),
]


@pytest.fixture(scope="module")
def snap(spark):
    return spark.createDataFrame(ROWS, "entity int, month int, grp string, flag int, n_dep int")


def by_row(df, *cols):
    return {(r["entity"], r["month"]): tuple(r[c] for c in cols) for r in df.collect()}


def test_peer_stats(snap):
    df = op.peer_stats(snap, "entity", "month", "grp", "flag")
    got = by_row(df, "grp_people_count", "grp_flag_count", "grp_flag_avg")
    assert got == {
        (1, 1): (3, 1, 0.5),
        (2, 1): (3, 1, 0.5),
        (3, 1): (3, 1, 0.5),
        (4, 1): (1, 0, None),
        (5, 1): (None, None, None),
        (1, 2): (1, 1, 1.0),
    }


def test_one_group_owns_most_rows(spark):
    rows = spark.range(20_000).selectExpr(
        "id AS entity", "1 AS month", "IF(id % 10 = 0, CAST(id % 50 AS STRING), IF(id % 10 = 1, NULL, 'hot')) AS grp",
        "CAST(id % 2 AS INT) AS flag",
    )
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "1KB")
    try:
        got = op.peer_stats(rows, "entity", "month", "grp", "flag").groupBy("grp").agg(
            F.min("grp_people_count"), F.max("grp_people_count"), F.max("grp_flag_count"), F.count(F.lit(1))
        )
        found = {r[0]: tuple(r)[1:] for r in got.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes")
    assert found["hot"] == (16_000, 16_000, 8_000, 16_000) and found[None] == (None, None, None, 2_000)
    assert found["0"] == (400, 400, 0, 400)


def test_group_size_weighs_dependents(snap):
    fan = by_row(op.group_size(snap, "entity", "month", "grp", "n_dep", "size"), "size")
    assert fan[1, 1] == (5,) and fan[4, 1] == (1,) and fan[5, 1] == (None,)
    heads = by_row(op.group_size(snap, "entity", "month", "grp"), "group_size")
    assert heads[1, 1] == (3,)


def test_rows_without_partner_are_salted_in_the_shuffle(spark, snap):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = op.peer_stats(snap, "entity", "month", "grp", "flag")
        text = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    joins = [line for line in text.split("\n") if "SortMergeJoin" in line]
    assert len(joins) == 1 and "_salt" in joins[0]
    exchanges = [line for line in text.split("\n") if "Exchange hashpartitioning" in line]
    assert sum("_salt" in line for line in exchanges) == 2
    assert "Window" not in text
