import pytest

from panelweave import operators as op


def jobs_of(spark, build):
    spark.sparkContext.setJobGroup("lazy", "building only")
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup("lazy"))
    frame = build()
    after = len(spark.sparkContext.statusTracker().getJobIdsForGroup("lazy"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return frame, after - before


def test_building_operators_starts_no_job(spark):
    rows = spark.range(60).selectExpr(
        "id % 5 AS entity", "add_months(DATE '2020-01-01', CAST(id / 5 AS INT)) AS month", "CAST(id % 2 AS INT) AS flag",
        "CAST(id % 3 AS STRING) AS grp", "id / 60.0D AS score", "1 AS horizon",
    )
    calendar = spark.range(1, 13).selectExpr("CAST(id AS INT) AS m", "id * 2 AS warm")
    thresholds = spark.range(1).selectExpr("1 AS horizon", "0.5D AS threshold")
    for build in (
        lambda: op.calendar_join(rows, "month", calendar, "m"),
        lambda: op.apply_thresholds(rows, thresholds),
        lambda: op.peer_stats(rows, "entity", "month", "grp", "flag"),
        lambda: op.stratified_split(rows, "flag", ["entity", "month"]),
        lambda: op.history_block(rows, "entity", "month", ["flag"]),
    ):
        frame, jobs = jobs_of(spark, build)
        assert jobs == 0 and frame.count() == 60


def test_a_month_that_occurs_twice_fails(spark):
    rows = spark.sql("SELECT DATE '2020-01-01' AS month")
    twice = spark.createDataFrame([(1, 2.0), (1, 3.0)], "m int, warm double")
    with pytest.raises(Exception, match="month occurs twice"):
        op.calendar_join(rows, "month", twice, "m").collect()


def test_five_thousand_levels(spark):
    levels = spark.range(5_000).selectExpr("CAST(id AS STRING) AS kind")
    known = op.discover_levels(levels, ["kind"])["kind"]
    assert len(known) == 5_000
    with pytest.raises(ValueError, match="over 10 values"):
        op.discover_levels(levels, ["kind"], 10)
    wide = op.one_hot(levels.limit(3), {"kind": known})
    assert len(wide.columns) == 5_000
