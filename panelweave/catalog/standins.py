"""The engine's input tables, derived from the star-schema test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.functions import month_index, month_start
from panelweave.operators import flag_of, monthly_log
from panelweave.plans import DependentSpec, LogSpec, PanelLevels, PanelSpec, SnapshotSpec

SHIFT_VALUES = ["1-URGENT", "2-HIGH", "3-MEDIUM"]
STATUSES = ["F", "O", "P"]
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
MALE_SEGMENTS = ["BUILDING", "MACHINERY"]
EDUCATION = ({"higher": ["BUILDING", "MACHINERY"], "middle": ["FURNITURE"]}, "basic")
YEARS = list(range(1995, 2002))

SPEC = PanelSpec(
    log=LogSpec(
        entity="entity",
        day="day",
        shift_kind="shift_kind",
        shift_values=SHIFT_VALUES,
        hours="hours",
        category="category",
        flag_values=["F"],
        code="category",
        code_values=["F"],
    ),
    dependents=DependentSpec(
        entity="entity",
        kind="kind",
        birth="birth",
        male_kinds=["R"],
        child_kinds=["R", "A"],
        count="n",
    ),
    snapshot=SnapshotSpec(
        entity="entity",
        month="month",
        flag="own_flag",
        birth_year="birth_year",
        gender="gender",
        male_values=MALE_SEGMENTS,
        experience="experience",
        peer_groups=("post_group", "fact_group"),
        unit="unit",
        raw=("balance",),
        categories=("segment", "education"),
        recodes={"education": EDUCATION},
    ),
    calendar_key="calendar_month",
)
LEVELS = PanelLevels(
    snapshot={"segment": SEGMENTS, "education": ["basic", "higher", "middle"]},
    log=STATUSES,
    years=YEARS,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a daily log; hours are decimal-comma text and missing for open orders."""
    hours = F.floor(F.col("o_totalprice") / 1000) + F.lit(0.5)
    text = F.replace(hours.cast("double").cast("string"), F.lit("."), F.lit(","))
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("event"),
        F.col("o_custkey").alias("entity"),
        F.col("o_orderdate").cast("date").alias("day"),
        F.col("o_orderpriority").alias("shift_kind"),
        F.col("o_orderstatus").alias("category"),
        F.when(F.col("o_orderstatus") != "O", text).alias("hours"),
    )


def spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every month between a customer's first and last order."""
    month = month_start(F.col("o_orderdate"))
    return (
        table(spark, sf_dir, "orders")
        .where(F.col("o_custkey").isNotNull() & month.isNotNull())
        .groupBy(F.col("o_custkey").alias("entity"))
        .agg(F.min(month).alias("first"), F.max(month).alias("last"))
        .select(
            "entity",
            F.explode(F.sequence("first", "last", F.expr("interval 1 month"))).alias("month"),
        )
    )


def flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spine with the log's flag, 0 where the month has none."""
    measured = monthly_log(
        event_log(spark, sf_dir), "entity", "day", [flag_of(F.col("category") == "F", "flag")]
    )
    return (
        spine(spark, sf_dir)
        .join(measured, ["entity", "month"], "left")
        .select(
            "entity",
            "month",
            month_index(F.col("month")).alias("month_idx"),
            F.coalesce("flag", F.lit(0)).alias("flag"),
        )
    )


def snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per customer and month. Its own flag is missing in months without orders."""
    own = monthly_log(
        event_log(spark, sf_dir),
        "entity",
        "day",
        [F.max((F.col("category") == "F").cast("int")).alias("own_flag")],
    )
    segment, nation = F.col("c_mktsegment"), F.col("c_nationkey")
    customer = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("entity"),
        segment.alias("segment"),
        segment.alias("gender"),
        segment.alias("education"),
        F.when(segment != "HOUSEHOLD", segment).alias("post_group"),
        nation.alias("fact_group"),
        F.when(nation != 0, nation).alias("unit"),
        (1940 + 2 * nation).cast("int").alias("birth_year"),
        F.col("c_acctbal").alias("balance"),
        F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal") / 1000).alias("experience"),
    )
    return spine(spark, sf_dir).join(customer, "entity").join(own, ["entity", "month"], "left")


def dependents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as dependents of the customer; equal ones are counted in ``n``.

    Lines are counted per order before they meet the orders, so an order with very many
    lines is a few rows in the join.
    """
    birth = F.year("l_shipdate") - 10 * (F.col("l_linenumber") - 1)
    lines = (
        table(spark, sf_dir, "lineitem")
        .groupBy(
            F.col("l_orderkey").alias("o_orderkey"),
            F.col("l_returnflag").alias("kind"),
            birth.cast("int").alias("birth"),
        )
        .agg(F.count(F.lit(1)).alias("n"))
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("entity"))
    return lines.join(orders, "o_orderkey").select("entity", "kind", "birth", "n")


def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve rows of monthly averages."""
    return (
        table(spark, sf_dir, "lineitem")
        .where(F.col("l_shipdate").isNotNull())
        .groupBy(F.month("l_shipdate").alias("calendar_month"))
        .agg(
            F.avg("l_quantity").alias("mean_quantity"),
            F.max("l_discount").alias("max_discount"),
            F.count(F.lit(1)).alias("line_count"),
        )
    )


def line_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores with many ties: horizon from the line number, label from the return flag."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_linenumber").alias("horizon"),
        F.year("l_shipdate").alias("fold"),
        (F.col("l_returnflag") == "R").cast("int").alias("label"),
        (F.col("l_quantity") / 50).alias("score"),
    )


def wide_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve 0/1 columns per customer: the flags of the last twelve months of the data."""
    last = F.lit("2000-09-01").cast("date")
    ahead = F.col("month_idx") - month_index(last) + 1
    rows = flags(spark, sf_dir)
    return rows.groupBy("entity").agg(
        *[F.coalesce(F.max(F.when(ahead == h, F.col("flag"))), F.lit(0)).alias(f"y_{h}") for h in range(1, 13)]
    )


def template(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table to fill: every customer for fifteen months from the origin, target unknown."""
    start = F.lit("2000-09-01").cast("date")
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("entity"),
        F.explode(
            F.sequence(start, F.add_months(start, 14), F.expr("interval 1 month"))
        ).alias("date"),
        F.lit(0).alias("target"),
    )
