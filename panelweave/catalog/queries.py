"""One query per operator over the test tables. Doubles are rounded for comparison only."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType

from panelweave import operators as op
from panelweave.catalog import standins as st
from panelweave.functions import (
    age_at,
    is_month_end,
    month_index,
    month_start,
    parse_decimal,
    recode,
    safe_names,
    threshold_bins,
)
from panelweave.models import (
    Booster,
    BoostingParams,
    ForestBaseline,
    HorizonForecaster,
    backtest,
    backtest_f1,
    encoded,
    ensemble_mean,
    ensemble_scores,
    fit_bins,
    fit_boosters,
    training_table,
)
from panelweave.plans import build_panel, feature_columns, forecast_template
from panelweave.sources import read_delimited, stage, staging_path, write_delimited

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

CUTOFF = dt.date(2000, 8, 1)
POINTS = [dt.date(1999, 8, 1), dt.date(1999, 7, 1), dt.date(1998, 9, 1), dt.date(1998, 3, 1), dt.date(1997, 6, 1)]
DIGITS = 6
#: Added before rounding, so that halves like 1.1953125 round alike whatever their last bit.
NUDGE = 1.23e-8


def query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


def rounded(df: DataFrame) -> DataFrame:
    return df.select(
        *[
            F.round(F.col(f.name), DIGITS).alias(f.name)
            if isinstance(f.dataType, DoubleType)
            else F.col(f.name)
            for f in df.schema
        ]
    )


def _is_shift() -> Column:
    return F.col("shift_kind").isin(st.SHIFT_VALUES)


def _is_flag() -> Column:
    return F.col("category") == "F"


# --- log -------------------------------------------------------------------------------


@query
def parse_decimal_text(spark, sf):
    return st.event_log(spark, sf).select("event", parse_decimal(F.col("hours")).alias("hours"))


@query
def month_bucket(spark, sf):
    return st.event_log(spark, sf).select(
        "event",
        month_start(F.col("day")).alias("month"),
        month_index(F.col("day")).alias("month_idx"),
        is_month_end(F.col("day")).cast("int").alias("month_end"),
    )


@query
def monthly_count(spark, sf):
    return op.monthly_count(st.event_log(spark, sf), "entity", "day", _is_shift(), "shift_count")


@query
def monthly_sum(spark, sf):
    hours = parse_decimal(F.col("hours"))
    return rounded(
        op.monthly_sum(st.event_log(spark, sf), "entity", "day", _is_shift(), hours, "hours_sum")
    )


@query
def monthly_flag(spark, sf):
    return op.monthly_flag(st.event_log(spark, sf), "entity", "day", _is_flag(), "flag")


@query
def category_counts(spark, sf):
    return op.category_counts(
        st.event_log(spark, sf), "entity", "day", "category", st.STATUSES, "days"
    )


@query
def last_day_count(spark, sf):
    return op.last_day_count(
        st.event_log(spark, sf), "entity", "day", _is_flag(), "month_end_count"
    )


# --- history ---------------------------------------------------------------------------


def _shift_hours(spark, sf) -> DataFrame:
    """Sum of shift hours per spine month, missing in months without shifts."""
    measured = op.monthly_log(
        st.event_log(spark, sf),
        "entity",
        "day",
        [
            op.sum_of(_is_shift(), parse_decimal(F.col("hours")), "hours_sum"),
            op.count_of(_is_shift(), "shift_count"),
        ],
    )
    return (
        st.spine(spark, sf)
        .join(measured, ["entity", "month"], "left")
        .withColumn("month_idx", month_index(F.col("month")))
    )


@query
def trailing_flag_rate(spark, sf):
    rolled = op.rolling_stats(st.flags(spark, sf), "entity", "month_idx", "flag", [3])
    ahead = op.horizon_targets(rolled, "entity", "month_idx", "flag", 1)
    return rounded(ahead.select("entity", "month", "flag", "flag_rolling_mean_3", "y_1"))


@query
def rolling_stats(spark, sf):
    rows = _shift_hours(spark, sf).select("entity", "month", "month_idx", "hours_sum")
    return rounded(op.rolling_stats(rows, "entity", "month_idx", "hours_sum"))


@query
def cumulative_stats(spark, sf):
    rows = _shift_hours(spark, sf).select("entity", "month", "month_idx", "hours_sum")
    return rounded(op.cumulative_stats(rows, "entity", "month_idx", "hours_sum"))


@query
def trend_ratios(spark, sf):
    rolled = op.rolling_stats(st.flags(spark, sf), "entity", "month_idx", "flag")
    trends = op.trend_ratios(rolled, "flag")
    return rounded(trends.select("entity", "month", *[c for c in trends.columns if "trend" in c]))


@query
def history_block(spark, sf):
    return rounded(op.history_block(st.flags(spark, sf), "entity", "month_idx", ["flag"]))


@query
def sparse_history(spark, sf):
    rows = _shift_hours(spark, sf).select("entity", "month", "month_idx", "shift_count")
    present = F.col("shift_count").isNotNull()
    return rounded(op.sparse_history(rows, "entity", "month_idx", present, "shift_count"))


@query
def zero_streak(spark, sf):
    rows = st.snapshot(spark, sf).select(
        "entity", "month", month_index(F.col("month")).alias("month_idx"), "own_flag"
    )
    return op.zero_streak(rows, "entity", "month_idx", "own_flag")


@query
def horizon_targets(spark, sf):
    return op.horizon_targets(st.flags(spark, sf), "entity", "month_idx", "flag")


# --- peers and dependents --------------------------------------------------------------


@query
def peer_stats(spark, sf):
    rows = st.snapshot(spark, sf).select("entity", "month", "post_group", "own_flag")
    return rounded(op.peer_stats(rows, "entity", "month", "post_group", "own_flag"))


@query
def group_size(spark, sf):
    totals = op.dependent_totals(st.dependents(spark, sf), "entity", "n")
    rows = st.snapshot(spark, sf).select("entity", "month", "unit").join(totals, "entity", "left")
    sized = op.group_size(rows, "entity", "month", "unit", "n_dependents", "fan_out_size")
    heads = op.group_size(sized, "entity", "month", "unit", out="head_count", source=rows)
    return heads.drop("n_dependents")


@query
def age_at_month(spark, sf):
    return st.snapshot(spark, sf).select(
        "entity", "month", age_at(F.col("month"), F.col("birth_year")).alias("age")
    )


@query
def dependent_counts(spark, sf):
    d = st.SPEC.dependents
    female = ~F.col("gender").isin(st.MALE_SEGMENTS)
    rules = op.standard_rules(d.male_kinds, d.child_kinds, female)
    rows = st.snapshot(spark, sf).select("entity", "month", "gender")
    return op.dependent_counts(
        rows, st.dependents(spark, sf), "entity", "month", "kind", "birth", rules, "n"
    )


# --- encoding and calendar -------------------------------------------------------------


@query
def threshold_bin_flags(spark, sf):
    bins = threshold_bins(F.col("experience"), [0.5, 5, 8], "experience_stage")
    return st.snapshot(spark, sf).select("entity", "month", *[b.cast("int") for b in bins])


@query
def recode_groups(spark, sf):
    groups, default = st.EDUCATION
    male = recode(F.col("gender"), {1: st.MALE_SEGMENTS}, 0)
    return st.snapshot(spark, sf).select(
        "entity",
        "month",
        recode(F.col("post_group"), groups, default).alias("education"),
        male.alias("is_male"),
    )


@query
def one_hot(spark, sf):
    rows = st.snapshot(spark, sf).select("entity", "month", "post_group")
    return op.one_hot(rows, {"post_group": st.SEGMENTS})


@query
def calendar_one_hot(spark, sf):
    return op.calendar_one_hot(st.spine(spark, sf), "month", st.YEARS)


@query
def calendar_join(spark, sf):
    joined = op.calendar_join(
        st.spine(spark, sf), "month", st.calendar(spark, sf), "calendar_month"
    )
    return rounded(joined)


@query
def safe_column_names(spark, sf):
    """Order counts per customer under Cyrillic headers, renamed to Latin ones."""
    log = st.event_log(spark, sf)
    counted = log.groupBy(F.col("entity").alias("Табельный номер")).agg(
        F.count_if(_is_flag()).alias("Больничные дни"),
        F.count_if(~_is_flag()).alias("Прочие дни (объём)"),
    )
    return safe_names(counted)


# --- panel -----------------------------------------------------------------------------


def _panel(spark, sf) -> DataFrame:
    # The panel's projections compile to methods that the JVM, beyond 8,000 bytes, interprets for good.
    # Below this limit Spark splits them into small ones instead; results are the same.
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", 8000)
    return build_panel(
        st.snapshot(spark, sf),
        st.dependents(spark, sf),
        st.event_log(spark, sf),
        st.calendar(spark, sf),
        st.SPEC,
        st.LEVELS,
    )


# Every kind of panel column, with one history column for each frame the panel uses.
PANEL_COLUMNS = [
    "entity",
    "month",
    "age",
    "gender",
    "balance",
    "experience",
    *[f"experience_stage_{i}" for i in range(4)],
    "unit_size",
    *st.SPEC.dependents.names,
    *[f"segment_{s}" for s in st.SEGMENTS],
    *[f"education_{e}" for e in ("basic", "higher", "middle")],
    "post_group_people_count",
    "post_group_own_flag_count",
    "post_group_own_flag_avg",
    "fact_group_people_count",
    "fact_group_own_flag_count",
    "fact_group_own_flag_avg",
    "shift_count",
    "hours_sum",
    "flag",
    "month_end_count",
    *[f"days_{s}" for s in st.STATUSES],
    "shift_count_rolling_mean_3",
    "hours_sum_cummax",
    "days_P_rolling_mean_6",
    "days_O_cummean",
    "flag_rolling_mean_12",
    "flag_rolling_std_24",
    "trend_flag_2_6",
    "fact_group_people_count_rolling_max_9",
    "mean_quantity",
    "max_discount",
    "line_count",
    *[f"month_{m}" for m in range(1, 13)],
    *[f"year_{y}" for y in st.YEARS],
    *[f"y_{h}" for h in range(1, 13)],
]


@query
def assemble_panel(spark, sf):
    panel = _panel(spark, sf).select(*PANEL_COLUMNS)
    bools = [f"experience_stage_{i}" for i in range(4)]
    return rounded(panel.withColumns({b: F.col(b).cast("int") for b in bools}))


# The history blocks of the panel: 40 columns for each of these. With ``assemble_panel`` they
# cover every column of the panel.
HISTORIES = {
    "shifts": ["shift_count", "hours_sum"],
    "days": [f"days_{s}" for s in st.STATUSES],
    "flag": ["flag"],
    "peers": [
        f"{group}_{what}"
        for group in ("post_group", "fact_group")
        for what in ("people_count", "own_flag_count", "own_flag_avg")
    ],
}


def _panel_history(spark, sf, block: str) -> DataFrame:
    names = [n for col in HISTORIES[block] for n in op.history_columns(col)]
    panel = _panel(spark, sf)
    return panel.select(
        "entity", "month", *[F.round(F.col(n).cast("double") + NUDGE, DIGITS).alias(n) for n in names]
    )


@query
def panel_history_shifts(spark, sf):
    return _panel_history(spark, sf, "shifts")


@query
def panel_history_days(spark, sf):
    return _panel_history(spark, sf, "days")


@query
def panel_history_flag(spark, sf):
    return _panel_history(spark, sf, "flag")


@query
def panel_history_peers(spark, sf):
    return _panel_history(spark, sf, "peers")


@query
def time_split(spark, sf):
    panel = op.horizon_targets(st.flags(spark, sf), "entity", "month_idx", "flag")
    train, score = op.time_split(panel, "month", CUTOFF, op.label_columns())
    return train.withColumn("part", F.lit("train")).unionByName(
        score.withColumn("part", F.lit("score"))
    )


@query
def panel_whole(spark, sf):
    """All columns of the panel in one run."""
    histories = {n for block in HISTORIES.values() for col in block for n in op.history_columns(col)}
    panel = _panel(spark, sf)
    columns = [
        F.round(F.col(f.name).cast("double") + NUDGE, DIGITS).alias(f.name)
        if f.name in histories
        else F.round(f.name, DIGITS).alias(f.name)
        if isinstance(f.dataType, DoubleType)
        else F.col(f.name).cast("int").alias(f.name)
        if isinstance(f.dataType, BooleanType)
        else F.col(f.name)
        for f in panel.schema
    ]
    return panel.select(*columns)


# --- metrics ---------------------------------------------------------------------------


@query
def best_f1_threshold(spark, sf):
    return rounded(op.best_f1_threshold(st.line_scores(spark, sf)))


@query
def threshold_curve(spark, sf):
    return rounded(op.threshold_curve(st.line_scores(spark, sf), "horizon", "label", "score"))


def _decided(spark, sf) -> DataFrame:
    scores = st.line_scores(spark, sf)
    # Written once: the size check and the join read the few finished rows.
    best = stage(op.best_f1_threshold(scores), "thresholds")
    return op.apply_thresholds(scores, best)


@query
def apply_thresholds(spark, sf):
    return (
        _decided(spark, sf)
        .groupBy("horizon", "label", "prediction")
        .agg(F.count(F.lit(1)).alias("rows"), F.min("score").alias("lowest_score"))
    )


@query
def f1_by_fold_and_horizon(spark, sf):
    return rounded(op.f1_by(_decided(spark, sf)))


@query
def auc_by_fold_and_horizon(spark, sf):
    return rounded(op.auc_by(st.line_scores(spark, sf)))


@query
def mean_f1(spark, sf):
    return rounded(op.mean_f1(op.f1_by(_decided(spark, sf))))


@query
def ensemble_mean_scores(spark, sf):
    lines = st.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("entity"),
        F.col("l_linenumber").alias("horizon"),
        (F.col("l_quantity") / 50).alias("score"),
    )
    return rounded(ensemble_scores(lines, ["entity", "horizon"]))


@query
def fold_sizes(spark, sf):
    return op.fold_sizes(st.flags(spark, sf), "month", POINTS)


@query
def backtest_folds(spark, sf):
    return op.backtest_folds(st.flags(spark, sf), "month", POINTS)


@query
def stratified_split(spark, sf):
    log = st.event_log(spark, sf).select("event", _is_flag().cast("int").alias("label"))
    split = op.stratified_split(log, "label", ["event"])
    return split.withColumn("is_test", F.col("is_test").cast("int"))


@query
def stratified_splits(spark, sf):
    """Three labels of the log split at once, one of them unknown for some rows."""
    kinds = {f"is_{s}": (F.col("category") == s).cast("int") for s in st.STATUSES[:2]}
    dear = F.when(F.col("hours").isNotNull(), F.col("shift_kind").startswith("1").cast("int"))
    log = st.event_log(spark, sf).select("event", *[c.alias(n) for n, c in kinds.items()], dear.alias("is_first"))
    labels = [*kinds, "is_first"]
    split = op.stratified_splits(log, labels, ["event"])
    return split.withColumns({f"is_test_{y}": F.col(f"is_test_{y}").cast("int") for y in labels})


# --- export ----------------------------------------------------------------------------


@query
def to_long(spark, sf):
    return op.to_long(
        st.wide_forecast(spark, sf), "entity", dt.date(2000, 9, 1), op.label_columns()
    )


@query
def fill_template(spark, sf):
    return op.fill_template(st.template(spark, sf), to_long(spark, sf), "entity")


@query
def delimited_round_trip(spark, sf):
    """The log written as a `;` file and read back under its declared types."""
    log = st.event_log(spark, sf)
    path = staging_path(spark, "log-csv")
    write_delimited(log, path)
    back = read_delimited(spark, path, log.schema)
    return back.withColumn("hours", parse_decimal(F.col("hours")))


#: What a field may hold besides plain text.
HARD_TEXTS = ['a "quoted" word', "semi;colon; twice", " blanks around ", "", '"', 'back\\slash\\', "line\nbreak\n", ";"]


@query
def delimited_hard_text(spark, sf):
    """Whole documents, and texts made of what CSV treats specially, through a `;` file."""
    kind = (F.col("doc_id") % (len(HARD_TEXTS) + 1)).cast("int")
    note = F.get(F.array(*[F.lit(t) for t in HARD_TEXTS]), kind)  # the last kind has none: NULL
    rows = st.table(spark, sf, "documents").select("doc_id", "text", note.alias("note"), "lang")
    path = staging_path(spark, "documents-csv")
    write_delimited(rows, path)
    back = read_delimited(spark, path, rows.schema, multiline=True)
    return back.select("doc_id", F.md5("text").alias("text_md5"), F.length("text").alias("text_length"), F.hex("note").alias("note_hex"), "lang")


# --- models: checked by row counts and the tests' invariants ------------------------------

#: All settings of the full job but its 100 rounds, whose time is in the README.
FORECAST = BoostingParams(rounds=1)
FOREST_FEATURES = [
    "age",
    "gender",
    "experience",
    "post_group_own_flag_avg",
    "flag_rolling_mean_3",
    "flag_rolling_mean_12",
    "flag_cummean",
    "shift_count_rolling_mean_3",
    "children_6",
    *[f"month_{m}" for m in range(1, 13)],
]


def _forecaster(panel: DataFrame) -> HorizonForecaster:
    return HorizonForecaster(feature_columns(panel, st.SPEC), FORECAST)


@query
def fit_horizons(spark, sf):
    """Thresholds and validation F1 of twelve fitted horizons."""
    train, _ = op.time_split(_panel(spark, sf), "month", CUTOFF, op.label_columns())
    train = stage(train, "panel")
    return _forecaster(train).fit(train).thresholds


@query
def forecast_long(spark, sf):
    """Twelve months for the customers of the cutoff month, merged into the template."""
    template = st.template(spark, sf).withColumnRenamed("date", "month")
    panel = _panel(spark, sf)
    return forecast_template(panel, template, CUTOFF, _forecaster(panel))


@query
def backtest_f1_scores(spark, sf):
    panel = _panel(spark, sf)
    preds = backtest(panel, POINTS, lambda: _forecaster(panel))
    return backtest_f1(preds)[0]


@query
def fit_forest_baseline(spark, sf):
    panel = stage(_panel(spark, sf).select("entity", "month", *FOREST_FEATURES, *op.label_columns()), "panel")
    forest = ForestBaseline(FOREST_FEATURES, trees=3, max_depth=3)
    train, current = op.time_split(panel, "month", CUTOFF, forest.required_labels)
    return forest.fit(train).predict(current)


# --- models on a flag that recurs every fourth month, so that every prediction is known -----

KNOWN = ["phase", "noise"]


def _known_panel(spark, sf) -> DataFrame:
    """The spine with a flag that ``phase`` determines for every horizon, and a feature that says nothing."""
    phase = F.pmod(F.col("month_idx") + F.col("entity"), F.lit(4)).cast("int")
    # A few MB of shuffled rows grow to all of the panel. By bytes Spark would leave it to one task or a few.
    spread = st.flags(spark, sf).repartition(3 * spark.sparkContext.defaultParallelism, "entity")
    rows = spread.withColumns(
        {
            "phase": phase,
            "flag": (phase == 0).cast("int"),
            "noise": F.when(F.col("entity") % 3 != 0, F.pmod(F.hash("entity", "month"), F.lit(10))),
        }
    )
    return op.horizon_targets(rows, "entity", "month_idx", "flag")


def _known_forecaster() -> HorizonForecaster:
    params = BoostingParams(rounds=2, max_depth=3, max_bins=16, min_rows=5, feature_fraction=1.0)
    return HorizonForecaster(KNOWN, params)


@query
def fit_known_flag(spark, sf):
    """Horizons that found a threshold, and its F1 on the validation months."""
    train, _ = op.time_split(_known_panel(spark, sf), "month", CUTOFF, op.label_columns())
    return rounded(_known_forecaster().fit(train).thresholds.select("horizon", "f1"))


@query
def forecast_known_flag(spark, sf):
    template = st.template(spark, sf).withColumnRenamed("date", "month")
    return forecast_template(_known_panel(spark, sf), template, CUTOFF, _known_forecaster())


@query
def forecast_known_flag_forest(spark, sf):
    template = st.template(spark, sf).withColumnRenamed("date", "month")
    forest = ForestBaseline(["phase"], trees=3)
    return forecast_template(_known_panel(spark, sf), template, CUTOFF, forest)


@query
def backtest_known_flag(spark, sf):
    """Rows, positives and predictions of every fold and horizon."""
    preds = backtest(_known_panel(spark, sf), POINTS, _known_forecaster)
    return preds.groupBy("fold", "horizon").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum("label").alias("positives"),
        F.sum("prediction").alias("fired"),
        F.count_if(F.col("label") == F.col("prediction")).alias("agree"),
    )


SPLIT_FEATURES = ["flag", "calendar_month", "bucket", "noise"]
SPLIT = BoostingParams(
    rounds=1, learning_rate=1.0, max_depth=1, min_rows=50, feature_fraction=1.0, l1=2.5, l2=5.5, path_smooth=2.775
)


@query
def first_splits(spark, sf):
    """The first split of a regularised booster for each horizon: place, side of missing values, gain and leaves."""
    rows = op.horizon_targets(st.flags(spark, sf), "entity", "month_idx", "flag").withColumns(
        {
            "calendar_month": F.month("month"),
            "bucket": F.col("entity") % 7,
            "noise": F.when(F.col("entity") % 3 != 0, (F.col("entity") * 7 + F.col("month_idx")) % 10),
        }
    )
    labels = op.label_columns()
    rows = stage(rows.select("month", *SPLIT_FEATURES, *labels), "split-rows")
    bins = fit_bins(rows, SPLIT_FEATURES, SPLIT.max_bins)
    table = training_table(stage(encoded(rows, bins, ["month", *labels]), "split-codes"), "month", labels)
    found = []
    for h, booster in enumerate(fit_boosters(table, bins, labels, [Booster(y, SPLIT) for y in labels]), 1):
        for tree in booster.trees:
            edges = bins.edges[tree.feature[0]]
            edge = float(edges[tree.cut[0]]) if tree.cut[0] < len(edges) else None
            name = SPLIT_FEATURES[tree.feature[0]]
            found.append((h, name, edge, int(tree.missing_left[0]), tree.gain[0], *tree.output[1:]))
    schema = "horizon int, feature string, edge double, missing_left int, gain double, left_output double, right_output double"
    return rounded(spark.createDataFrame(found, schema))


@query
def predictions_by_row(spark, sf):
    """Every line's decision, under the thresholds of its horizon."""
    lines = st.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("entity"),
        F.col("l_linenumber").alias("horizon"),
        (F.col("l_quantity") / 50).alias("score"),
    )
    best = stage(op.best_f1_threshold(st.line_scores(spark, sf)), "thresholds")
    return rounded(op.apply_thresholds(lines, best))


@query
def ensemble_row_mean(spark, sf):
    """The mean that the forecaster takes of its seeds' scores, within the row."""
    seeds = [F.col("l_quantity") / 50, F.col("l_discount") * 10, F.col("l_tax") * 10]
    return rounded(
        st.table(spark, sf, "lineitem").select(
            F.col("l_orderkey").alias("entity"), F.col("l_linenumber").alias("horizon"), ensemble_mean(seeds).alias("score")
        )
    )
