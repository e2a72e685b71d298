"""The whole entity-by-month panel: features and calendar-exact targets in one table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.functions import (
    age_at,
    matches,
    month_index,
    month_start,
    parse_decimal,
    plain,
    recode,
    safe_names,
    threshold_bins,
)
from panelweave.operators import (
    attach_dependents,
    calendar_join,
    calendar_one_hot,
    count_of,
    counts_by_level,
    dependent_births,
    dependent_totals,
    discover_levels,
    flag_of,
    group_size,
    history_block,
    horizon_targets,
    label_columns,
    level_column,
    month_end_count_of,
    monthly_log,
    one_hot,
    peer_stats,
    standard_rules,
    sum_of,
    unique_months,
    zero_streak,
)


@dataclass(frozen=True)
class LogSpec:
    """Event log: which rows are shifts, flag days and month-end codes."""

    entity: str
    day: str
    shift_kind: str
    shift_values: Sequence[str]
    hours: str
    category: str
    flag_values: Sequence[str]
    code: str
    code_values: Sequence[str]
    shift_count: str = "shift_count"
    hours_sum: str = "hours_sum"
    flag: str = "flag"
    month_end: str = "month_end_count"
    category_prefix: str = "days"


@dataclass(frozen=True)
class DependentSpec:
    entity: str
    kind: str
    birth: str
    male_kinds: Sequence[str]
    child_kinds: Sequence[str]
    names: Sequence[str] = (
        "retired",
        "children_6",
        "children_12",
        "children_6_female",
        "children_12_female",
    )
    count: str | None = None


@dataclass(frozen=True)
class SnapshotSpec:
    """Monthly snapshot: its own flag feeds peer groups, the rest describes the entity."""

    entity: str
    month: str
    flag: str
    birth_year: str
    gender: str
    male_values: Sequence[str]
    experience: str
    peer_groups: Sequence[str]
    unit: str
    raw: Sequence[str] = ()
    categories: Sequence[str] = ()
    recodes: Mapping[str, tuple[Mapping[str, Sequence[str]], str]] = field(default_factory=dict)
    experience_edges: Sequence[float] = (0.5, 5, 8)
    age: str = "age"
    unit_size: str = "unit_size"


@dataclass(frozen=True)
class PanelSpec:
    log: LogSpec
    dependents: DependentSpec
    snapshot: SnapshotSpec
    calendar_key: str
    horizons: int = 12
    peer_history: bool = True
    category_history: bool = True
    streak: str | None = None


@dataclass(frozen=True)
class PanelLevels:
    """Everything the column list depends on. Keep it with the model to score new data."""

    snapshot: Mapping[str, Sequence]
    log: Sequence
    years: Sequence[int]


def panel_levels(snapshot: DataFrame, log: DataFrame, spec: PanelSpec) -> PanelLevels:
    """Category levels and years found in the data."""
    s = spec.snapshot
    year = F.year(F.col(s.month).cast("date"))
    first, last = snapshot.agg(F.min(year), F.max(year)).first()
    return PanelLevels(
        snapshot=discover_levels(_recoded(snapshot, s), s.categories),
        log=discover_levels(log, [spec.log.category])[spec.log.category],
        years=[] if first is None else list(range(first, last + 1)),
    )


def _recoded(snapshot: DataFrame, s: SnapshotSpec) -> DataFrame:
    for column, (groups, default) in s.recodes.items():
        snapshot = snapshot.withColumn(column, recode(F.col(column), groups, default))
    return snapshot


def log_measures(log: DataFrame, spec: LogSpec, levels: Sequence) -> DataFrame:
    """Every monthly measure of the log from a single aggregation."""
    shift = matches(F.col(spec.shift_kind), spec.shift_values)
    flagged = matches(F.col(spec.category), spec.flag_values)
    coded = matches(F.col(spec.code), spec.code_values)
    return monthly_log(
        log,
        spec.entity,
        spec.day,
        [
            count_of(shift, spec.shift_count),
            sum_of(shift, parse_decimal(F.col(spec.hours)), spec.hours_sum),
            flag_of(flagged, spec.flag),
            month_end_count_of(coded, F.col(spec.day), spec.month_end),
            *counts_by_level(F.col(spec.category), levels, spec.category_prefix),
        ],
        month="_month",
    )


def snapshot_features(
    snapshot: DataFrame, dependents: DataFrame, spec: PanelSpec
) -> DataFrame:
    """Raw entity attributes, unit size and peer groups, one row per snapshot row."""
    s, d = spec.snapshot, spec.dependents
    base = snapshot.withColumn(s.month, month_start(F.col(s.month)))
    totals = dependent_totals(dependents, d.entity, d.count).withColumnRenamed(d.entity, s.entity)
    # Group tables are aggregated from the bare snapshot, not from the joins made so far.
    weights = base.select(s.entity, s.month, s.unit).join(totals, s.entity, "left")
    rows = group_size(
        base, s.entity, s.month, s.unit, "n_dependents", s.unit_size, source=weights
    )
    for group in s.peer_groups:
        rows = peer_stats(rows, s.entity, s.month, group, s.flag, source=base)

    raw = [c for c in s.raw if c != s.experience]
    return rows.select(
        s.entity,
        s.month,
        F.col(s.flag).alias("_own_flag"),
        s.birth_year,
        F.col(s.gender),
        s.experience,
        *[c for c in s.categories if c != s.gender],
        *raw,
        s.unit_size,
        *peer_columns(spec),
    )


def encode(panel: DataFrame, spec: PanelSpec, levels: PanelLevels) -> DataFrame:
    """Attributes as numbers. Done last: indicators would only widen the windows' rows."""
    s = spec.snapshot
    bins = threshold_bins(F.col(s.experience), s.experience_edges, f"{s.experience}_stage")
    age = age_at(F.col(s.month), F.col(s.birth_year)).alias(s.age)
    encoded = (
        _recoded(panel, s)
        .select("*", age, *bins)
        .withColumn(s.gender, matches(F.col(s.gender), s.male_values).cast("int"))
        .drop(s.birth_year)
    )
    return one_hot(encoded, {c: levels.snapshot[c] for c in s.categories})


def peer_columns(spec: PanelSpec) -> list[str]:
    s = spec.snapshot
    return [
        f"{group}_{what}"
        for group in s.peer_groups
        for what in ("people_count", f"{s.flag}_count", f"{s.flag}_avg")
    ]


def build_panel(
    snapshot: DataFrame,
    dependents: DataFrame,
    log: DataFrame,
    calendar: DataFrame,
    spec: PanelSpec,
    levels: PanelLevels | None = None,
) -> DataFrame:
    """One row per snapshot row: keys, features and ``y_1..y_H``.

    Log measures meet the snapshot on (entity, month) by a full outer join, because log
    months outside the snapshot still count in the log's own history. From there on every
    window partitions by entity, so one exchange serves all of them.
    """
    levels = levels or panel_levels(snapshot, log, spec)
    s, g = spec.snapshot, spec.log
    entity, month = s.entity, s.month

    measures = log_measures(log, g, levels.log).select(
        F.col(g.entity).alias(entity),
        F.col("_month").alias(month),
        F.lit(True).alias("_in_log"),
        g.shift_count,
        g.hours_sum,
        g.flag,
        g.month_end,
        *[level_column(g.category_prefix, level) for level in levels.log],
    )
    rows = snapshot_features(snapshot, dependents, spec).withColumn("_in_snap", F.lit(True))
    merged = rows.join(measures, [entity, month], "full_outer").withColumn(
        "_idx", month_index(F.col(month))
    )

    d = spec.dependents
    female = ~matches(F.col(s.gender), s.male_values)
    rules = standard_rules(d.male_kinds, d.child_kinds, female, d.names)
    births = dependent_births(dependents, d.entity, d.kind, d.birth, rules, d.count)
    merged = attach_dependents(
        merged, births.withColumnRenamed(d.entity, entity), entity, month, rules
    )

    # Shift history runs over months with shifts, category history over all log months.
    merged = history_block(
        merged, entity, "_idx", [g.shift_count, g.hours_sum], F.col(g.shift_count).isNotNull()
    )
    if spec.category_history and levels.log:
        counts = [level_column(g.category_prefix, level) for level in levels.log]
        merged = history_block(merged, entity, "_idx", counts, F.col("_in_log").isNotNull())

    panel = merged.where("_in_snap").withColumn(g.flag, F.coalesce(g.flag, F.lit(0)))
    panel = unique_months(panel, entity, "_idx", month)
    own_history = [g.flag, *(peer_columns(spec) if spec.peer_history else [])]
    panel = horizon_targets(panel, entity, "_idx", g.flag, spec.horizons)
    panel = history_block(panel, entity, "_idx", own_history)
    if spec.streak is not None:
        panel = zero_streak(panel, entity, "_idx", "_own_flag", spec.streak)

    panel = encode(panel, spec, levels)
    months = calendar.toDF(*[plain(c) for c in calendar.columns])
    panel = calendar_join(panel, month, months, plain(spec.calendar_key))
    panel = calendar_one_hot(panel, month, levels.years)
    targets = label_columns(spec.horizons)
    hidden = {"_own_flag", "_in_snap", "_in_log", "_idx", *targets}
    ordered = [c for c in panel.columns if c not in hidden]
    return safe_names(panel.select(*ordered, *targets))


def feature_columns(panel: DataFrame, spec: PanelSpec) -> list[str]:
    """The model's inputs: everything but the keys and the targets."""
    other = {spec.snapshot.entity, spec.snapshot.month, *label_columns(spec.horizons)}
    return [c for c in panel.columns if c not in other]


def split_features(panel: DataFrame, spec: PanelSpec) -> tuple[DataFrame, DataFrame]:
    """Features and targets as two tables, each with the keys."""
    keys = [spec.snapshot.entity, spec.snapshot.month]
    return (
        panel.select(*keys, *feature_columns(panel, spec)),
        panel.select(*keys, *label_columns(spec.horizons)),
    )
