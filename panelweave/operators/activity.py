"""Monthly measures of an event log (one row per entity per day).

Every measure is a conditional aggregate, so any number of them costs one scan and one
shuffle. Spark aggregates within each task first: an entity that owns a large share of the
log reaches the shuffle as one row per month and task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.functions import is_month_end, latin, month_start, plain


def _only_if_any(pred: Column, value: Column) -> Column:
    """The value where some row of the month matched, else NULL."""
    return F.when(F.count_if(pred) > 0, value)


def count_of(pred: Column, out: str) -> Column:
    """Matching rows; NULL for a month without any."""
    return _only_if_any(pred, F.count_if(pred)).alias(out)


def sum_of(pred: Column, value: Column, out: str) -> Column:
    """Sum over matching rows, 0 if all their values are missing; NULL without matching rows."""
    total = F.coalesce(F.sum(F.when(pred, value)), F.lit(0.0))
    return _only_if_any(pred, total).alias(out)


def flag_of(pred: Column, out: str) -> Column:
    """1 for a month with a matching row, else NULL."""
    return _only_if_any(pred, F.lit(1)).alias(out)


def month_end_count_of(pred: Column, day: Column, out: str) -> Column:
    """Matching rows that fall on the last day of the month; NULL without matching rows."""
    return _only_if_any(pred, F.count_if(pred & is_month_end(day))).alias(out)


def level_column(prefix: str, level: object) -> str:
    return plain(f"{prefix}_{latin(str(level))}")


def counts_by_level(kind: Column, levels: Sequence, prefix: str) -> list[Column]:
    """Rows per category level, 0 for a level that the month lacks."""
    return [F.count_if(kind == level).alias(level_column(prefix, level)) for level in levels]


def monthly_log(
    log: DataFrame, entity: str, day: str, measures: Sequence[Column], month: str = "month"
) -> DataFrame:
    """All measures per entity and month, for every entity-month that the log mentions."""
    first = month_start(F.col(day))
    return (
        log.where(F.col(entity).isNotNull() & first.isNotNull())
        .groupBy(entity, first.alias(month))
        .agg(*measures)
    )


def _present_only(
    log: DataFrame, entity: str, day: str, pred: Column, measure: Column, out: str, month: str
) -> DataFrame:
    matching = log.where(pred)
    return monthly_log(matching, entity, day, [measure], month).where(F.col(out).isNotNull())


def monthly_count(log, entity, day, pred, out, month="month") -> DataFrame:
    return _present_only(log, entity, day, pred, count_of(pred, out), out, month)


def monthly_sum(log, entity, day, pred, value, out, month="month") -> DataFrame:
    return _present_only(log, entity, day, pred, sum_of(pred, value, out), out, month)


def monthly_flag(log, entity, day, pred, out, month="month") -> DataFrame:
    return _present_only(log, entity, day, pred, flag_of(pred, out), out, month)


def last_day_count(log, entity, day, pred, out, month="month") -> DataFrame:
    measure = month_end_count_of(pred, F.col(day), out)
    return _present_only(log, entity, day, pred, measure, out, month)


def category_counts(log, entity, day, kind, levels, prefix, month="month") -> DataFrame:
    return monthly_log(log, entity, day, counts_by_level(F.col(kind), levels, prefix), month)
