"""Column expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_decimal(col: Column) -> Column:
    """Text number with a decimal comma or point as DOUBLE; bad text and NaN become NULL."""
    number = F.replace(col.cast("string"), F.lit(","), F.lit(".")).try_cast("double")
    return F.when(~F.isnan(number), number)


def month_start(col: Column) -> Column:
    """First day of the month of a date, timestamp or ``YYYY-MM-DD`` text."""
    return F.trunc(col.cast("date"), "MM")


def month_index(col: Column) -> Column:
    """Months since year 0, so that calendar distance is a plain integer difference."""
    day = col.cast("date")
    return (F.year(day) * 12 + F.month(day)).cast("int")


def is_month_end(col: Column) -> Column:
    day = col.cast("date")
    return day == F.last_day(day)


def age_at(month: Column, birth_year: Column) -> Column:
    """Difference of calendar years; negative for births after the month's year."""
    return F.year(month.cast("date")) - birth_year


def matches(col: Column, values: Iterable) -> Column:
    """True where the value is listed; missing values count as not listed."""
    return F.coalesce(col.isin(list(values)), F.lit(False))


def recode(col: Column, groups: Mapping[object, Sequence], default) -> Column:
    """Replace listed values by their group's label; everything else takes the default."""
    out = None
    for label, values in groups.items():
        hit = col.isin(list(values))
        out = F.when(hit, F.lit(label)) if out is None else out.when(hit, F.lit(label))
    return F.lit(default) if out is None else out.otherwise(F.lit(default))


def threshold_bins(col: Column, edges: Sequence[float], prefix: str) -> list[Column]:
    """Boolean bins ``<= e0, (e0, e1], .., > last``; a missing value is in no bin."""
    tests = [col <= edges[0]]
    tests += [(col > low) & (col <= high) for low, high in zip(edges, edges[1:])]
    tests.append(col > edges[-1])
    return [
        F.coalesce(test, F.lit(False)).alias(f"{prefix}_{i}") for i, test in enumerate(tests)
    ]
