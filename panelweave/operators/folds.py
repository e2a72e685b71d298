"""Time cuts of a panel: training rows, the month to score and rolling-origin folds."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def label_columns(horizons: int = 12, prefix: str = "y") -> list[str]:
    return [f"{prefix}_{h}" for h in range(1, horizons + 1)]


def time_split(
    panel: DataFrame, month: str, cutoff: dt.date, labels: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """Rows before the cutoff that have every label named, and the rows of the cutoff month."""
    train = panel.where(F.col(month) < F.lit(cutoff))
    if labels:
        train = train.na.drop(subset=list(labels))
    return train, panel.where(F.col(month) == F.lit(cutoff))


def _train(month: str, point: dt.date, embargo_months: int) -> Column:
    return F.col(month) < F.add_months(F.lit(point), -embargo_months)


def _test(month: str, point: dt.date) -> Column:
    return (F.col(month) >= F.lit(point)) & (F.col(month) < F.add_months(F.lit(point), 12))


def fold_frames(
    panel: DataFrame, month: str, point: dt.date, embargo_months: int = 0
) -> tuple[DataFrame, DataFrame]:
    """Rows before the cut, and the year that starts at it.

    Labels of training rows reach past the cut; ``embargo_months`` leaves such rows out.
    """
    return panel.where(_train(month, point, embargo_months)), panel.where(_test(month, point))


def fold_sizes(
    panel: DataFrame, month: str, points: Sequence[dt.date], embargo_months: int = 0
) -> DataFrame:
    """Train and test rows of every fold, counted in one pass over the panel."""
    sizes = panel.agg(
        F.array(
            *[
                F.struct(
                    F.lit(point).alias("fold"),
                    F.count_if(_train(month, point, embargo_months)).alias("train_rows"),
                    F.count_if(_test(month, point)).alias("test_rows"),
                )
                for point in points
            ]
        ).alias("folds")
    )
    return sizes.select(F.inline("folds"))


def backtest_folds(
    panel: DataFrame, month: str, points: Sequence[dt.date], embargo_months: int = 0
) -> DataFrame:
    """Every row once per fold it takes part in, with the fold and its role there.

    The cuts are literals, so a row finds its folds without any join.
    """
    roles = F.array(
        *[
            F.struct(
                F.lit(point).alias("fold"),
                F.when(_train(month, point, embargo_months), "train")
                .when(_test(month, point), "test")
                .alias("role"),
            )
            for point in points
        ]
    )
    taking_part = F.filter(roles, lambda r: r["role"].isNotNull())
    return panel.select("*", F.inline(taking_part))
