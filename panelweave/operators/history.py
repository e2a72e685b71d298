"""Per-entity history over a monthly table.

All windows partition by the entity. Callers keep (entity, month) unique, so one partition
holds at most one row per calendar month and stays small however large the log behind it is.
All of them order by the month too. A history over some of the rows steps over the others instead
of sorting them away: its rows, already wide, would have to be sorted again for the next history.
Expressions of one window spec go into a single select: Spark then plans one exchange, one
sort and one window node for all of them.

A block has 40 columns per input column, so expressions are passed as SQL text: building
them call by call costs the driver more time than the job itself.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Window lengths in rows, and the pairs of lengths compared as trends.
PERIODS = (1, 2, 3, 6, 9, 12, 24)
MEAN_TRENDS = ((2, 24), (2, 12), (2, 6), (1, 24), (1, 12), (1, 6), (1, 3))
STD_TRENDS = ((2, 24), (2, 12), (2, 6))

_PRESENT = "_present"


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _spec(*keys: str, order: str) -> str:
    return f"PARTITION BY {', '.join(map(_quoted, keys))} ORDER BY {_quoted(order)}"


def _append(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.selectExpr("*", *_named(columns))


def _named(columns: dict[str, str]) -> list[str]:
    return [f"{text} AS {_quoted(name)}" for name, text in columns.items()]


def _value(col: str) -> str:
    return f"CAST({_quoted(col)} AS DOUBLE)"


# --- rolling windows ---------------------------------------------------------------------
#
# A sliding aggregate visits each of its p rows again at every row. Here a window is the
# join of two shorter neighbours, one of them seen over a lag, so its cost does not depend
# on its length. A window is held as five moments: number of non-missing values, sum,
# squared deviations from the mean, maximum and minimum.

_EMPTY = {"n": "0", "sum": "0D", "dev": "0D", "max": "NULL", "min": "NULL"}


def _part(col: str, size: int, part: str, back: int = 0) -> str:
    return f"_{col}_{size}_{part}" + (f"_back_{back}" if back else "")


def _single(value: str) -> dict[str, str]:
    """Moments of a window that holds one row."""
    return {
        "n": f"CAST({value} IS NOT NULL AS INT)",
        "sum": f"coalesce({value}, 0D)",
        "dev": "0D",
        "max": value,
        "min": value,
    }


def _moments(col: str, size: int, back: int = 0) -> dict[str, str]:
    """The moments of a window, as it stands or as it stood ``back`` rows earlier."""
    if size == 1:
        return _single(_quoted(_part(col, 1, "max", back)) if back else _value(col))
    return {part: _quoted(_part(col, size, part, back)) for part in _EMPTY}


def _packed(col: str, size: int, back: int) -> str:
    return f"_{col}_{size}_packed_back_{back}"


def _kept(size: int) -> list[str]:
    return ["max"] if size == 1 else list(_EMPTY)


def _lag(col: str, size: int, back: int, spec: str, present: str | None) -> dict[str, str]:
    """The columns behind ``_moments(.., back)``; an empty window before the first row.

    With ``present`` it counts back over the rows where that holds, and the parts come packed:
    they may be missing themselves, so only the whole tells which rows to step over.
    """
    kept = _kept(size)
    now = _moments(col, size)
    if present is not None:
        parts = ", ".join(f"'{part}', {now[part]}" for part in kept)
        whole = f"CASE WHEN {present} THEN named_struct({parts}) END"
        return {_packed(col, size, back): f"lag({whole}, {back}) IGNORE NULLS OVER ({spec})"}
    return {
        _part(col, size, part, back): f"lag({now[part]}, {back}, {_EMPTY[part]}) OVER ({spec})"
        for part in kept
    }


def _unpacked(col: str, size: int, back: int) -> dict[str, str]:
    whole = _quoted(_packed(col, size, back))
    return {
        _part(col, size, part, back): f"coalesce({whole}.{part}, {_EMPTY[part]})" for part in _kept(size)
    }


def _join(col: str, near: int, far: int) -> dict[str, str]:
    """Moments of ``near`` rows and the ``far`` rows before them, from those of each side."""
    a, b = _moments(col, near), _moments(col, far, back=near)
    gap = f"({a['sum']} / {a['n']} - {b['sum']} / {b['n']})"
    weight = f"({a['n']} * {b['n']} / ({a['n']} + {b['n']}))"
    joined = {
        "n": f"{a['n']} + {b['n']}",
        "sum": f"{a['sum']} + {b['sum']}",
        "dev": f"{a['dev']} + {b['dev']} + CASE WHEN {a['n']} > 0 AND {b['n']} > 0 "
        f"THEN {gap} * {gap} * {weight} ELSE 0D END",
        "max": f"greatest({a['max']}, {b['max']})",
        "min": f"least({a['min']}, {b['min']})",
    }
    return {_part(col, near + far, part): text for part, text in joined.items()}


def _growth(periods: Sequence[int]) -> list[list[tuple[int, int]]]:
    """How to reach every window size by joining two smaller ones, in rounds.

    A join ``(near, far)`` looks back at the far window over a lag, so that window must be
    complete a round earlier, while the near one may come from the same round.
    """
    done = {1: 0}
    joins: list[tuple[int, int, int]] = []

    def reach(size: int) -> None:
        if size in done:
            return
        splits = [(near, size - near) for near in done if size - near in done]
        if not splits:
            reach(size - size // 2)
            reach(size // 2)
            splits = [(size - size // 2, size // 2)]
        ready, _, (near, far) = min(
            (max(done[near], done[far] + 1), -near, (near, far)) for near, far in splits
        )
        done[size] = ready
        joins.append((ready, near, far))

    for p in sorted(periods):
        reach(p)
    rounds = max((ready for ready, _, _ in joins), default=0)
    return [[(n, f) for ready, n, f in joins if ready == i] for i in range(1, rounds + 1)]


def _with_moments(
    df: DataFrame,
    cols: Sequence[str],
    spec: str,
    periods: Sequence[int],
    running: dict[str, str] | None = None,
    present: str | None = None,
) -> DataFrame:
    """The moments of the last ``p`` rows for every column and period.

    Each round is one window node over the same sorted partition; ``running`` columns of
    the same spec ride along in the first.
    """
    windows = dict(running or {})
    for joins in _growth(periods):
        lags = [(col, far, near) for far, near in sorted({(f, n) for n, f in joins}) for col in cols]
        for lag in lags:
            windows |= _lag(*lag, spec, present)
        df, windows = _append(df, windows), {}
        if present is not None:
            df = _append(df, {name: text for lag in lags for name, text in _unpacked(*lag).items()})
        for near, far in joins:
            df = _append(
                df, {name: text for col in cols for name, text in _join(col, near, far).items()}
            )
    return df


def _rolling(col: str, periods: Sequence[int]) -> dict[str, str]:
    out = {}
    for p in periods:
        m = _moments(col, p)
        out[f"{col}_rolling_mean_{p}"] = f"CASE WHEN {m['n']} > 0 THEN {m['sum']} / {m['n']} END"
        # Equal values deviate by exactly 0, whatever rounding their mean took.
        out[f"{col}_rolling_std_{p}"] = (
            f"CASE WHEN {m['n']} > 1 THEN CASE WHEN {m['max']} = {m['min']} THEN 0D "
            f"ELSE sqrt({m['dev']} / ({m['n']} - 1)) END END"
        )
        out[f"{col}_rolling_max_{p}"] = m["max"]
        out[f"{col}_rolling_min_{p}"] = m["min"]
    return out


# --- running and derived columns ---------------------------------------------------------


def _cumulative(col: str, spec: str, present: str | None = None) -> dict[str, str]:
    """Running mean over all rows so far, missing ones counted, and running maximum.

    With ``present``, over the rows where that holds, and NULL on the others.
    """
    value, row = _value(col), f"row_number() OVER ({spec})"
    so_far = f"OVER ({spec} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    if present is not None:
        value, row = f"CASE WHEN {present} THEN {value} END", f"count_if({present}) {so_far}"
    known = f"CASE WHEN {value} IS NOT NULL THEN"
    return {
        f"{col}_cummax": f"{known} max({value}) {so_far} END",
        f"{col}_cummean": f"{known} sum({value}) {so_far} / {row} END",
    }


def _trends(col: str) -> dict[str, str]:
    out = {}
    for kind, prefix, pairs in (("mean", "trend", MEAN_TRENDS), ("std", "trend_std", STD_TRENDS)):
        for short, long in pairs:
            a, b = (_quoted(f"{col}_rolling_{kind}_{p}") for p in (short, long))
            out[f"{prefix}_{col}_{short}_{long}"] = f"try_divide({a}, {b})"
    return out


def rolling_stats(
    df: DataFrame, key: str, order: str, col: str, periods: Sequence[int] = PERIODS
) -> DataFrame:
    """Mean, sample deviation, maximum and minimum of the last ``p`` rows, current one included."""
    moments = _with_moments(df, [col], _spec(key, order=order), periods)
    kept = [_quoted(c) for c in df.columns]
    return moments.selectExpr(*kept, *_named(_rolling(col, periods)))


def cumulative_stats(df: DataFrame, key: str, order: str, col: str) -> DataFrame:
    return _append(df, _cumulative(col, _spec(key, order=order)))


def trend_ratios(df: DataFrame, col: str) -> DataFrame:
    """Short over long rolling statistics; NULL where the long one is 0."""
    return _append(df, _trends(col))


def history_block(
    df: DataFrame,
    key: str,
    order: str,
    cols: Sequence[str],
    present: Column | None = None,
) -> DataFrame:
    """Rolling, cumulative and trend columns (40 per input column).

    With ``present``, history runs over the rows where it holds, as if the others did not
    exist, and is NULL on the others.
    """
    spec = _spec(key, order=order)
    rows, only = df, None
    if present is not None:
        rows, only = df.withColumn(_PRESENT, F.coalesce(present, F.lit(False))), _PRESENT

    cumulative: dict[str, str] = {}
    rolling: dict[str, str] = {}
    trends: dict[str, str] = {}
    for col in cols:
        cumulative |= _cumulative(col, spec, only)
        rolling |= _rolling(col, PERIODS)
        trends |= _trends(col)

    moments = _with_moments(rows, cols, spec, PERIODS, cumulative, only)
    kept = [_quoted(c) for c in [*rows.columns, *cumulative]]
    full = _append(moments.selectExpr(*kept, *_named(rolling)), trends)
    if present is None:
        return full
    history = [*cumulative, *rolling, *trends]
    return full.selectExpr(
        *[_quoted(c) for c in df.columns],
        *_named({c: f"CASE WHEN {_PRESENT} THEN {_quoted(c)} END" for c in history}),
    )


def history_columns(col: str) -> list[str]:
    """Names of the columns that ``history_block`` adds for one column."""
    return [*_cumulative(col, ""), *_rolling(col, PERIODS), *_trends(col)]


def sparse_history(df: DataFrame, key: str, order: str, present: Column, col: str) -> DataFrame:
    return history_block(df, key, order, [col], present)


def zero_streak(
    df: DataFrame, key: str, order: str, col: str, out: str = "zero_streak"
) -> DataFrame:
    """Zero rows directly before a zero row; any other row, missing included, restarts at 0."""
    w = W.partitionBy(key).orderBy(order)
    is_zero = F.coalesce(F.col(col) == 0, F.lit(False))
    numbered = df.select("*", F.row_number().over(w).alias("_row"))
    last_break = F.max(F.when(~is_zero, F.col("_row"))).over(
        w.rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    run = F.col("_row") - F.coalesce(last_break, F.lit(0)) - 1
    return numbered.select(
        *df.columns, F.when(is_zero, run).otherwise(F.lit(0)).cast("bigint").alias(out)
    )


def horizon_targets(
    df: DataFrame, key: str, month_idx: str, flag: str, horizons: int = 12, prefix: str = "y"
) -> DataFrame:
    """The flag exactly 1..H calendar months later; NULL where that month has no row."""
    spec = _spec(key, order=month_idx)
    return _append(
        df,
        {
            f"{prefix}_{h}": f"max({_quoted(flag)}) OVER "
            f"({spec} RANGE BETWEEN {h} FOLLOWING AND {h} FOLLOWING)"
            for h in range(1, horizons + 1)
        },
    )


def unique_months(df: DataFrame, key: str, order: str, checked: str) -> DataFrame:
    """The same rows, failing the job at an entity-month that occurs twice.

    The check rides on the column ``checked`` and shares the window of the history that
    follows, so it costs no pass of its own.
    """
    repeated = F.lag(order).over(W.partitionBy(key).orderBy(order)) == F.col(order)
    value = F.when(
        repeated,
        F.raise_error(F.concat(F.lit("entity-month occurs twice: "), F.col(key).cast("string"))),
    ).otherwise(F.col(checked))
    return df.withColumn(checked, value)
