"""The same results in DuckDB SQL, written by other means than the Spark queries:
range frames for targets, grouped joins for peers, differences of row numbers for streaks."""

from __future__ import annotations

from panelweave.catalog.queries import CUTOFF, HARD_TEXTS, HISTORIES, NUDGE, PANEL_COLUMNS, POINTS
from panelweave.catalog.standins import SEGMENTS, SHIFT_VALUES, STATUSES, YEARS
from panelweave.operators.history import MEAN_TRENDS, PERIODS, STD_TRENDS

ORACLES: dict[str, str] = {}

_SHIFTS = ", ".join(f"'{s}'" for s in SHIFT_VALUES)

_LOG = """
log AS (
  SELECT o_orderkey AS event, o_custkey AS entity, CAST(o_orderdate AS DATE) AS day,
         CAST(date_trunc('month', o_orderdate) AS DATE) AS month,
         o_orderpriority AS shift_kind, o_orderstatus AS category,
         CASE WHEN o_orderstatus <> 'O' THEN floor(o_totalprice / 1000) + 0.5 END AS hours
  FROM orders)"""

_SPINE = """
spine AS (
  SELECT entity, CAST(m AS DATE) AS month,
         CAST(year(m) * 12 + month(m) AS INTEGER) AS month_idx
  FROM (SELECT entity, unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH)) AS m
        FROM log GROUP BY entity))"""

_FLAGS = """
flags AS (
  SELECT s.entity, s.month, s.month_idx,
         CAST(CASE WHEN s.entity = f.entity THEN 1 ELSE 0 END AS INTEGER) AS flag
  FROM spine s LEFT JOIN (SELECT DISTINCT entity, month FROM log WHERE category = 'F') f
    ON s.entity = f.entity AND s.month = f.month)"""

_SNAP = """
snap AS (
  SELECT s.entity, s.month, s.month_idx, c_mktsegment AS segment,
         nullif(c_mktsegment, 'HOUSEHOLD') AS post_group, c_nationkey AS fact_group,
         nullif(c_nationkey, 0) AS unit,
         CAST(1940 + 2 * c_nationkey AS INTEGER) AS birth_year, c_acctbal AS balance,
         CASE WHEN c_acctbal >= 0 THEN c_acctbal / 1000 END AS experience,
         CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 1 ELSE 0 END AS is_male,
         o.own_flag
  FROM spine s JOIN customer ON c_custkey = s.entity
  LEFT JOIN (SELECT entity, month, max(CASE WHEN category = 'F' THEN 1 ELSE 0 END) AS own_flag
             FROM log GROUP BY ALL) o ON o.entity = s.entity AND o.month = s.month)"""

_DEPS = """
deps AS (
  SELECT o_custkey AS entity, l_returnflag AS kind,
         year(l_shipdate) - 10 * (l_linenumber - 1) AS birth
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""

_SHIFT_HOURS = f"""
shift_months AS (
  SELECT entity, month, count(*) AS n, coalesce(sum(hours), 0) AS hours
  FROM log WHERE shift_kind IN ({_SHIFTS}) GROUP BY ALL),
shift_hours AS (
  SELECT s.entity, s.month, s.month_idx, h.hours AS hours_sum,
         CAST(h.n AS BIGINT) AS shift_count
  FROM spine s LEFT JOIN shift_months h USING (entity, month))"""

_TARGETS = f"""
targets AS (
  SELECT *, {", ".join(
      f"max(flag) OVER (PARTITION BY entity ORDER BY month_idx RANGE BETWEEN {h} FOLLOWING AND {h} FOLLOWING) AS y_{h}"
      for h in range(1, 13))}
  FROM flags)"""

_SCORES = """
scores AS (
  SELECT l_linenumber AS horizon, CAST(year(l_shipdate) AS INTEGER) AS fold,
         CAST(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS INTEGER) AS label,
         l_quantity / 50 AS score
  FROM lineitem)"""

# Every distinct score is tried as a threshold by joining it to all rows' grouped counts.
_CURVE = """
per_score AS (
  SELECT horizon, score, sum(label) AS tp, count(*) AS n FROM scores GROUP BY ALL),
curve AS (
  SELECT a.horizon, a.score, CAST(sum(b.tp) AS BIGINT) AS tp, CAST(sum(b.n) AS BIGINT) AS predicted,
         CAST(any_value(p.positives) AS BIGINT) AS positives,
         2.0 * sum(b.tp) / (sum(b.n) + any_value(p.positives)) AS f1
  FROM per_score a JOIN per_score b ON a.horizon = b.horizon AND b.score >= a.score
  JOIN (SELECT horizon, sum(label) AS positives FROM scores GROUP BY ALL) p ON p.horizon = a.horizon
  GROUP BY a.horizon, a.score),
best AS (
  SELECT c.horizon, min(c.score) AS threshold, any_value(m.f1) AS f1
  FROM curve c JOIN (SELECT horizon, max(f1) AS f1 FROM curve WHERE tp > 0 GROUP BY ALL) m
    ON c.horizon = m.horizon AND c.f1 = m.f1
  GROUP BY c.horizon),
decided AS (
  SELECT s.*, CAST(CASE WHEN s.score >= b.threshold THEN 1 ELSE 0 END AS INTEGER) AS prediction
  FROM scores s JOIN best b USING (horizon)),
f1 AS (
  SELECT fold, horizon, count(*) FILTER (label = 1 AND prediction = 1) AS tp,
         count(*) FILTER (label = 0 AND prediction = 1) AS fp,
         count(*) FILTER (label = 1 AND prediction = 0) AS fn,
         coalesce(2.0 * count(*) FILTER (label = 1 AND prediction = 1)
                  / nullif(count(*) FILTER (label = 1) + count(*) FILTER (prediction = 1), 0), 0) AS f1
  FROM decided GROUP BY fold, horizon)"""


def _with(*parts: str) -> str:
    return "WITH " + ",".join(parts) + "\n"


def _frame(p: int) -> str:
    return f"OVER (PARTITION BY entity ORDER BY month ROWS BETWEEN {p - 1} PRECEDING AND CURRENT ROW)"


def rolling_sql(col: str) -> list[str]:
    calls = {"mean": "avg", "std": "stddev_samp", "max": "max", "min": "min"}
    return [
        f"CAST({call}({col}) {_frame(p)} AS DOUBLE) AS {col}_rolling_{kind}_{p}"
        for p in PERIODS
        for kind, call in calls.items()
    ]


def cumulative_sql(col: str) -> list[str]:
    so_far = "OVER (PARTITION BY entity ORDER BY month ROWS UNBOUNDED PRECEDING)"
    return [
        f"CASE WHEN {col} IS NOT NULL THEN CAST(max({col}) {so_far} AS DOUBLE) END AS {col}_cummax",
        f"CASE WHEN {col} IS NOT NULL THEN sum({col}) {so_far} / count(*) {so_far} END AS {col}_cummean",
    ]


def trend_sql(col: str) -> list[str]:
    out = []
    for kind, prefix, pairs in (("mean", "trend", MEAN_TRENDS), ("std", "trend_std", STD_TRENDS)):
        out += [
            f"{col}_rolling_{kind}_{a} / nullif({col}_rolling_{kind}_{b}, 0) AS {prefix}_{col}_{a}_{b}"
            for a, b in pairs
        ]
    return out


def _names(columns: list[str]) -> list[str]:
    return [c.rsplit(" AS ", 1)[1] for c in columns]


def _round(columns: list[str]) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in columns)


def history_sql(source: str, col: str, out: str) -> str:
    """Two CTEs; the second holds the source's columns and the 40 history columns."""
    windows = ", ".join(rolling_sql(col) + cumulative_sql(col))
    return f"""
{out}_w AS (SELECT *, {windows} FROM {source}),
{out} AS (SELECT *, {", ".join(trend_sql(col))} FROM {out}_w)"""


def history_names(col: str) -> list[str]:
    return _names(rolling_sql(col) + cumulative_sql(col) + trend_sql(col))


# --- log -------------------------------------------------------------------------------

ORACLES["parse_decimal_text"] = _with(_LOG) + "SELECT event, hours FROM log"
ORACLES["month_bucket"] = """
SELECT o_orderkey AS event, CAST(date_trunc('month', o_orderdate) AS DATE) AS month,
       CAST(year(o_orderdate) * 12 + month(o_orderdate) AS INTEGER) AS month_idx,
       CAST(month(o_orderdate + INTERVAL 1 DAY) <> month(o_orderdate) AS INTEGER) AS month_end
FROM orders"""
ORACLES["monthly_count"] = _with(_LOG) + f"""
SELECT entity, month, count(*) AS shift_count FROM log
WHERE shift_kind IN ({_SHIFTS}) GROUP BY ALL"""
ORACLES["monthly_sum"] = _with(_LOG) + f"""
SELECT entity, month, round(coalesce(sum(hours), 0), 6) AS hours_sum FROM log
WHERE shift_kind IN ({_SHIFTS}) GROUP BY ALL"""
ORACLES["monthly_flag"] = _with(_LOG) + """
SELECT DISTINCT entity, month, CAST(1 AS INTEGER) AS flag FROM log WHERE category = 'F'"""
_CATEGORY_COLUMNS = ", ".join(
    f"count(*) FILTER (category = '{s}') AS days_{s}" for s in STATUSES
)
ORACLES["category_counts"] = _with(_LOG) + f"""
SELECT entity, month, {_CATEGORY_COLUMNS} FROM log GROUP BY entity, month"""
ORACLES["last_day_count"] = _with(_LOG) + """
SELECT entity, month, count(*) FILTER (day = last_day(day)) AS month_end_count
FROM log WHERE category = 'F' GROUP BY entity, month"""

# --- history ---------------------------------------------------------------------------

ORACLES["trailing_flag_rate"] = _with(_LOG, _SPINE, _FLAGS) + f"""
SELECT b.entity, b.month, b.flag, round(b.mean_3, 6) AS flag_rolling_mean_3, t.flag AS y_1
FROM (SELECT *, avg(flag) {_frame(3)} AS mean_3 FROM flags) b
LEFT JOIN flags t ON t.entity = b.entity AND t.month = b.month + INTERVAL 1 MONTH"""
_HOURS = _with(_LOG, _SPINE, _SHIFT_HOURS)
ORACLES["rolling_stats"] = _HOURS + f"""
SELECT entity, month, month_idx, round(hours_sum, 6) AS hours_sum, {_round(_names(rolling_sql("hours_sum")))}
FROM (SELECT *, {", ".join(rolling_sql("hours_sum"))} FROM shift_hours)"""
ORACLES["cumulative_stats"] = _HOURS + f"""
SELECT entity, month, month_idx, round(hours_sum, 6) AS hours_sum, {_round(_names(cumulative_sql("hours_sum")))}
FROM (SELECT *, {", ".join(cumulative_sql("hours_sum"))} FROM shift_hours)"""
_FLAG_HISTORY = _with(_LOG, _SPINE, _FLAGS, history_sql("flags", "flag", "h"))
ORACLES["trend_ratios"] = _FLAG_HISTORY + f"""
SELECT entity, month, {_round(_names(trend_sql("flag")))} FROM h"""
ORACLES["history_block"] = _FLAG_HISTORY + f"""
SELECT entity, month, month_idx, flag, {_round(history_names("flag"))} FROM h"""
ORACLES["sparse_history"] = _with(
    _LOG,
    _SPINE,
    _SHIFT_HOURS,
    "present AS (SELECT entity, month, CAST(n AS BIGINT) AS shift_count FROM shift_months)",
    history_sql("present", "shift_count", "h"),
) + f"""
SELECT s.entity, s.month, s.month_idx, h.shift_count, {_round(history_names("shift_count"))}
FROM spine s LEFT JOIN h USING (entity, month)"""
ORACLES["zero_streak"] = _with(_LOG, _SPINE, _SNAP, """
runs AS (
  SELECT *, row_number() OVER (PARTITION BY entity ORDER BY month)
          - row_number() OVER (PARTITION BY entity, own_flag IS NOT DISTINCT FROM 0 ORDER BY month) AS run
  FROM snap)""") + """
SELECT entity, month, month_idx, CAST(own_flag AS INTEGER) AS own_flag,
       CASE WHEN own_flag = 0
            THEN row_number() OVER (PARTITION BY entity, own_flag IS NOT DISTINCT FROM 0, run ORDER BY month) - 1
            ELSE 0 END AS zero_streak
FROM runs"""
ORACLES["horizon_targets"] = _with(_LOG, _SPINE, _FLAGS, _TARGETS) + "SELECT * FROM targets"

# --- peers and dependents --------------------------------------------------------------

_BASE = _with(_LOG, _SPINE, _SNAP)
ORACLES["peer_stats"] = _BASE + """
SELECT s.entity, s.month, s.post_group, s.own_flag, g.people AS post_group_people_count,
       CAST(g.flagged AS BIGINT) AS post_group_own_flag_count, round(g.share, 6) AS post_group_own_flag_avg
FROM snap s LEFT JOIN (
  SELECT month, post_group, count(*) AS people, coalesce(sum(own_flag), 0) AS flagged, avg(own_flag) AS share
  FROM snap WHERE post_group IS NOT NULL GROUP BY month, post_group) g USING (month, post_group)"""
ORACLES["group_size"] = _with(_LOG, _SPINE, _SNAP, _DEPS, """
fanned AS (
  SELECT s.entity, s.month, s.unit, greatest(1, coalesce(d.n, 0)) AS weight
  FROM snap s LEFT JOIN (SELECT entity, count(*) AS n FROM deps GROUP BY entity) d USING (entity))""") + """
SELECT s.entity, s.month, s.unit, CAST(g.size AS BIGINT) AS fan_out_size, g.heads AS head_count
FROM snap s LEFT JOIN (
  SELECT month, unit, sum(weight) AS size, count(*) AS heads FROM fanned
  WHERE unit IS NOT NULL GROUP BY month, unit) g USING (month, unit)"""
ORACLES["age_at_month"] = _BASE + """
SELECT entity, month, CAST(year(month) - birth_year AS INTEGER) AS age FROM snap"""
_DEP_COUNTS = """
dep_years AS (
  SELECT y.entity, y.year,
         count(*) FILTER ((kind <> 'R' AND y.year - birth > 55) OR (kind = 'R' AND y.year - birth > 60)) AS retired,
         count(*) FILTER (kind IN ('R', 'A') AND y.year - birth <= 6) AS children_6,
         count(*) FILTER (kind IN ('R', 'A') AND y.year - birth <= 12) AS children_12
  FROM (SELECT DISTINCT entity, year(month) AS year FROM spine) y JOIN deps USING (entity)
  GROUP BY y.entity, y.year),
dep_counts AS (
  SELECT s.entity, s.month, s.segment AS gender,
         nullif(d.retired, 0) AS retired, nullif(d.children_6, 0) AS children_6,
         nullif(d.children_12, 0) AS children_12,
         CASE WHEN is_male = 0 THEN nullif(d.children_6, 0) END AS children_6_female,
         CASE WHEN is_male = 0 THEN nullif(d.children_12, 0) END AS children_12_female
  FROM snap s
  LEFT JOIN dep_years d ON d.entity = s.entity AND d.year = year(s.month))"""
ORACLES["dependent_counts"] = _with(_LOG, _SPINE, _SNAP, _DEPS, _DEP_COUNTS) + """
SELECT * FROM dep_counts"""

# --- encoding and calendar -------------------------------------------------------------

_BINS = """CAST(coalesce(experience <= 0.5, false) AS INTEGER) AS experience_stage_0,
       CAST(coalesce(experience > 0.5 AND experience <= 5, false) AS INTEGER) AS experience_stage_1,
       CAST(coalesce(experience > 5 AND experience <= 8, false) AS INTEGER) AS experience_stage_2,
       CAST(coalesce(experience > 8, false) AS INTEGER) AS experience_stage_3"""
ORACLES["threshold_bin_flags"] = _BASE + f"SELECT entity, month, {_BINS} FROM snap"
ORACLES["recode_groups"] = _BASE + """
SELECT entity, month,
       CASE post_group WHEN 'BUILDING' THEN 'higher' WHEN 'MACHINERY' THEN 'higher'
                       WHEN 'FURNITURE' THEN 'middle' ELSE 'basic' END AS education,
       CAST(is_male AS INTEGER) AS is_male
FROM snap"""


def _dummies(expr: str, prefix: str, levels, quote: str = "'") -> str:
    return ", ".join(
        f"CAST(coalesce({expr} = {quote}{v}{quote}, false) AS INTEGER) AS {prefix}_{v}" for v in levels
    )


ORACLES["one_hot"] = _BASE + f"""
SELECT entity, month, {_dummies("post_group", "post_group", SEGMENTS)} FROM snap"""
_CALENDAR_DUMMIES = (
    _dummies("month(month)", "month", range(1, 13), "") + ", " + _dummies("year(month)", "year", YEARS, "")
)
ORACLES["calendar_one_hot"] = _with(_LOG, _SPINE) + f"""
SELECT entity, month, {_CALENDAR_DUMMIES} FROM spine"""
_DIM = """
dim AS (
  SELECT CAST(month(l_shipdate) AS INTEGER) AS calendar_month, round(avg(l_quantity), 6) AS mean_quantity,
         max(l_discount) AS max_discount, count(*) AS line_count
  FROM lineitem GROUP BY ALL)"""
ORACLES["calendar_join"] = _with(_LOG, _SPINE, _DIM) + """
SELECT entity, month, dim.* FROM spine JOIN dim ON month(spine.month) = dim.calendar_month"""
ORACLES["safe_column_names"] = """
SELECT o_custkey AS "Tabelnyj_nomer", count(*) FILTER (o_orderstatus = 'F') AS "Bolnichnye_dni",
       count(*) FILTER (o_orderstatus <> 'F') AS "Prochie_dni_(obem)"
FROM orders GROUP BY o_custkey"""

# --- panel -----------------------------------------------------------------------------


def _panel_sql() -> str:
    groups = ", ".join(
        f"""
{g}_stats AS (
  SELECT month, {g}, count(*) AS {g}_people_count, CAST(coalesce(sum(own_flag), 0) AS BIGINT) AS {g}_own_flag_count,
         avg(own_flag) AS {g}_own_flag_avg
  FROM snap WHERE {g} IS NOT NULL GROUP BY month, {g})"""
        for g in ("post_group", "fact_group")
    )
    log_part = f"""
log_months AS (
  SELECT entity, month, {_CATEGORY_COLUMNS},
         CASE WHEN bool_or(category = 'F') THEN count(*) FILTER (category = 'F' AND day = last_day(day)) END AS month_end_count
  FROM log GROUP BY entity, month),
log_hist AS (
  SELECT *, avg(days_P) {_frame(6)} AS days_P_rolling_mean_6,
         sum(days_O) OVER (PARTITION BY entity ORDER BY month) / row_number() OVER (PARTITION BY entity ORDER BY month) AS days_O_cummean
  FROM log_months),
shift_hist AS (
  SELECT entity, month, CAST(n AS BIGINT) AS shift_count, hours AS hours_sum,
         avg(n) {_frame(3)} AS shift_count_rolling_mean_3,
         max(hours) OVER (PARTITION BY entity ORDER BY month) AS hours_sum_cummax
  FROM shift_months),
units AS (
  SELECT month, unit, CAST(sum(greatest(1, coalesce(d.n, 0))) AS BIGINT) AS unit_size
  FROM snap LEFT JOIN (SELECT entity, count(*) AS n FROM deps GROUP BY entity) d USING (entity)
  WHERE unit IS NOT NULL GROUP BY month, unit),
flag_hist AS (
  SELECT *, avg(flag) {_frame(12)} AS flag_rolling_mean_12, stddev_samp(flag) {_frame(24)} AS flag_rolling_std_24,
         avg(flag) {_frame(2)} / nullif(avg(flag) {_frame(6)}, 0) AS trend_flag_2_6
  FROM targets),
wide AS (
  SELECT s.*, year(s.month) - s.birth_year AS age, is_male AS gender,
         CASE s.segment WHEN 'BUILDING' THEN 'higher' WHEN 'MACHINERY' THEN 'higher'
                        WHEN 'FURNITURE' THEN 'middle' ELSE 'basic' END AS education,
         units.unit_size, p.* EXCLUDE (month, post_group), f.* EXCLUDE (month, fact_group),
         CAST(max(f.fact_group_people_count) OVER (PARTITION BY s.entity ORDER BY s.month
              ROWS BETWEEN 8 PRECEDING AND CURRENT ROW) AS DOUBLE) AS fact_group_people_count_rolling_max_9,
         d.* EXCLUDE (entity, month, gender),
         sh.* EXCLUDE (entity, month), lh.* EXCLUDE (entity, month),
         fh.* EXCLUDE (entity, month, month_idx), dim.* EXCLUDE (calendar_month)
  FROM snap s
  LEFT JOIN units ON units.month = s.month AND units.unit = s.unit
  LEFT JOIN post_group_stats p ON p.month = s.month AND p.post_group = s.post_group
  LEFT JOIN fact_group_stats f ON f.month = s.month AND f.fact_group = s.fact_group
  LEFT JOIN dep_counts d ON d.entity = s.entity AND d.month = s.month
  LEFT JOIN shift_hist sh ON sh.entity = s.entity AND sh.month = s.month
  LEFT JOIN log_hist lh ON lh.entity = s.entity AND lh.month = s.month
  JOIN flag_hist fh ON fh.entity = s.entity AND fh.month = s.month
  JOIN dim ON dim.calendar_month = month(s.month)),
encoded AS (
  SELECT *, {_BINS}, {_dummies("segment", "segment", SEGMENTS)},
         {_dummies("education", "education", ("basic", "higher", "middle"))}, {_CALENDAR_DUMMIES}
  FROM wide)"""
    doubles = {
        "balance", "experience", "post_group_own_flag_avg", "fact_group_own_flag_avg", "hours_sum",
        "shift_count_rolling_mean_3", "hours_sum_cummax", "days_P_rolling_mean_6", "days_O_cummean",
        "flag_rolling_mean_12", "flag_rolling_std_24", "trend_flag_2_6",
    }
    integers = {"age", "gender"}
    columns = ", ".join(
        f"round({c}, 6) AS {c}"
        if c in doubles
        else f"CAST({c} AS INTEGER) AS {c}"
        if c in integers
        else c
        for c in PANEL_COLUMNS
    )
    parts = (_LOG, _SPINE, _FLAGS, _SNAP, _DEPS, _DEP_COUNTS, _SHIFT_HOURS, _TARGETS, _DIM, groups, log_part)
    return _with(*parts) + f"SELECT {columns} FROM encoded"


ORACLES["assemble_panel"] = _panel_sql()


def _panel_history_sql(block: str, *parts: str) -> str:
    """``parts`` end with a table ``base`` of the block's columns by entity and month."""
    chain, source = [], "base"
    for i, col in enumerate(HISTORIES[block]):
        chain.append(history_sql(source, col, f"h{i}"))
        source = f"h{i}"
    names = [n for col in HISTORIES[block] for n in history_names(col)]
    rounded = ", ".join(f"round(CAST(h.{n} AS DOUBLE) + {NUDGE}, 6) AS {n}" for n in names)
    return _with(_LOG, _SPINE, _SNAP, *parts, *chain) + f"""
SELECT s.entity, s.month, {rounded} FROM snap s LEFT JOIN {source} h ON h.entity = s.entity AND h.month = s.month"""


_PEERS = ", ".join(
    f"""
{g}_stats AS (
  SELECT month, {g}, count(*) AS {g}_people_count, coalesce(sum(own_flag), 0) AS {g}_own_flag_count,
         avg(own_flag) AS {g}_own_flag_avg
  FROM snap WHERE {g} IS NOT NULL GROUP BY month, {g})"""
    for g in ("post_group", "fact_group")
)
ORACLES["panel_history_shifts"] = _panel_history_sql(
    "shifts", _SHIFT_HOURS, "base AS (SELECT entity, month, n AS shift_count, hours AS hours_sum FROM shift_months)"
)
ORACLES["panel_history_days"] = _panel_history_sql(
    "days", f"base AS (SELECT entity, month, {_CATEGORY_COLUMNS} FROM log GROUP BY entity, month)"
)
ORACLES["panel_history_flag"] = _panel_history_sql("flag", _FLAGS, "base AS (SELECT * FROM flags)")
ORACLES["panel_history_peers"] = _panel_history_sql(
    "peers",
    _PEERS,
    """base AS (
  SELECT s.entity, s.month, p.* EXCLUDE (month, post_group), f.* EXCLUDE (month, fact_group) FROM snap s
  LEFT JOIN post_group_stats p ON p.month = s.month AND p.post_group = s.post_group
  LEFT JOIN fact_group_stats f ON f.month = s.month AND f.fact_group = s.fact_group)""",
)
ORACLES["time_split"] = _with(_LOG, _SPINE, _FLAGS, _TARGETS) + f"""
SELECT *, 'train' AS part FROM targets
WHERE month < DATE '{CUTOFF}' AND {" AND ".join(f"y_{h} IS NOT NULL" for h in range(1, 13))}
UNION ALL SELECT *, 'score' AS part FROM targets WHERE month = DATE '{CUTOFF}'"""

# --- metrics ---------------------------------------------------------------------------

_METRICS = _with(_SCORES, _CURVE)
ORACLES["threshold_curve"] = _METRICS + """
SELECT horizon, round(score, 6) AS score, tp, predicted, positives, round(f1, 6) AS f1 FROM curve"""
ORACLES["best_f1_threshold"] = _METRICS + """
SELECT horizon, round(threshold, 6) AS threshold, round(f1, 6) AS f1 FROM best"""
ORACLES["apply_thresholds"] = _METRICS + """
SELECT horizon, label, prediction, count(*) AS rows, min(score) AS lowest_score
FROM decided GROUP BY horizon, label, prediction"""
ORACLES["f1_by_fold_and_horizon"] = _METRICS + """
SELECT fold, horizon, tp, fp, fn, round(f1, 6) AS f1 FROM f1"""
ORACLES["auc_by_fold_and_horizon"] = _with(_SCORES) + """
SELECT fold, horizon, CAST(sum(pos) AS BIGINT) AS positives, CAST(sum(neg) AS BIGINT) AS negatives,
       round(sum(pos * below) / nullif(sum(pos) * sum(neg), 0), 6) AS auc
FROM (
  SELECT *, sum(neg) OVER (PARTITION BY fold, horizon ORDER BY score) - neg / 2.0 AS below
  FROM (SELECT fold, horizon, score, sum(label) AS pos, count(*) - sum(label) AS neg FROM scores GROUP BY ALL))
GROUP BY fold, horizon"""
ORACLES["mean_f1"] = _METRICS + """
SELECT horizon, round(avg(f1), 6) AS f1 FROM f1 GROUP BY horizon"""
ORACLES["ensemble_mean_scores"] = """
SELECT l_orderkey AS entity, l_linenumber AS horizon, round(avg(l_quantity / 50), 6) AS score
FROM lineitem GROUP BY ALL"""
_FOLDS = f"""
folds AS (SELECT unnest([{", ".join(f"DATE '{p}'" for p in POINTS)}]) AS fold),
roles AS (
  SELECT flags.*, fold,
         CASE WHEN month < fold THEN 'train' WHEN month < fold + INTERVAL 1 YEAR THEN 'test' END AS role
  FROM flags, folds)"""
ORACLES["backtest_folds"] = _with(_LOG, _SPINE, _FLAGS, _FOLDS) + """
SELECT * FROM roles WHERE role IS NOT NULL"""
ORACLES["fold_sizes"] = _with(_LOG, _SPINE, _FLAGS, _FOLDS) + """
SELECT fold, count(*) FILTER (role = 'train') AS train_rows, count(*) FILTER (role = 'test') AS test_rows
FROM roles GROUP BY fold"""


def _split_sql(name: str, label: str) -> str:
    return f"""
{name}_rows AS (SELECT o_orderkey AS event, {label} AS label FROM orders WHERE {label} IS NOT NULL),
{name}_totals AS (SELECT count(*) AS n, count(*) - ceil(0.33 * count(*)) AS n_train FROM {name}_rows),
{name}_shares AS (
  SELECT label, count(*) AS k, floor(count(*) * any_value(n_train) / any_value(n)) AS base,
         (count(*) * any_value(n_train)) % any_value(n) AS remainder
  FROM {name}_rows, {name}_totals GROUP BY label),
{name}_quotas AS (
  SELECT label, k - base - CASE WHEN row_number() OVER (ORDER BY remainder DESC, label)
                                     <= (SELECT any_value(n_train) FROM {name}_totals) - (SELECT sum(base) FROM {name}_shares)
                                THEN 1 ELSE 0 END AS quota
  FROM {name}_shares),
{name} AS (
  SELECT event, CAST(r.label AS INTEGER) AS label, CAST(CASE WHEN rank <= quota THEN 1 ELSE 0 END AS INTEGER) AS is_test
  FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(concat_ws('|', CAST(event AS VARCHAR), '42'))) AS rank
        FROM {name}_rows) r JOIN {name}_quotas USING (label))"""


ORACLES["stratified_split"] = _with(_split_sql("split", "CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END")) + "SELECT * FROM split"
_SPLITS = {
    "is_F": "CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END",
    "is_O": "CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END",
    "is_first": "CASE WHEN o_orderstatus <> 'O' THEN CASE WHEN o_orderpriority LIKE '1%' THEN 1 ELSE 0 END END",
}
ORACLES["stratified_splits"] = _with(*[_split_sql(f"split_{y}", label) for y, label in _SPLITS.items()]) + f"""
SELECT o_orderkey AS event, {", ".join(f"split_{y}.label AS {y}, split_{y}.is_test AS is_test_{y}" for y in _SPLITS)}
FROM orders {" ".join(f"LEFT JOIN split_{y} ON split_{y}.event = o_orderkey" for y in _SPLITS)}"""

# --- export ----------------------------------------------------------------------------

_LONG = """
long AS (
  SELECT c.entity, CAST(d.date AS DATE) AS date, coalesce(f.flag, 0) AS target
  FROM (SELECT DISTINCT entity FROM spine) c,
       (SELECT unnest(generate_series(DATE '2000-09-01', DATE '2001-08-01', INTERVAL 1 MONTH)) AS date) d
  LEFT JOIN flags f ON f.entity = c.entity AND f.month = d.date)"""
ORACLES["to_long"] = _with(_LOG, _SPINE, _FLAGS, _LONG) + """
SELECT entity, date, CAST(target AS INTEGER) AS target FROM long"""
ORACLES["fill_template"] = _with(_LOG, _SPINE, _FLAGS, _LONG) + """
SELECT t.entity, t.date, CAST(long.target AS INTEGER) AS target
FROM (SELECT c_custkey AS entity,
             CAST(unnest(generate_series(DATE '2000-09-01', DATE '2001-11-01', INTERVAL 1 MONTH)) AS DATE) AS date
      FROM customer) t
LEFT JOIN long USING (entity, date)"""
ORACLES["delimited_round_trip"] = _with(_LOG) + """
SELECT event, entity, day, shift_kind, category, hours FROM log"""

_NOTES = " ".join(f"WHEN {i} THEN '{t.encode().hex().upper()}'" for i, t in enumerate(HARD_TEXTS))
ORACLES["delimited_hard_text"] = f"""
SELECT doc_id, md5(text) AS text_md5, CAST(length(text) AS INTEGER) AS text_length,
       CASE doc_id % {len(HARD_TEXTS) + 1} {_NOTES} END AS note_hex, lang
FROM documents"""

# --- models whose every prediction is known ----------------------------------------------

_AHEAD = """
ahead AS (
  SELECT s.entity, s.month, h.horizon, CASE WHEN (s.month_idx + h.horizon + s.entity) % 4 = 0 THEN 1 ELSE 0 END AS label
  FROM (SELECT *, max(month) OVER (PARTITION BY entity) AS last FROM spine) s, (SELECT unnest(range(1, 13)) AS horizon) h
  WHERE s.month + INTERVAL 12 MONTH <= s.last)"""
ORACLES["fit_known_flag"] = _with(_LOG, _SPINE, _AHEAD) + f"""
SELECT CAST(horizon AS INTEGER) AS horizon, 1.0 AS f1 FROM ahead
WHERE month < DATE '{CUTOFF}' GROUP BY horizon"""
ORACLES["forecast_known_flag"] = _with(_LOG, _SPINE) + f"""
SELECT t.entity, t.month,
       CAST(CASE WHEN s.entity IS NULL OR t.month > DATE '{CUTOFF}' + INTERVAL 12 MONTH THEN NULL
            WHEN (year(t.month) * 12 + month(t.month) + t.entity) % 4 = 0 THEN 1 ELSE 0 END AS INTEGER) AS target
FROM (SELECT c_custkey AS entity,
             CAST(unnest(generate_series(DATE '2000-09-01', DATE '2001-11-01', INTERVAL 1 MONTH)) AS DATE) AS month
      FROM customer) t
LEFT JOIN (SELECT entity FROM spine WHERE month = DATE '{CUTOFF}') s ON s.entity = t.entity"""
ORACLES["forecast_known_flag_forest"] = ORACLES["forecast_known_flag"]
ORACLES["backtest_known_flag"] = _with(_LOG, _SPINE, _AHEAD) + f"""
SELECT fold, CAST(horizon AS INTEGER) AS horizon, count(*) AS rows, sum(label)::BIGINT AS positives,
       sum(label)::BIGINT AS fired, count(*) AS agree
FROM ahead, (SELECT unnest([{", ".join(f"DATE '{p}'" for p in POINTS)}]) AS fold)
WHERE month >= fold AND month < fold + INTERVAL 1 YEAR GROUP BY fold, horizon"""
ORACLES["predictions_by_row"] = _METRICS + """
SELECT l_orderkey AS entity, CAST(l_linenumber AS INTEGER) AS horizon, round(l_quantity / 50, 6) AS score,
       CAST(CASE WHEN l_quantity / 50 >= best.threshold THEN 1 ELSE 0 END AS INTEGER) AS prediction
FROM lineitem LEFT JOIN best ON best.horizon = l_linenumber"""
ORACLES["ensemble_row_mean"] = """
SELECT l_orderkey AS entity, l_linenumber AS horizon,
       round((l_quantity / 50 + l_discount * 10 + l_tax * 10) / 3, 6) AS score
FROM lineitem"""

# Every cut of every feature, with missing values on either side, weighed by regularised gains.
_SHRUNK = "(sign({g}) * greatest(abs({g}) - 2.5, 0))"


def _output(g: str, h: str) -> str:
    return f"(-{_SHRUNK.format(g=g)} / ({h} + 5.5))"


def _smoothed(g: str, h: str, n: str) -> str:
    return f"({_output(g, h)} * ({n} / 2.775) / ({n} / 2.775 + 1) + {_output('tg', 'th')} / ({n} / 2.775 + 1))"


def _gain(g: str, h: str, output: str) -> str:
    return f"(-(2 * {_SHRUNK.format(g=g)} * {output} + ({h} + 5.5) * {output} * {output}))"


ORACLES["first_splits"] = _with(_LOG, _SPINE, _FLAGS, _TARGETS).rstrip() + f""",
inputs AS (
  SELECT *, month(month) AS calendar_month, entity % 7 AS bucket,
         CASE WHEN entity % 3 <> 0 THEN (entity * 7 + month_idx) % 10 END AS noise
  FROM targets),
labelled AS (
  SELECT t.horizon, t.y, i.flag, i.calendar_month, i.bucket, i.noise
  FROM inputs i, LATERAL (VALUES {", ".join(f"({h}, i.y_{h})" for h in range(1, 13))}) t(horizon, y) WHERE t.y IS NOT NULL),
gradients AS (
  SELECT l.*, round((p - y) * 16777216) / 16777216 AS g, round(p * (1 - p) * 16777216) / 16777216 AS h
  FROM labelled l JOIN (SELECT horizon, avg(y) AS p FROM labelled GROUP BY horizon) USING (horizon)),
totals AS (SELECT horizon, sum(g) AS tg, sum(h) AS th, count(*) AS tn FROM gradients GROUP BY horizon),
cells AS (
  SELECT horizon, f.i, f.feature, f.value, sum(g) AS g, sum(h) AS h, count(*) AS n
  FROM gradients, LATERAL (VALUES (0, 'flag', flag), (1, 'calendar_month', calendar_month), (2, 'bucket', bucket),
                                  (3, 'noise', noise)) f(i, feature, value)
  GROUP BY ALL),
known AS (
  SELECT horizon, i, feature, value, lead(value) OVER w AS next, sum(g) OVER w AS g, sum(h) OVER w AS h, sum(n) OVER w AS n
  FROM cells WHERE value IS NOT NULL WINDOW w AS (PARTITION BY horizon, i ORDER BY value)),
sides AS (
  SELECT k.horizon, k.i, k.feature, k.value, k.next, s.missing_left, t.*  EXCLUDE (horizon),
         k.g + s.missing_left * coalesce(m.g, 0) AS lg, k.h + s.missing_left * coalesce(m.h, 0) AS lh,
         k.n + s.missing_left * coalesce(m.n, 0) AS ln
  FROM known k JOIN totals t USING (horizon)
  LEFT JOIN cells m ON m.horizon = k.horizon AND m.i = k.i AND m.value IS NULL
  JOIN (VALUES (0), (1)) s(missing_left) ON s.missing_left = 0 OR m.n IS NOT NULL),
paired AS (SELECT *, tg - lg AS rg, th - lh AS rh, tn - ln AS rn FROM sides),
outputs AS (
  SELECT *, {_smoothed("lg", "lh", "ln")} AS left_output, {_smoothed("rg", "rh", "rn")} AS right_output
  FROM paired WHERE ln >= 50 AND rn >= 50),
gains AS (
  SELECT *, {_gain("lg", "lh", "left_output")} + {_gain("rg", "rh", "right_output")}
            - {_gain("tg", "th", _output("tg", "th"))} AS gain
  FROM outputs),
best AS (SELECT * FROM gains WHERE gain > 0
         QUALIFY row_number() OVER (PARTITION BY horizon ORDER BY gain DESC, i, missing_left, value) = 1)
SELECT horizon, feature, round(value / 2.0 + next / 2.0, 6) AS edge, missing_left, round(gain, 6) AS gain,
       round(left_output, 6) AS left_output, round(right_output, 6) AS right_output
FROM best"""

_BLOCKS = {block: f"panel_history_{block}" for block in HISTORIES}
_HISTORY_NAMES = {n for block in HISTORIES.values() for col in block for n in history_names(col)}
ORACLES["panel_whole"] = f"""
SELECT {", ".join("a." + c for c in PANEL_COLUMNS if c not in _HISTORY_NAMES)}, CAST(month(a.month) AS INTEGER) AS calendar_month,
       {", ".join(f"{block}.* EXCLUDE (entity, month)" for block in _BLOCKS)}
FROM ({ORACLES["assemble_panel"]}) a
{" ".join(f"JOIN ({ORACLES[q]}) {block} ON {block}.entity = a.entity AND {block}.month = a.month" for block, q in _BLOCKS.items())}"""
