from panelweave.operators.activity import (
    category_counts,
    count_of,
    counts_by_level,
    flag_of,
    last_day_count,
    level_column,
    month_end_count_of,
    monthly_count,
    monthly_flag,
    monthly_log,
    monthly_sum,
    sum_of,
)
from panelweave.operators.calendar import calendar_join
from panelweave.operators.dependents import (
    AgeBand,
    DependentRule,
    attach_dependents,
    dependent_births,
    dependent_counts,
    dependent_totals,
    standard_rules,
)
from panelweave.operators.encoding import calendar_one_hot, discover_levels, one_hot
from panelweave.operators.export import fill_template, to_long, unpivot_horizons
from panelweave.operators.folds import (
    backtest_folds,
    fold_frames,
    fold_sizes,
    label_columns,
    time_split,
)
from panelweave.operators.groups import attach_group_stats, group_size, peer_stats
from panelweave.operators.history import (
    cumulative_stats,
    history_block,
    history_columns,
    horizon_targets,
    rolling_stats,
    sparse_history,
    trend_ratios,
    unique_months,
    zero_streak,
)
from panelweave.operators.metrics import (
    apply_thresholds,
    auc_by,
    best_f1_threshold,
    f1_by,
    mean_f1,
    threshold_curve,
)
from panelweave.operators.sampling import stratified_split, stratified_splits

__all__ = [name for name in dir() if not name.startswith("_")]
