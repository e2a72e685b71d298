from panelweave.functions.columns import (
    age_at,
    is_month_end,
    matches,
    month_index,
    month_start,
    parse_decimal,
    recode,
    threshold_bins,
)
from panelweave.functions.naming import latin, plain, safe_names
from panelweave.functions.sizing import distinct_values

__all__ = [
    "age_at",
    "distinct_values",
    "is_month_end",
    "latin",
    "matches",
    "month_index",
    "month_start",
    "parse_decimal",
    "plain",
    "recode",
    "safe_names",
    "threshold_bins",
]
