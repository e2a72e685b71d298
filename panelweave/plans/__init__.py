from panelweave.plans.forecast import forecast_long, forecast_template
from panelweave.plans.panel import (
    DependentSpec,
    LogSpec,
    PanelLevels,
    PanelSpec,
    SnapshotSpec,
    build_panel,
    feature_columns,
    panel_levels,
    split_features,
)

__all__ = [
    "DependentSpec",
    "LogSpec",
    "PanelLevels",
    "PanelSpec",
    "SnapshotSpec",
    "build_panel",
    "feature_columns",
    "forecast_long",
    "forecast_template",
    "panel_levels",
    "split_features",
]
