from panelweave.models.backtest import backtest, backtest_f1
from panelweave.models.binning import Bins, encoded, fit_bins
from panelweave.models.boosting import Booster, BoostingParams, fit_boosters, scores, training_table
from panelweave.models.forecaster import (
    ForestBaseline,
    HorizonForecaster,
    assemble,
    ensemble_mean,
    ensemble_scores,
)

__all__ = [
    "Bins",
    "Booster",
    "BoostingParams",
    "ForestBaseline",
    "HorizonForecaster",
    "assemble",
    "backtest",
    "backtest_f1",
    "encoded",
    "ensemble_mean",
    "ensemble_scores",
    "fit_bins",
    "fit_boosters",
    "scores",
    "training_table",
]
