"""Entity-by-month panels on Spark: features, multi-horizon targets, forecasts, backtests."""
