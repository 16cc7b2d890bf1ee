"""Market-bar research on Spark: bars, indicators, condition trees, backtests and their analysis."""
