"""Error-bounded compression and analysis of numeric time series on Spark."""
