"""Bar-oriented time-series analytics on Spark."""
