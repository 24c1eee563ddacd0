"""Multi-horizon forecasting analytics on Spark DataFrames."""
