"""Forecasting operators on DataFrames: lazy plans, except where a docstring says that a job runs."""
